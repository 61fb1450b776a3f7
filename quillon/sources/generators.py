"""Random dense matrices and power-law graphs, from hashes of their indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, draw, draw_sql, floor_div, gaussian, uniform
from ..matrix import Matrix, ShapeError
from ..plans.work import written


def random_dense(spark: SparkSession, rows: int, cols: int, seed: int = 0, low: float = -1.0, high: float = 1.0, normal: bool = False) -> Matrix:
    cells = spark.range(rows * cols).select(floor_div(F.col("id"), cols).alias("k"), (F.col("id") % cols).alias("c"))
    value = gaussian("k", "c", seed) if normal else F.lit(low) + draw(seed, F.col("k"), F.col("c")) / float(PRIME) * (high - low)
    return Matrix(cells.withColumn("v", value), rows, cols)


def random_cells(places: DataFrame, seed: int = 0, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """The same values for given places (k, c)."""
    return places.withColumn("v", F.lit(low) + draw(seed, F.col("k"), F.col("c")) / float(PRIME) * (high - low))


def random_dense_sql(rows: int, cols: int, seed: int = 0, low: float = -1.0, high: float = 1.0) -> str:
    unit = draw_sql(str(seed), "k.range", "c.range")
    return f"SELECT k.range::BIGINT AS k, c.range::BIGINT AS c, {low}::DOUBLE + ({unit}) / {float(PRIME)}::DOUBLE * {high - low}::DOUBLE AS v FROM range({rows}) k, range({cols}) c"


def random_values(m: Matrix, seed: int = 0, scale: float = 10.0) -> Matrix:
    """Values for a pattern: a hash of each place, times ``scale``."""
    return Matrix(m.df.withColumn("v", uniform("k", "c", seed, high=scale)), m.rows, m.cols)


def scrambled(vertex: Column, scale: int, seed: int = 0) -> Column:
    """A permutation of [0, 2**scale): rounds of an odd factor and folded upper bits.

    Every step can be undone within ``scale`` bits, so no two vertices meet.
    Factors are small enough that no product leaves 63 bits.
    """
    mask = (1 << scale) - 1
    half = max(1, scale // 2)
    for r in range(3):
        factor = (0x5BD1 + 2 * (seed + 7 * r)) | 1
        vertex = ((vertex.bitwiseAND(mask) * (factor & 0xFFFF)) if scale <= 47 else vertex).bitwiseAND(mask)
        vertex = vertex.bitwiseXOR(F.shiftright(vertex, half))
    return vertex.bitwiseAND(mask)


def scrambled_sql(vertex: str, scale: int, seed: int = 0) -> str:
    mask, half = (1 << scale) - 1, max(1, scale // 2)
    for r in range(3):
        factor = ((0x5BD1 + 2 * (seed + 7 * r)) | 1) & 0xFFFF if scale <= 47 else 1
        vertex = f"list_transform([((({vertex}) & {mask}) * {factor}) & {mask}], lambda x: xor(x, x >> {half}))[1]"
    return f"(({vertex}) & {mask})"


#: Draws are made until the edges are found, but not more than so many times their number.
MOST_DRAWS = 4096


def drawn_edges(spark: SparkSession, low: int, high: int, scale: int, a: float, b: float, c: float, scramble: bool, seed: int) -> DataFrame:
    """s < d and the first draw of each different edge among the draws from low to high."""
    # u < c: (0, 1); < b + c: (1, 0); < a + b + c: (0, 0); else (1, 1)
    bits = F.sequence(F.lit(0), F.lit(scale - 1))
    units = F.transform(bits, lambda k: draw(seed, F.col("id"), k) / float(PRIME))
    weigh = lambda hit: F.aggregate(F.transform("u", lambda x, k: F.when(hit(x), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, y: s + y)
    src = weigh(lambda x: ((x >= c) & (x < b + c)) | (x >= a + b + c))
    dst = weigh(lambda x: (x < c) | (x >= a + b + c))
    edges = spark.range(low, high).select("id", units.alias("u")).select("id", src.alias("s"), dst.alias("d"))
    if scramble:
        edges = edges.select("id", scrambled(F.col("s"), scale, seed).alias("s"), scrambled(F.col("d"), scale, seed).alias("d"))
    return edges.where("s <> d").groupBy(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).agg(F.min("id").alias("first"))


def last_place(df: DataFrame, place: str, want: int, high: int, parts: int = 1024) -> int:
    """The place up to which ``want`` rows lie (places below ``high``, each once), by narrowing counts."""
    low = 0
    while high - low > 1:
        width = -(-(high - low) // parts)
        counts = dict(df.where(F.col(place).between(low, high - 1)).groupBy(floor_div(F.col(place) - low, width).alias("p")).count().collect())
        for p in range(parts):
            if counts.get(p, 0) >= want:
                break
            want -= counts.get(p, 0)
        low, high = low + p * width, min(high, low + (p + 1) * width)
    return low


def power_law_edges(spark: SparkSession, scale: int, edge_factor: int, a: float = 0.59, b: float = 0.19, c: float = 0.19, scramble: bool = True, seed: int = 0) -> DataFrame:
    """src, dst of a graph of 2**scale vertices and exactly edge_factor * 2**scale different edges.

    Each bit of an edge falls in one of four quarters by its own hash.  Loops and
    repeats are drawn again: the edges are those of the first draws that give so
    many.  Both directions of an edge are given.  Edges that were drawn are kept: more
    draws are made only from where the last ones ended, and merged with those.
    """
    if not 1 <= scale <= 62 or min(a, b, c) < 0 or a + b + c > 1:
        raise ShapeError("scale is 1 to 62, and a, b, c are shares of one")
    want = edge_factor << scale
    if want < 1 or want > (1 << scale) * ((1 << scale) - 1) // 2:
        raise ShapeError(f"{want} edges between {1 << scale} vertices")
    one, low, draws = None, 0, want
    while True:
        new = drawn_edges(spark, low, draws, scale, a, b, c, scramble, seed)
        one = written(new if one is None else one.unionByName(new).groupBy("s", "d").agg(F.min("first").alias("first")), "edges")
        found = one.count()
        if found >= want:
            break
        if draws >= MOST_DRAWS * want:
            raise ShapeError(f"only {found} of {want} edges in {draws} draws")
        low, draws = draws, 2 * draws
    one = one.where(F.col("first") <= last_place(one, "first", want, draws))
    return one.select(F.inline(F.array(F.struct(F.col("s").alias("src"), F.col("d").alias("dst")), F.struct(F.col("d").alias("src"), F.col("s").alias("dst")))))


def power_law_sql(scale: int, edge_factor: int, draws: int, a: float = 0.59, b: float = 0.19, c: float = 0.19, seed: int = 0) -> tuple[str, str]:
    """The same edges as SQL (for DuckDB), from so many draws at most: the query, and the tables that go before it."""
    unit = f"({draw_sql(str(seed), 'id.range', 'bit.range')}) / {float(PRIME)}::DOUBLE"
    src = f"sum(CASE WHEN (u >= {c!r}::DOUBLE AND u < {b + c!r}::DOUBLE) OR u >= {a + b + c!r}::DOUBLE THEN 1 << bit ELSE 0 END)::BIGINT"
    dst = f"sum(CASE WHEN u < {c!r}::DOUBLE OR u >= {a + b + c!r}::DOUBLE THEN 1 << bit ELSE 0 END)::BIGINT"
    return """SELECT s AS src, d AS dst FROM one UNION ALL SELECT d, s FROM one""", f"""units AS (SELECT id.range::BIGINT AS id, bit.range::BIGINT AS bit, {unit} AS u FROM range({draws}) id, range({scale}) bit),
    raw AS (SELECT id, {src} AS s, {dst} AS d FROM units GROUP BY id),
    mixed AS (SELECT id, {scrambled_sql("s", scale, seed)} AS s, {scrambled_sql("d", scale, seed)} AS d FROM raw),
    one AS (SELECT least(s, d) AS s, greatest(s, d) AS d FROM mixed WHERE s <> d GROUP BY ALL ORDER BY min(id) LIMIT {edge_factor << scale})"""
