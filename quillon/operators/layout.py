"""Layouts of a sparse matrix: rows, pointers, positions, blocks, tiles, dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import floor_div as div
from ..matrix import Matrix, ShapeError
from .ranks import ranked

#: Rows of a matrix in a block of a running sum, and entries in a piece of a row.
SPAN = 65_536


def axis(df: DataFrame, n: int, name: str) -> DataFrame:
    """All places 0 to n of an axis."""
    return df.sparkSession.range(n).select(F.col("id").alias(name))


def earlier(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, key: str, values: dict[str, Column], span: int = SPAN) -> DataFrame:
    """``df`` (one row a key) with the sums of each value over lesser keys.

    Two levels: sums of ranges of ``span`` keys are run through first, so the one
    task that sees all of them has a row for each range only.
    """
    block = div(F.col(key), span)
    sums = df.groupBy(block.alias("__b")).agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    whole = earlier(Window.orderBy("__b"))
    base = sums.select("__b", *[F.coalesce(F.sum(f"__{n}").over(whole), F.lit(0)).alias(f"__{n}") for n in values])
    inside = earlier(Window.partitionBy("__b").orderBy(key))
    rows = df.withColumn("__b", block).join(base, "__b")
    found = rows.select(*df.columns, *[(F.col(f"__{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).cast("long").alias(n) for n, v in values.items()])
    return found


def csr_rows(m: Matrix) -> DataFrame:
    """k, cols, vals of every row that has entries, columns ascending; repeats are kept.

    A row is one array; ``csr_pieces`` cuts crowded ones.
    """
    rows = m.df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("e"))
    return rows.select("k", F.col("e.c").alias("cols"), F.col("e.v").alias("vals"))


def row_lengths(m: Matrix) -> DataFrame:
    return m.df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def row_pointer(m: Matrix) -> DataFrame:
    """k and the entries in the rows before it, empty rows included."""
    full = axis(m.df, m.rows, "k").join(row_lengths(m), "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))
    return running(full, "k", {"start": F.col("n")}).select("k", "start")


def row_table(m: Matrix) -> DataFrame:
    """i, k, start of the rows that have entries (doubly compressed rows)."""
    return running(row_lengths(m), "k", {"i": F.lit(1), "start": F.col("n")}).select("i", "k", "start")


def renumbered(m: Matrix) -> DataFrame:
    """Entries with rows numbered without gaps from 1, and the original row from 1."""
    numbers = running(m.df.select(F.col("k").cast("long").alias("k")).distinct(), "k", {"i": F.lit(1)})
    return numbers.select((F.col("i") + 1).alias("compressed_row"), (F.col("k") + 1).alias("original_row"))


def positioned(m: Matrix, name: str = "pos", ties: tuple[str, ...] = ("v",)) -> DataFrame:
    """Entries with their place in row-major order, repeats one after the other."""
    return ranked(m.df, ["k", "c", *ties], name)


def transpose_map(m: Matrix) -> DataFrame:
    """pos_t, pos: places of each entry in the transposed and in the original order.

    Entries carry their place into the other order, so repeats stay apart and
    nothing is joined to itself.
    """
    return ranked(positioned(m).select("c", "k", "pos"), ["c", "k", "pos"], "pos_t").select("pos_t", "pos")


def row_places(m: Matrix) -> DataFrame:
    """k, i, c: the entries with their place in the row; no row is held by a task."""
    return ranked(m.df.select("k", "c"), ["k", "c"], group="k", inside="i").select("k", "i", "c")


def csr_pieces(m: Matrix, most: int = SPAN) -> DataFrame:
    """k, piece, cols, vals: rows as arrays, cut to pieces of ``most`` entries, columns ascending."""
    rows = ranked(m.df.select("k", "c", "v"), ["k", "c", "v"], group="k", inside="i").groupBy("k", div("i", most).alias("piece"))
    found = rows.agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("e"))
    return found.select("k", "piece", F.col("e.c").alias("cols"), F.col("e.v").alias("vals"))


def first_inserted(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value of each key that was inserted first, by ``order``; ties by the least value."""
    return df.groupBy(*keys).agg(F.min(F.struct(order, value)).alias("__first")).select(*keys, F.col(f"__first.{value}").alias(value))


def looked_up(queries: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Queries with the value that the table (a row a key) has for them, null for none."""
    return queries.join(table.select(*keys, value), keys, "left")


def expand_rows(rows: DataFrame) -> DataFrame:
    """csr rows back to one row an entry, with its place in the row."""
    return rows.select("k", F.posexplode("cols").alias("i", "c")).select("k", F.col("i").cast("long").alias("i"), "c")


def densified(m: Matrix) -> DataFrame:
    """Every (k, c) with its value, 0 where there is no entry; repeats are summed."""
    grid = axis(m.df, m.rows, "k").crossJoin(axis(m.df, m.cols, "c"))
    return grid.join(m.coalesced().df, ["k", "c"], "left").select("k", "c", F.coalesce("v", F.lit(0)).alias("v"))


def dense_transposed(dense: DataFrame) -> DataFrame:
    """Cells (n, c, x) with n and c swapped; no data moves."""
    names = {"n": "c", "c": "n"}
    return dense.select(*[F.col(names.get(x, x)).alias(x) for x in dense.columns])


def sampled(dense: DataFrame, structure: Matrix) -> DataFrame:
    """The values of a dense relation (k, c, v) where the structure has entries."""
    return dense.join(structure.df.select("k", "c").distinct(), ["k", "c"], "left_semi")


def block_counts(m: Matrix, kb: int, cb: int) -> DataFrame:
    """Entries of each block that has some; blocks at the edges may be smaller."""
    return m.df.groupBy(div(F.col("k"), kb).alias("kb"), div(F.col("c"), cb).alias("cb")).agg(F.count(F.lit(1)).alias("nnz"))


def blocks(m: Matrix, kb: int, cb: int) -> DataFrame:
    """kb, cb, and the entries of the block by local column: rowidx, colidx, vals."""
    grouped = m.df.groupBy(div(F.col("k"), kb).alias("kb"), div(F.col("c"), cb).alias("cb")).agg(F.array_sort(F.collect_list(F.struct((F.col("k") % kb).alias("lk"), (F.col("c") % cb).alias("lc"), "v"))).alias("e"))
    return grouped.select("kb", "cb", F.col("e.lk").alias("lk"), F.col("e.lc").alias("lc"), F.col("e.v").alias("vals"))


def block_pointer(m: Matrix, kb: int, cb: int) -> DataFrame:
    """kb, cb, local row, and the block's entries in the rows before it."""
    made = block_counts(m, kb, cb).select("kb", "cb").crossJoin(axis(m.df, kb, "lk"))
    counts = m.df.groupBy(div(F.col("k"), kb).alias("kb"), div(F.col("c"), cb).alias("cb"), (F.col("k") % kb).alias("lk")).agg(F.count(F.lit(1)).alias("n"))
    full = made.join(counts, ["kb", "cb", "lk"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("kb", "cb").orderBy("lk").rowsBetween(Window.unboundedPreceding, -1)
    return full.select("kb", "cb", "lk", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))


def block_expanded(b: DataFrame, size: int) -> DataFrame:
    """Block payloads (br, bc, vals of size*size, row-major) as entries."""
    cells = b.select("br", "bc", F.posexplode("vals").alias("p", "v"))
    return cells.select((F.col("br") * size + div(F.col("p"), size)).cast("long").alias("k"), (F.col("bc") * size + F.col("p") % size).cast("long").alias("c"), "v")


def block_payloads(m: Matrix, size: int) -> DataFrame:
    """Entries as dense square blocks: br, bc, vals (row-major, zero where empty)."""
    cells = m.df.groupBy(div(F.col("k"), size).alias("br"), div(F.col("c"), size).alias("bc"), ((F.col("k") % size) * size + F.col("c") % size).cast("int").alias("p")).agg(F.sum("v").alias("v"))
    held = cells.groupBy("br", "bc").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    return held.select("br", "bc", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0))).alias("vals"))


def tiles(dense: DataFrame, nb: int, inner: int, cb: int) -> DataFrame:
    """The tile numbers of a dense relation (n, c, x): an index for partitioning."""
    if nb % inner:
        raise ShapeError(f"tiles of {nb} rows are not whole tiles of {inner}")
    n, c = F.col("n"), F.col("c")
    return dense.select("n", "c", "x", div(n, nb).alias("tn"), div(c, cb).alias("tc"), div(n % nb, inner).alias("ti"), (c % cb).cast("long").alias("lc"), (n % inner).cast("long").alias("ln"))


def symmetric(entries: DataFrame) -> DataFrame:
    """Entries and their mirror images; the diagonal once.  One pass."""
    pair = F.when(F.col("k") != F.col("c"), F.array(F.struct("k", "c", "v"), F.struct(F.col("c").alias("k"), F.col("k").alias("c"), "v"))).otherwise(F.array(F.struct("k", "c", "v")))
    return entries.select(F.inline(pair))


def rebased(entries: DataFrame) -> DataFrame:
    """Indices from 0: one is taken off all, unless some index is 0 already."""
    low = entries.agg(F.min(F.least("k", "c")).alias("low"))
    return entries.crossJoin(F.broadcast(low)).select((F.col("k") - F.least("low", F.lit(1))).alias("k"), (F.col("c") - F.least("low", F.lit(1))).alias("c"), "v")
