"""Products of sparse and dense matrices.

Dense relations are (n, c, x) or (n, k, g), one row a cell, or vectors
(n, x array).  Sums of products are exact for whole numbers and made in double
for floats and decimals.  All forms give the same rows, by one rule:

* every vector gives rows of its own, also where its ``n`` is null or repeats;
* a null element of a vector and a null value of an entry count as 0; entries that
  repeat are summed; only stored entries are multiplied;
* a vector of another length (or a null one), and an entry whose place is null or
  outside the shape, are errors;
* in an update, vectors of one ``n`` are summed, and a null ``n`` meets nothing.

``vector``      the sparse rows are broadcast (their number is counted first) and
                each dense vector is multiplied where it lies: no shuffle.
``coordinate``  equi-joins on the inner index and a grouped sum.
``blocked``     Arrow batches of vectors times a sparse side that was collected:
                few entries only.
``tiled``       for sides of any size: the sparse side is cut to blocks of rows and
                columns, and these to parts of about equally many entries; a grid of
                parts and of groups of vectors is what tasks work on.  Updates
                always take this form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix, ShapeError
from ..plans.strategy import BLOCKED_ROWS, BROADCAST_ROWS, CELL_BYTES, PART_ENTRIES, STEP_BYTES, small
from ..plans.work import size_of, written
from .layout import axis, csr_rows, div
from .ranks import ranked


def number_kind(*types: str) -> str:
    """In what products are made: long if all are whole numbers, else double (decimals too)."""
    plain = [t.removeprefix("array<").removesuffix(">") for t in types]
    return "long" if all(t in ("tinyint", "smallint", "int", "bigint") for t in plain) else "double"


def wide(x: Column, kind: str) -> Column:
    """Values are widened before they are multiplied."""
    return x.cast(kind)


def kinds(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def stored(w: Matrix, kind: str) -> DataFrame:
    """The entries, checked: k, c, v."""
    inside = F.col("k").between(0, w.rows - 1) & F.col("c").between(0, w.cols - 1)
    wrong = F.raise_error(F.lit(f"ShapeError: an entry is null or outside {w.rows} x {w.cols}"))
    checked = [F.when(inside, F.col(x)).otherwise(wrong.cast("long")).cast("long").alias(x) for x in ("k", "c")]  # both, since a join tests one alone
    return w.df.select(*checked, F.coalesce(wide(F.col("v"), kind), F.lit(0).cast(kind)).alias("v"))


def of_length(inputs: DataFrame, length: int, value: str = "x", kind: str | None = None) -> DataFrame:
    """(n, x), where a vector of another length (or a null one) is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"ShapeError: a vector is to have {length} values, not "), F.coalesce(F.size(value), F.lit(-1)).cast("string")))
    whole = F.when(F.size(value) == length, F.col(value)).otherwise(wrong.cast(kinds(inputs)[value]))
    return inputs.select("n", (whole.cast(f"array<{kind}>") if kind else whole).alias(value))


def as_matrix(column: pa.ListArray, width: int, dtype: type) -> np.ndarray:
    """Vectors of one length as the rows of an array; null elements are 0."""
    return column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def dense_vectors(cells: DataFrame, place: str, value: str, length: int, kind: str) -> DataFrame:
    """Cells (n, place, value) as (n, value array): repeated cells are summed, and those that are not there are 0."""
    held = cells.groupBy("n").agg(F.collect_list(F.struct(F.col(place).cast("long").alias("p"), wide(F.col(value), kind).alias("v"))).alias("e"))
    dtype = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, STEP_BYTES // (8 * length))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                e = part.column(1)
                row, p, v = e.value_parent_indices().to_numpy(), e.flatten().field("p"), e.flatten().field("v")
                if p.null_count or len(p) and (pc.min(p).as_py() < 0 or pc.max(p).as_py() >= length):
                    raise ShapeError(f"ShapeError: a cell is outside {length} places")
                out = np.zeros((part.num_rows, length), dtype)
                np.add.at(out, (row, p.to_numpy()), v.fill_null(0).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), length).cast(pa.list_(pa.from_numpy_dtype(dtype)))], names=["n", value])

    return held.mapInArrow(run, f"n {kinds(cells)['n']}, {value} array<{kind}>")


def dot(cols: Column, vals: Column, x: Column, kind: str) -> Column:
    zero = F.lit(0).cast(kind)
    return F.aggregate(F.zip_with(cols, vals, lambda c, v: v * F.coalesce(x[c.cast("int")], zero)), zero, lambda a, b: a + b)


def forward(w: Matrix, inputs: DataFrame, strategy: str | None = None) -> DataFrame:
    """o[n, k] = sum over c of x[n, c] * v[k, c], for every vector of the inputs and every k.

    ``inputs``: (n, x array) with an element for each column of w; other lengths
    are an error.  Without a strategy the sparse side is read once: if it has few
    entries the blocked form takes it, else the tiled form.
    """
    kind = number_kind(kinds(w.df)["v"], kinds(inputs)["x"])
    entries, zero = stored(w, kind), F.lit(0).cast(kind)
    if strategy in (None, "blocked"):
        held = entries.limit(BROADCAST_ROWS + 1).toPandas() if w.rows <= BLOCKED_ROWS else None
        if held is not None and len(held) <= BROADCAST_ROWS:
            return blocked(held, w.rows, of_length(inputs, w.cols, kind=kind), kind)
        if strategy:
            raise ShapeError(f"a blocked product takes at most {BROADCAST_ROWS} entries and {BLOCKED_ROWS} rows; use the tiled form")
        strategy = "tiled"
    if strategy == "vector":
        rows = axis(w.df, w.rows, "k").join(csr_rows(Matrix(entries, w.rows, w.cols)), "k", "left")
        pairs = of_length(inputs, w.cols, kind=kind).crossJoin(small(rows))  # the result has a row for each pair
        return pairs.select("n", "k", F.coalesce(dot(F.col("cols"), F.col("vals"), F.col("x"), kind), zero).alias("o"))
    if strategy == "coordinate":
        # One more place, which every row has with a 0, gives the rows that no entry gives.
        more = of_length(inputs, w.cols, kind=kind).withColumn("__i", F.monotonically_increasing_id())
        more = more.select("n", "__i", F.posexplode(F.concat("x", F.array(zero))).alias("c", "x"))
        ends = axis(w.df, w.rows, "k").select("k", F.lit(w.cols).cast("long").alias("c"), zero.alias("v"))
        sums = entries.unionByName(ends).join(more, "c").groupBy("__i", "n", "k").agg(F.sum(F.col("v") * F.coalesce("x", zero)).alias("o"))
        return sums.select("n", "k", "o")
    if strategy == "tiled":
        return tiled(w, inputs, kind)
    raise ValueError(f"no kernel named {strategy}")


def times(x: np.ndarray, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each vector the sums, from each start to the next, of its elements times the values."""
    return np.add.reduceat(x[:, places] * values, starts, axis=1) if len(values) else np.zeros((len(x), 0), x.dtype)


def blocked(entries, n_rows: int, inputs: DataFrame, kind: str) -> DataFrame:
    """Steps of vectors times the whole sparse side, which was collected; a step's arrays have bounded bytes."""
    order = np.argsort(entries["k"].to_numpy(), kind="stable")
    dtype = np.float64 if kind == "double" else np.int64
    k, c, v = (entries[x].to_numpy()[order].astype(t) for x, t in (("k", np.int64), ("c", np.int64), ("v", dtype)))
    rows, starts = np.unique(k, return_index=True)
    step = max(1, STEP_BYTES // (8 * max(n_rows, len(v), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = np.zeros((part.num_rows, n_rows), dtype)
                if len(v):
                    x = part.column(1)
                    out[:, rows] = times(as_matrix(x, len(x[0]), dtype), c, v, starts)
                yield cells_of(part.column(0), np.arange(n_rows), out)

    return inputs.select(F.col("n").cast("long").alias("n"), "x").mapInArrow(run, f"n long, k long, o {kind}")


def cells_of(n: pa.Array, k: np.ndarray, out: np.ndarray, *more: tuple[str, pa.Array]) -> pa.RecordBatch:
    """Rows (n, k, o) of a dense piece, with what else stands beside each n."""
    each = pa.array(np.repeat(np.arange(len(n)), len(k)))
    return pa.RecordBatch.from_arrays([n.take(each), pa.array(np.tile(k, len(n)), pa.int64()), pa.array(out.ravel()), *[x.take(each) for _, x in more]], names=["n", "k", "o", *[name for name, _ in more]])


# Parts and the grid


def row_parts(entries: DataFrame, rows: int, kb: int, cb: int, most: int) -> DataFrame:
    """Parts of a sparse side for products with vectors: s, b, q, piece, partial, and arrays k, c, v.

    A strip ``s`` has ``cb`` columns and a block ``b`` has ``kb`` rows.  In them a part
    takes the rows that begin among so many entries: at most twice ``most`` entries.
    Only a row that has more is cut by itself, and its pieces give partial sums.
    Rows without entries are parts of their own, one for each block.
    """
    strip = div("c", cb)
    keyed = entries.select((strip * rows + F.col("k")).alias("key"), (F.col("c") % cb).cast("int").alias("c"), "v")
    placed = ranked(keyed, ["key", "c"], group="key", inside="at", size="n")
    crowded = F.col("n") > most
    k, none = F.col("key") % rows, F.lit(-1).cast("long")
    found = placed.select(
        div("key", rows).alias("s"), div(k, kb).alias("b"), F.when(crowded, F.col("key")).otherwise(div(F.col("pos") - F.col("at"), most)).alias("q"),
        F.when(crowded, div("at", most)).otherwise(none).alias("piece"), F.struct(k.alias("k"), "c", "v").alias("e"),
    )
    parts = found.groupBy("s", "b", "q", "piece").agg(F.collect_list("e").alias("e"))
    parts = parts.select("s", "b", "q", "piece", F.col("e.k").alias("k"), F.col("e.c").alias("c"), F.col("e.v").alias("v"))
    empty = axis(entries, rows, "k").join(entries.select("k").distinct(), "k", "left_anti").groupBy(div("k", kb).alias("b")).agg(F.collect_list("k").alias("k"))
    nothing = [F.array().cast(kinds(parts)[x]).alias(x) for x in ("c", "v")]
    return parts.unionByName(empty.select(F.lit(0).cast("long").alias("s"), "b", none.alias("q"), none.alias("piece"), "k", *nothing))


def in_grid(parts: DataFrame, vectors: DataFrame, keys: list[str], groups: int, made: dict[str, Column]) -> DataFrame:
    """Rows of the cells of a grid: a part first, then the vectors of one of its groups.

    Each part goes to all groups and each vector to all parts, so the cells, parts
    times groups of them, are what is dealt to tasks, and a task holds one part at a
    time.  ``made``: what a part needs of a vector.
    """
    group = F.pmod(F.xxhash64(*vectors.columns), F.lit(groups)).alias("__r")
    names = parts.select(*keys)
    pairs = vectors.crossJoin(F.broadcast(names) if size_of(names) <= CELL_BYTES else names)
    dealt = pairs.select(*keys, group, F.lit(True).alias("__vector"), *[v.alias(n) for n, v in made.items()])
    whole = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("__r"), F.lit(False).alias("__vector"))
    cells = whole.unionByName(dealt, allowMissingColumns=True)
    return cells.repartition(*keys, "__r").sortWithinPartitions(*keys, "__r", "__vector")


def groups_for(vectors: DataFrame, width: int, parts: int) -> int:
    """Groups of vectors: of bounded bytes each, and so many that all tasks of the session have cells."""
    n = vectors.count()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(n, max(-(-n * width * 8 // CELL_BYTES), -(-tasks // max(parts, 1)))))


def cell_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, tuple, pa.RecordBatch]]:
    """Runs of rows of one cell and kind: whether they are vectors, the cell, and the rows; a part is one row."""
    for batch in batches:
        names = [*keys, "__r", "__vector"]
        columns = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
        vector = columns[-1].astype(bool)
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows:
            new[1:] = ~vector[1:] | np.any([x[1:] != x[:-1] for x in columns], axis=0)
        bounds = [*np.flatnonzero(new), batch.num_rows]
        for low, high in zip(bounds, bounds[1:]):
            yield bool(vector[low]), tuple(int(x[low]) for x in columns[:-1]), batch.slice(low, high - low)


def array_at(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name)[0].values.to_numpy(zero_copy_only=False)


def tiled(w: Matrix, inputs: DataFrame, kind: str, kb: int = 1 << 20, cb: int = 1 << 16, nb: int = 1 << 16, most: int = PART_ENTRIES) -> DataFrame:
    """The product on a grid of parts of the sparse side and groups of vectors.

    ``kb`` rows and ``cb`` columns at most are in a block, about ``most`` entries in a
    part, and ``nb`` vectors are multiplied at once.  What a part gives is final, but
    for rows that are cut and for more strips of columns than one: there partial sums
    are added.
    """
    cb = min(cb, w.cols)
    strips, dtype = -(-w.cols // cb), np.float64 if kind == "double" else np.int64
    keys = ["s", "b", "q", "piece"]
    parts = written(row_parts(stored(w, kind), w.rows, kb, cb, most), "product-parts")
    vectors = of_length(inputs, w.cols, kind=kind).select(F.col("n").cast("long").alias("n"), "x")
    partial = (F.col("piece") >= 0) | ((F.size("v") > 0) & F.lit(strips > 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = places = values = starts = None
        for vector, cell, batch in cell_runs(batches, keys):
            if not vector:
                k, places, values = (array_at(batch, x) for x in ("k", "c", "v"))
                if len(values):
                    order = np.argsort(k, kind="stable")
                    rows, starts = np.unique(k[order], return_index=True)
                    places, values = places[order], values[order]
                else:
                    rows = k
                continue
            width = min(cb, w_cols - cell[0] * cb)
            step = min(nb, max(1, STEP_BYTES // (8 * max(len(rows), len(values), width))))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                x = as_matrix(some.column("x"), width, dtype)
                out = times(x, places, values, starts) if len(values) else np.zeros((len(x), len(rows)), dtype)
                yield cells_of(some.column("n"), rows, out, ("__i", some.column("__i")))

    w_cols = w.cols

    def product(chosen: DataFrame, count: int) -> DataFrame:
        groups = groups_for(vectors, cb, count)
        own = vectors.withColumn("__i", F.monotonically_increasing_id())
        x = F.slice("x", F.col("s") * cb + 1, cb) if strips > 1 else F.col("x")
        cells = in_grid(chosen.drop("partial"), own, keys, groups, {"__i": F.col("__i"), "n": F.col("n"), "x": x})
        return cells.mapInArrow(run, f"n long, k long, o {kind}, __i long")

    sizes = {r["p"]: r["count"] for r in parts.groupBy(partial.alias("p")).count().collect()}
    found = []
    if sizes.get(False):
        found.append(product(parts.where(~partial), sizes[False]).select("n", "k", "o"))
    if sizes.get(True):
        sums = product(parts.where(partial), sizes[True]).groupBy("__i", "n", "k").agg(F.sum("o").alias("o"))
        found.append(sums.select("n", "k", "o"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def backward(w: Matrix, grads: DataFrame, strategy: str | None = None) -> DataFrame:
    """d[n, c] = sum over k of g[n, k] * v[k, c]: the forward product of the transposed matrix."""
    out = forward(w.transposed(), grads, strategy)
    return out.select("n", F.col("k").alias("c"), F.col("o").alias("d"))


def update(w: Matrix, inputs: DataFrame, grads: DataFrame, kb: int = 1 << 14, cb: int = 1 << 14, nb: int = 1 << 16, most: int = PART_ENTRIES, strategy: str | None = None) -> DataFrame:
    """dv[k, c] = sum over n of x[n, c] * g[n, k], for every stored entry of w.

    ``inputs`` and ``grads``: cells (n, c, x) and (n, k, g); see ``update_vectors``.
    """
    kind = number_kind(kinds(inputs)["x"], kinds(grads)["g"])
    x, g = dense_vectors(inputs, "c", "x", w.cols, kind), dense_vectors(grads, "k", "g", w.rows, kind)
    return update_vectors(w, x, g, kb, cb, nb, most, strategy)


def entry_parts(places: DataFrame, cols: int, kb: int, cb: int, most: int) -> DataFrame:
    """Parts of different places (k, c): b, s, piece, and arrays k, c of places in the block, ``most`` at most."""
    strips = -(-cols // cb)
    keyed = places.select((div("k", kb) * strips + div("c", cb)).alias("block"), (F.col("k") % kb).cast("int").alias("k"), (F.col("c") % cb).cast("int").alias("c"))
    placed = ranked(keyed, ["block", "k", "c"], group="block", inside="at", size="n")
    held = placed.groupBy("block", div("at", most).alias("piece")).agg(F.collect_list(F.struct("k", "c")).alias("e"))
    return held.select(div("block", strips).alias("b"), (F.col("block") % strips).alias("s"), "piece", F.col("e.k").alias("k"), F.col("e.c").alias("c"))


def update_vectors(w: Matrix, inputs: DataFrame, grads: DataFrame, kb: int = 1 << 14, cb: int = 1 << 14, nb: int = 1 << 16, most: int = PART_ENTRIES, strategy: str | None = None) -> DataFrame:
    """The same from vectors (n, x array) and (n, g array), of the lengths that w has.

    Inputs meet gradients by ``n``.  ``held``: up to ``most`` stored entries are collected,
    and each task gives one sum for each of them.  ``grid``: the stored entries are cut
    to blocks of ``kb`` rows and ``cb`` columns, and these to parts of ``most`` entries; a
    cell of the grid, a part and a group of vectors, of which it gets what lies in its
    block, gives one sum for each entry of the part.  Without a strategy the entries are
    read once, and held if they are few.
    """
    kind = number_kind(kinds(inputs)["x"], kinds(grads)["g"])
    kb, cb, dtype = min(kb, w.rows), min(cb, w.cols), np.float64 if kind == "double" else np.int64
    keys, shape = ["b", "s", "piece"], (w.rows, w.cols)
    both = of_length(inputs, w.cols, "x", kind).join(of_length(grads, w.rows, "g", kind), "n").select("x", "g")
    places = stored(Matrix(w.df.select("k", "c", F.lit(0).alias("v")), w.rows, w.cols), "long").select("k", "c").distinct()
    stored_sums = lambda sums: w.df.select("k", "c").join(sums, ["k", "c"], "left").select("k", "c", F.coalesce("dv", F.lit(0).cast(kind)).alias("dv"))
    if strategy not in (None, "held", "grid"):
        raise ValueError(f"no kernel named {strategy}")
    if strategy != "grid":
        few = places.limit(most + 1).toPandas()
        if len(few) <= most:
            return stored_sums(held_sums(both, few["k"].to_numpy(np.int64), few["c"].to_numpy(np.int64), shape, kind))
        if strategy:
            raise ShapeError(f"a structure of more than {most} entries is not held; use the grid")
    parts = written(entry_parts(places, w.cols, kb, cb, most), "update-parts")
    count = parts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = c = sums = cell = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k + cell[0] * kb, pa.int64()), pa.array(c + cell[1] * cb, pa.int64()), pa.array(sums)], names=["k", "c", "p"])

        for vector, now, batch in cell_runs(batches, keys):
            if not vector:
                if cell is not None:
                    yield made()
                cell, k, c = now, array_at(batch, "k").astype(np.int64), array_at(batch, "c").astype(np.int64)
                sums = np.zeros(len(k), dtype)
                continue
            high, wide_ = min(kb, shape[0] - cell[0] * kb), min(cb, shape[1] - cell[1] * cb)
            step = min(nb, max(1, STEP_BYTES // (8 * max(len(k), high, wide_))))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                sums += np.einsum("ne,ne->e", as_matrix(some.column("x"), wide_, dtype)[:, c], as_matrix(some.column("g"), high, dtype)[:, k])
        if cell is not None:
            yield made()

    cut = lambda name, key, size, whole: F.slice(name, F.col(key) * size + 1, size) if size < whole else F.col(name)
    cells = in_grid(parts, both, keys, groups_for(inputs, kb + cb, count), {"x": cut("x", "s", cb, w.cols), "g": cut("g", "b", kb, w.rows)})
    return stored_sums(cells.mapInArrow(run, f"k long, c long, p {kind}").groupBy("k", "c").agg(F.sum("p").alias("dv")))


def held_sums(both: DataFrame, k: np.ndarray, c: np.ndarray, shape: tuple[int, int], kind: str) -> DataFrame:
    """k, c, dv from vectors x and g that have met: each task sums its own for all of the entries."""
    dtype = np.float64 if kind == "double" else np.int64
    step = max(1, STEP_BYTES // (8 * max(len(k), *shape)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(k), dtype), 0
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                sums += np.einsum("ne,ne->e", as_matrix(some.column("x"), shape[1], dtype)[:, c], as_matrix(some.column("g"), shape[0], dtype)[:, k])
                n += some.num_rows
        if n and len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(sums)], names=["k", "c", "p"])

    return both.mapInArrow(run, f"k long, c long, p {kind}").groupBy("k", "c").agg(F.sum("p").alias("dv"))


def blocked_update(w: Matrix, inputs: DataFrame, grads: DataFrame, kb: int, cb: int, nb: int) -> DataFrame:
    """The update by blocks of the given sizes."""
    return update(w, inputs, grads, kb, cb, nb, strategy="grid")


def gemv(a: DataFrame, x: DataFrame, cols: int) -> DataFrame:
    """y[n] = sum of a[n, c] * x[c] for vectors (n, x array); ``x``: (c, x), places that it lacks are 0.

    A right side of few places goes to the vectors as one array; more are joined.
    """
    kind = number_kind(kinds(a)["x"], kinds(x)["x"])
    zero, a = F.lit(0).cast(kind), of_length(a, cols, kind=kind)
    right = x.select(F.col("c").cast("long").alias("c"), F.coalesce(wide(F.col("x"), kind), zero).alias("w"))
    if cols <= BROADCAST_ROWS:
        one = dense_vectors(right.withColumn("n", F.lit(0)), "c", "w", cols, kind).select("w")
        whole = axis(x, 1, "__one").join(F.broadcast(one), how="left").select(F.coalesce("w", F.array_repeat(zero, cols)).alias("w"))
        met = a.crossJoin(F.broadcast(whole))
        return met.select("n", F.aggregate(F.zip_with("x", "w", lambda p, q: F.coalesce(p, zero) * q), zero, lambda p, q: p + q).alias("y"))
    cells = a.withColumn("__i", F.monotonically_increasing_id()).select("n", "__i", F.posexplode("x").alias("c", "x"))
    met = cells.join(right, "c", "left").groupBy("__i", "n").agg(F.sum(F.coalesce("x", zero) * F.coalesce("w", zero)).alias("y"))
    return met.select("n", "y")


#: The type of whole products that a long does not hold.
WHOLE = "decimal(38,0)"


def fits_long(a: DataFrame, b: DataFrame, alpha: float | int, beta: float | int, c: DataFrame | None) -> bool:
    """Whether no sum of a product can leave the range of a long: the greatest row of a times the greatest value of b bounds it."""

    def greatest_row(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("i").agg(F.sum(F.abs(F.col("v").cast("double"))).alias("v")).agg(F.max("v").alias(name))

    found = greatest_row(a, "a").crossJoin(b.agg(F.max(F.abs(F.col("v").cast("double"))).alias("b")))
    found = (found if c is None else found.crossJoin(greatest_row(c, "c"))).first().asDict()
    held = {k: v or 0.0 for k, v in found.items()}
    return held["a"] * held["b"] * max(1.0, abs(alpha)) + held.get("c", 0.0) * abs(beta) < 2.0**62  # half of it, since doubles are rounded


def gemm(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False, alpha: float | int = 1, beta: float | int = 0, c: DataFrame | None = None, shapes: tuple[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """alpha * op(a) op(b) + beta * c over cells (i, j, v); a transpose is a choice of columns.

    ``shapes`` of a and b, where they are known, have to fit.  Whole numbers give
    longs; where their sums could be too large for that (sides are read once to tell),
    the result is a decimal of 38 digits, which is exact too.
    """
    if shapes and (shapes[0][0] if transpose_a else shapes[0][1]) != (shapes[1][1] if transpose_b else shapes[1][0]):
        raise ShapeError(f"a product of {shapes[0]} and {shapes[1]}")
    c = c if beta else None
    types = [kinds(x)["v"] for x in (a, b, c) if x is not None]
    kind = number_kind(*("bigint" if t == WHOLE else t for t in types[:2]))
    left = a.select(F.col("j" if transpose_a else "i").alias("i"), F.col("i" if transpose_a else "j").alias("p"), "v")
    right = b.select(F.col("j" if transpose_b else "i").alias("p"), F.col("i" if transpose_b else "j").alias("j"), "v")
    if kind == "long" and (WHOLE in types or not fits_long(left, right, alpha, beta, c)):
        kind = WHOLE

    def scaled(x: Column, by: float | int) -> Column:
        return (x.cast(WHOLE) * by).cast(WHOLE) if kind == WHOLE and isinstance(by, int) else x * by

    pairs = left.select("i", "p", wide(F.col("v"), kind).alias("a")).join(right.select("p", "j", wide(F.col("v"), kind).alias("b")), "p")
    out = pairs.groupBy("i", "j").agg(scaled(F.sum(F.col("a") * F.col("b")), alpha).alias("v"))
    if c is None:
        return out
    whole = types[2] == WHOLE or number_kind(types[2]) == "long"
    kept = c.select("i", "j", (scaled(F.col("v"), beta) if whole else F.col("v") * beta).alias("v"))
    return out.unionByName(kept).groupBy("i", "j").agg(F.sum("v").alias("v"))


def spmv(w: Matrix, x: DataFrame) -> DataFrame:
    """y[k] = sum of v * x[c]; ``x``: (c, x), each c in the matrix.  Every k has a row."""
    n, low, high = x.agg(F.count(F.lit(1)), F.min("c"), F.max("c")).first()
    if n and (low < 0 or high >= w.cols):
        raise ShapeError(f"places {low} to {high} of {w.cols} columns")
    kind = number_kind(kinds(w.df)["v"], kinds(x)["x"])
    other = F.broadcast(x) if n <= BROADCAST_ROWS else x
    sums = w.df.join(other, "c").groupBy("k").agg(F.sum(wide(F.col("v"), kind) * wide(F.col("x"), kind)).alias("y"))
    return axis(w.df, w.rows, "k").join(sums, "k", "left").select("k", F.coalesce("y", F.lit(0).cast(kind)).alias("y"))
