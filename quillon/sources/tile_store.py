"""Dense vectors kept as tiles, in tables that stay dealt by tile.

A tile is ``nb`` consecutive n: a row tn with its vectors in order.  Tables are
bucketed by tn, so products of two of them meet without being dealt out again:
every product of a training step reads the buckets where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix, ShapeError
from ..operators.kernels import as_matrix, blocked, held_sums, kinds, number_kind, of_length, stored
from ..operators.layout import div
from ..plans.strategy import BLOCKED_ROWS, BROADCAST_ROWS, PART_ENTRIES


@dataclass(frozen=True)
class Tiles:
    """A stored table of tiles: tn, and e, the vectors (n, x) of the tile by n."""

    table: str
    width: int
    nb: int
    buckets: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)

    def vectors(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).select(F.inline("e"))


def store(vectors: DataFrame, table: str, width: int, nb: int = 64, buckets: int = 64) -> Tiles:
    """Write (n, x array of ``width``) as tiles; a null n is an error, since it is in none."""
    whole = of_length(vectors, width).select(F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.raise_error(F.lit("ShapeError: a vector without n")).cast("long")).cast("long").alias("n"), "x")
    tiles = whole.groupBy(div("n", nb).alias("tn")).agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("e"))
    tiles.repartition(buckets, "tn").write.bucketBy(buckets, "tn").sortBy("tn").format("parquet").mode("errorifexists").saveAsTable(table)
    return Tiles(table, width, nb, buckets)


def forward(w: Matrix, inputs: Tiles) -> DataFrame:
    """The forward product of a sparse side of few entries, tile by tile where they lie."""
    spark = w.df.sparkSession
    vectors = inputs.vectors(spark)
    kind = number_kind(kinds(w.df)["v"], kinds(vectors)["x"])
    entries = stored(w, kind).limit(BROADCAST_ROWS + 1).toPandas()
    if inputs.width != w.cols or len(entries) > BROADCAST_ROWS or w.rows > BLOCKED_ROWS:
        raise ShapeError(f"tiles of {inputs.width} places, {len(entries)} entries of {w.rows} x {w.cols}")
    return blocked(entries, w.rows, vectors.select("n", F.col("x").cast(f"array<{kind}>").alias("x")), kind)


def update(w: Matrix, inputs: Tiles, grads: Tiles) -> DataFrame:
    """dv[k, c] for every stored entry, from two stored tables that were cut alike: no exchange of either."""
    if (inputs.nb, inputs.buckets) != (grads.nb, grads.buckets) or (inputs.width, grads.width) != (w.cols, w.rows):
        raise ShapeError(f"{inputs} and {grads} do not fit {w.rows} x {w.cols}")
    spark = w.df.sparkSession
    x, g = inputs.rows(spark).select("tn", F.col("e").alias("a")), grads.rows(spark).select("tn", F.col("e").alias("b"))
    kind = number_kind(kinds(inputs.vectors(spark))["x"], kinds(grads.vectors(spark))["x"])
    places = stored(Matrix(w.df.select("k", "c", F.lit(0).alias("v")), w.rows, w.cols), "long").select("k", "c").distinct().limit(PART_ENTRIES + 1).toPandas()
    if len(places) > PART_ENTRIES:
        raise ShapeError(f"more than {PART_ENTRIES} entries")
    dtype, wide, high = np.float64 if kind == "double" else np.int64, w.cols, w.rows

    def side(cell: pa.ListScalar, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The n of a tile, and the sums of the vectors of each."""
        n, first = np.unique(cell.values.field("n").to_numpy(), return_index=True)
        return n, np.add.reduceat(as_matrix(cell.values.field("x"), width, dtype), first, axis=0)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                (n, xs), (m, gs) = side(a, wide), side(b, high)
                _, i, j = np.intersect1d(n, m, assume_unique=True, return_indices=True)
                if len(i):
                    as_list = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.from_numpy_dtype(dtype)))
                    yield pa.RecordBatch.from_arrays([as_list(xs[i]), as_list(gs[j])], names=["x", "g"])

    both = x.join(g, "tn").select("a", "b").mapInArrow(met, f"x array<{kind}>, g array<{kind}>")
    sums = held_sums(both, places["k"].to_numpy(np.int64), places["c"].to_numpy(np.int64), (high, wide), kind)
    return w.df.select("k", "c").join(sums, ["k", "c"], "left").select("k", "c", F.coalesce("dv", F.lit(0).cast(kind)).alias("dv"))
