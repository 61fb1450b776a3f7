"""Errors, sparsity, operation counts, timing summaries, and the best of a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import floor_div


def errors(expected: DataFrame, actual: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """rel_l2 (absolute if all expected are 0) and max_abs; a cell that one side lacks is 0 there."""
    e, a = expected.select(*keys, F.col(value).alias("e")), actual.select(*keys, F.col(value).alias("a"))
    both = e.join(a, keys, "full").select(F.coalesce("e", F.lit(0)).cast("double").alias("e"), F.coalesce("a", F.lit(0)).cast("double").alias("a"))
    sums = both.agg(F.sum((F.col("e") - F.col("a")) ** 2).alias("d"), F.sum(F.col("e") ** 2).alias("s"), F.max(F.abs(F.col("e") - F.col("a"))).alias("max_abs"))
    return sums.select(F.sqrt(F.when(F.col("s") > 0, F.col("d") / F.col("s")).otherwise(F.col("d"))).alias("rel_l2"), "max_abs")


def close(expected: DataFrame, actual: DataFrame, keys: list[str], value: str = "v", tolerance: float = 1e-5) -> bool:
    """Whether the relative error is within the tolerance; NaN is not."""
    error = errors(expected, actual, keys, value).first()[0]
    return error is None or error <= tolerance


def sparsity(df: DataFrame, rows: int, cols: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("nnz")).select("nnz", ((1 - F.col("nnz") / (float(rows) * float(cols))) * 100).alias("sparsity"))


def profile(log: DataFrame) -> DataFrame:
    """Calls, total, average, greatest, least and rate of each label, and a Total row.

    ``log``: label, elapsed, ops.  The Total row adds the labels' columns, so its
    greatest is a sum of greatest times.  A label without ops has no rate.
    """
    per = log.groupBy("label").agg(F.count(F.lit(1)).alias("calls"), F.sum("elapsed").alias("total"), F.max("elapsed").alias("most"), F.min("elapsed").alias("least"), F.sum("ops").alias("ops"))
    all_ = per.agg(F.lit("Total").alias("label"), F.sum("calls").alias("calls"), F.sum("total").alias("total"), F.sum("most").alias("most"), F.sum("least").alias("least"), F.sum("ops").alias("ops"))
    both = per.unionByName(all_)
    return both.select("label", "calls", "total", (F.col("total") / F.col("calls")).alias("average"), "most", "least", F.when((F.col("ops") > 0) & (F.col("total") > 0), F.col("ops") / F.col("total")).alias("rate"))


def listing(log: DataFrame) -> DataFrame:
    """The rows of ``profile`` as they are printed: by label, the Total row last."""
    rows = profile(log).withColumn("__last", F.col("label") == "Total")
    return rows.orderBy("__last", "label").drop("__last")


def paired(events: DataFrame, span: int = 3_600_000_000) -> DataFrame:
    """Elapsed times from begin and end rows (label, at, kind): an end pairs with the begin before it.

    Labels whose begins and ends differ in number are marked.  Each label's time is
    cut into ranges of ``span``, paired by themselves; what a range begins with
    looks back to the last row of the range before it that has rows.
    """
    rows = events.select("label", "at", "kind", floor_div(F.col("at"), span).alias("__r"))
    ranges = rows.groupBy("label", "__r").agg(F.max(F.struct("at", "kind")).alias("last"), F.sum(F.when(F.col("kind") == "begin", 1).otherwise(-1)).alias("open"))
    over = Window.partitionBy("label").orderBy("__r")
    ranges = ranges.select("label", "__r", F.lag("last").over(over).alias("__before"), (F.sum("open").over(Window.partitionBy("label")) == 0).alias("balanced"))
    inside = Window.partitionBy("label", "__r").orderBy("at", "kind")
    marked = rows.withColumn("__own", F.lag(F.struct("at", "kind")).over(inside)).join(ranges, ["label", "__r"])
    marked = marked.withColumn("__b", F.coalesce("__own", "__before"))
    return marked.where("kind = 'end' and __b.kind = 'begin'").select("label", (F.col("at") - F.col("__b.at")).alias("elapsed"), "balanced")


def operations(rows: int, cols: int, batch: int, nnz: int) -> dict[str, int]:
    """Operations credited to a product: as if dense, and those that entries need."""
    return {"dense_ops": 2 * batch * rows * cols, "sparse_ops": 2 * nnz * batch}


def best(sweep: DataFrame) -> DataFrame:
    """The best whole rate of each kernel, file and batch, and the settings that gave it."""
    return sweep.groupBy("file", "batch", "kernel").agg(F.max(F.floor("gops")).cast("long").alias("gops"), F.max_by("config", F.struct("gops", "config")).alias("config"))


def grid(spark, axes: dict[str, list[int]], skip: str | None = None) -> DataFrame:
    """Every combination of settings but those to skip."""
    out = spark.range(1, numPartitions=1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.lit(values)).alias(name))
    return out.where(f"not ({skip})") if skip else out
