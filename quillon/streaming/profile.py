"""The timing summary of a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_profile(log: DataFrame) -> DataFrame:
    """Calls, total, greatest and least elapsed time of each label so far (update or complete mode)."""
    return log.groupBy("label").agg(F.count(F.lit(1)).alias("calls"), F.sum("elapsed").alias("total"), F.max("elapsed").alias("most"), F.min("elapsed").alias("least"))


def windowed_profile(log: DataFrame, at: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """The same for each window of time; rows later than ``late`` are not waited for."""
    return log.withWatermark(at, late).groupBy(F.window(at, window), "label").agg(F.count(F.lit(1)).alias("calls"), F.sum("elapsed").alias("total"))
