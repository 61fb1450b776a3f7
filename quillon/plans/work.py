"""Tables that cut a plan: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master gets a folder where none is set, any other is refused."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillon-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of the plan as the optimizer knows them; very large where it does not."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read_size(df: DataFrame) -> int:
    """Bytes of the tables that the plan reads, if these are known to be less than ``size_of``, which multiplies the sides of a join."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return min(size_of(df), sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())))


def partitions_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions of about ``each`` bytes of what is read; those of the session where the size is not known.

    A range sort sends a sample to the driver for each partition, so their number is to grow as the input does.
    """
    size, least = read_size(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size > 1 << 53 else max(least, min(1_000_000, -(-size // each)))
