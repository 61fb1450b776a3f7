"""Helpers that the corpus operators share: tables, shared work folder, joins."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its files have at most so many bytes, and its counted rows are at most so many.
BROADCAST_BYTES, BROADCAST_ROWS = 48 << 20, 1_000_000
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master gets one; on a cluster no folder
    of one machine would do, so that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillon-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


class Folders(threading.local):
    """Work folders that a thread of this driver has made, until they are released; another thread's are another run's."""

    def __init__(self):
        self.paths: list[str] = []

    def __getitem__(self, at: int) -> str:
        return self.paths[at]


_made = Folders()


def work_path(spark: SparkSession, label: str) -> str:
    _made.paths.append(f"{work_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _made.paths[-1]


def made() -> int:
    """How many work folders this thread has made; those made after can be released."""
    return len(_made.paths)


def release(spark: SparkSession, since: int, keep: str | None = None) -> None:
    """Remove work folders, made since then, that no table is read from any more."""
    paths, conf = _made.paths[since:], spark.sparkContext._jsc.hadoopConfiguration()
    del _made.paths[since:]
    for path in paths:
        if path == keep:
            _made.paths.append(path)
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut there."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already written) with a broadcast hint if its files and rows are small, else as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, since texts can be long.

    Plans are lazy, so the bound cannot be taken back when they are built.  It is
    one and the same for all operators, a smaller one of the session's stays, and
    no result depends on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"(\d+)([kmgtp]?)", spark.conf.get(name).lower())
    if int(held[1]) << 10 * " kmgtp".index(held[2] or " ") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """At the end of a task: what it no longer holds goes back to the system, since its worker waits for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def running_sum(df: DataFrame, key: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` with ``name``: the sum of the values of lesser keys (whole numbers, each once).

    Sums of ranges of ``width`` keys come first; one task sees only those.
    """
    block = F.floor(F.col(key) / width)
    sums = df.groupBy(block.alias("__block")).agg(F.sum(value).alias("__sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__block", F.coalesce(F.sum("__sum").over(earlier(Window.orderBy("__block"))), F.lit(0)).alias("__base"))
    rows = df.withColumn("__block", block).join(sums, "__block")
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("__block").orderBy(key))), F.lit(0))
    return rows.withColumn(name, (F.col("__base") + inside).cast("long")).drop("__block", "__base")


def partitions_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions for a shuffle of ``df`` so that one holds about ``each`` bytes of its files.

    Rows that do not come from files have no known size; they take the session's number.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size > 1 << 53 else max(least, min(1_000_000, -(-size // each)))
