"""Stateful streaming exact deduplication.

A log of (digest, call, row, locator) is streamed into keyed state that lives on
disk (RocksDB) and never expires.  For each digest the state retains the stable
identifier of the row that stays, the locator of the first content, and the number
of rows.  A hit (a digest with more than one row) is only believed after the full
bytes were compared: the rows of a call with one another, and with the retained
content of earlier calls, which is fetched by its locator.  Rows whose digests
agree and whose bytes do not are grouped by their bytes instead.

With a ``state`` folder the state outlives a call: later calls go on from its
checkpoint, and hit what earlier ones have seen.  The folder keeps the log and the
texts that locators (file and row) point to.  A call that failed can be made again
in a new folder only, since part of its rows may be in the state.

Edge cases: null text counts as empty; very long texts are compared whole; a null
``doc_id`` is smaller than all others; of repeated rows with one ``doc_id`` exactly
one is ``kept``, the last by call and place; an empty table gives no rows; other
columns are not read (``drop_copies`` keeps them, whatever their names).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, sized, text_of, work_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Files of retained content that are named to the scan; of more, all are read.
FILES = 10_000
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def normalised(text: Column) -> Column:
    """Lower-case A-Z only.  Texts of ASCII alone take the faster ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_state(log: DataFrame) -> DataFrame:
    """The stateful core: per digest the row that stays, the first content, the count.

    ``log`` is a streaming frame with digest, doc_id, call, row_id, locator.
    """
    return log.groupBy("digest").agg(F.max(F.struct("doc_id", "call", "row_id")).alias("top"), F.min(F.struct("call", "row_id", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))


def run_state(spark: SparkSession, log_path: str, schema, files_per_batch: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Stream what the log has gained into the state; returns what the state now holds of each digest met.

    Batches are written by number, so that a batch that is run again after a
    failure replaces its own rows; later batches supersede earlier ones.
    """
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    out = work_path(spark, "dedup-state")

    def save(batch: DataFrame, number: int) -> None:
        batch.select("digest", "top", "first", "group_size").write.mode("overwrite").parquet(f"{out}/batch={number}")

    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        stream = digest_state(source.parquet(log_path))
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint or work_path(spark, "dedup-query")).trigger(availableNow=True).foreachBatch(save).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = stream.schema
    try:
        states = spark.read.schema(shape.add("batch", "long")).parquet(out)
    except Exception as e:  # nothing came, so no batch was written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if states.select("batch").distinct().count() > 1:
        last = states.groupBy("digest").agg(F.max_by(F.struct("top", "first", "group_size"), "group_size").alias("s"))
        return last.select("digest", "s.top", "s.first", "s.group_size")
    return states.drop("batch")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept, text_sha256.

    ``state``: a folder (shared by driver and executors) that outlives the call; then
    groups take in the rows of earlier calls, too.
    """
    spark = docs.sparkSession
    place, call = F.lit(None).cast("struct<file:string,row:long>"), 0
    if state:
        call = time.time_ns()
        content = f"{state}/content/call={call}"
        schema = docs.select("doc_id", text_of().alias("text")).schema
        docs.select("doc_id", text_of().alias("text")).write.parquet(content)
        docs = spark.read.schema(schema).parquet(content)
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    norm = normalised(text_of())
    log = docs.select("doc_id", digest(norm).alias("digest"), F.lit(call).cast("long").alias("call"), F.monotonically_increasing_id().alias("row_id"), place.alias("locator"))
    path = f"{state}/log" if state else work_path(spark, "dedup-log")
    log.write.mode("append").parquet(path)
    every = spark.read.schema(log.schema).parquet(path)
    log = every.where(F.col("call") == call)
    groups = written(run_state(spark, path, log.schema, files_per_batch, f"{state}/checkpoint" if state else None), "dedup-groups")

    found = log.select("doc_id", "digest", "row_id").join(groups, "digest").select(
        "doc_id",
        "digest",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("row_id") == F.col("top.row_id")) & (F.col("top.call") == call)).alias("kept"),
    )
    bad = unequal(docs, groups, norm, digest)
    if state:
        bad = written(bad.union(unlike_before(docs, groups.where(F.col("first.call") < call), norm, digest, state)).distinct(), "dedup-unlike")
    if bad.limit(1).count():
        parts = by_bytes(docs, bad, norm, digest) if not state else by_content(every, bad, state).where(F.col("call") == call).drop("call")
        found = found.join(sized(bad), "digest", "left_anti").unionByName(parts)
    return found


def content_at(spark: SparkSession, places: DataFrame, state: str) -> DataFrame:
    """``places`` (with a locator) and the normalised text that each points to."""
    files = [r.file for r in places.select("locator.file").distinct().limit(FILES + 1).collect()]
    held = spark.read.schema("doc_id long, text string").parquet(f"{state}/content")
    held = held.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), normalised(text_of()).alias("norm"))
    if len(files) <= FILES:  # no other file is opened
        held = held.where(F.col("__file").isin(files))
    return places.join(held, (F.col("locator.file") == F.col("__file")) & (F.col("locator.row") == F.col("__row"))).drop("__file", "__row")


def unlike_before(docs: DataFrame, groups: DataFrame, norm: Column, digest: Callable[[Column], Column], state: str) -> DataFrame:
    """Digests whose rows in ``docs`` do not have the bytes of the content retained from an earlier call."""
    hits = written(groups.select("digest", "first.locator"), "dedup-earlier")
    texts = docs.select(norm.alias("norm")).select("norm", digest(F.col("norm")).alias("digest"))
    mine = texts.join(sized(hits.select("digest")), "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("own"))
    return content_at(docs.sparkSession, hits, state).join(mine, "digest").where("norm <> own").select("digest")


def by_content(log: DataFrame, bad: DataFrame, state: str) -> DataFrame:
    """Groups of equal bytes among all rows, of all calls, of the digests in ``bad``."""
    rows = written(content_at(log.sparkSession, written(log.join(bad, "digest", "left_semi"), "dedup-places"), state), "dedup-contents")
    groups = rows.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "call", "row_id")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    mine = (F.col("row_id") == F.col("top.row_id")) & (F.col("call") == F.col("top.call"))
    return rows.join(groups, ["digest", "norm"]).select("doc_id", "digest", "call", F.col("top.doc_id").alias("keep_id"), "group_size", mine.alias("kept"))


def unequal(docs: DataFrame, groups: DataFrame, norm: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests of hits whose rows do not all have the same bytes.

    The least and the greatest text of a digest are equal only if all are; both
    are combined before the shuffle, so a hot group is no load for one task.
    """
    hits = written(groups.where("group_size > 1").select("digest"), "dedup-hits")
    texts = docs.select(norm.alias("norm")).select("norm", digest(F.col("norm")).alias("digest"))
    same = texts.join(sized(hits), "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return written(same.where("low <> high").select("digest"), "dedup-unequal")


def by_bytes(docs: DataFrame, bad: DataFrame, norm: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """Groups of equal bytes among the rows of the digests in ``bad``."""
    rows = docs.select("doc_id", norm.alias("norm"), F.monotonically_increasing_id().alias("row_id"))
    rows = written(rows.withColumn("digest", digest(F.col("norm"))).join(bad, "digest", "left_semi"), "dedup-bytes")
    groups = rows.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "row_id")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "norm"]).select("doc_id", "digest", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("top.row_id")).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of which a copy with a larger ``doc_id`` stays."""
    groups = written(exact_groups(docs), "dedup-result")
    own, digest, doc_id = (fresh(docs, x) for x in ("__digest", "__d", "__id"))
    keyed = docs.withColumn(own, sha256(normalised(text_of())))
    gone = written(groups.where("not kept and not (doc_id <=> keep_id)").select(F.col("digest").alias(digest), F.col("doc_id").alias(doc_id)), "dedup-gone")
    left = keyed.join(sized(gone), (F.col(own) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(doc_id)), "left_anti")
    if groups.where("not kept and doc_id <=> keep_id").limit(1).count():  # rows that repeat with one doc_id
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)
