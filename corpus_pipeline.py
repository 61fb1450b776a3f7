"""A corpus pipeline: toxic documents go, then exact copies, then near copies;
personal data is redacted; what is left is packed into sequences.

Each stage reads what its predecessor kept and is written before the next one.
SQL cannot express the stages, so the result is tested against a plain version.

Edge cases, for every stage: null and empty texts are one empty text (its row of
the largest id stays, a null id is the least); very long texts are read whole; of
rows that repeat with one id and text one stays; rows of one id and several texts
are judged by their texts; near copies leave the row of the least id; an empty
table gives an empty one; other columns are kept as they are, whatever their
names, up to packing, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, near_join, packing, pii, toxicity
from quillon.llm.common import made, release, table, work_path, written

__all__ = ["ORACLE_SQL", "STAGES", "run", "written"]


#: Bytes of an Arrow batch: the workers of all stages share an executor with what its JVM holds by then.
BATCH_BYTES = 1 << 20


def narrow(spark: SparkSession) -> None:
    """Operators leave a bound alone that is smaller than theirs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    narrow(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    narrow(spark)
    return near_join.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    narrow(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers serve other stages too, so the cache of words and the steps are smaller here, and no encoder outlives a task."""
    narrow(spark)
    return packing.pack_documents(docs, cache_words=60_000, step_bytes=1 << 20, keep_words=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_join", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again.

    Once a stage is written, the work folders of its making, and the rows of the
    stage before, are removed.
    """
    docs, since = table(spark, sf_dir, "documents"), made()
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path, shape = work_path(spark, name), docs.schema
            docs.write.parquet(path)
            docs = spark.read.schema(shape).parquet(path)
            release(spark, since, keep=path)
    return docs
