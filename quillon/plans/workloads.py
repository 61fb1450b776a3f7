"""Matrices made from the business tables; every query runs over whole tables.

parts      rows: part sizes 0 to 50 (row 0 is empty), columns: part key modulo 64
trade      rows: suppliers, columns: parts, values: quantities (large and sparse)
vectors    the embeddings times 10,000, as whole numbers
grads      a whole number for each embedding and part size
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators.layout import axis
from ..operators.tensor import Tensor

SIZES, WIDTH = 51, 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> Matrix:
    cells = read(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("k"), (F.col("p_partkey") % WIDTH).alias("c"))
    return Matrix(cells.agg(F.sum(F.floor("p_retailprice")).cast("long").alias("v")), SIZES, WIDTH)


def trade(spark: SparkSession, sf_dir: str) -> Matrix:
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("c"))
    rows, cols = (read(spark, sf_dir, t).count() for t in ("supplier", "part"))
    return Matrix(cells.agg(F.sum(F.floor("l_quantity")).cast("long").alias("v")), rows, cols)


def sales(spark: SparkSession, sf_dir: str) -> Matrix:
    """The rows of the line items as entries, repeated cells and all."""
    cells = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("c"), F.floor("l_quantity").cast("long").alias("v"))
    rows, cols = (read(spark, sf_dir, t).count() for t in ("supplier", "part"))
    return Matrix(cells, rows, cols)


def tensor(spark: SparkSession, sf_dir: str) -> Tensor:
    """The embeddings' cells by place (i0) and vector (i1)."""
    n = read(spark, sf_dir, "embeddings").count()
    return Tensor(cells(spark, sf_dir).select(F.col("c").alias("i0"), F.col("n").alias("i1"), F.col("x").alias("v")), (WIDTH, n))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long")).alias("x"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("n", F.posexplode("x").alias("c", "x")).withColumn("c", F.col("c").cast("long"))


def grads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"))
    return n.crossJoin(axis(n, SIZES, "k")).withColumn("g", (F.col("n") * 31 + F.col("k") * 17) % 13 - 6)


def grad_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"))
    return n.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(SIZES - 1)), lambda k: (F.col("n") * 31 + k * 17) % 13 - 6))
