"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Places to which the edges of one node are dealt.
SALTS = 8


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller and own) neighbours of each node to the least one.

    The least neighbour is an aggregate, joined back; the edges of a node are dealt
    to ``SALTS`` places for that, and AQE splits what is larger still.
    """
    if large:
        sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    joined = sides.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least.withColumn("salt", salts), ["u", "salt"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").union(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node with an edge.

    ``edges`` has u and v, unequal, of one type that can be ordered.  Each round
    is written to the shared folder; the rounds grow as the logarithm of the
    longest path.
    """
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        edges = written(stars(stars(edges, True), False), "edges")
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    own = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(own.select("node", F.col("node").alias("label")))
