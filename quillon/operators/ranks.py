"""Places of rows in an order of all rows, by one range sort.

Rows are dealt to ranges, sorted, and written.  Of each range only the number of
its rows is counted (for every group that it has); the sums of the numbers before
it are what is added to the place in the file.  A range is a share of the rows,
whatever keys they have: rows that tie are dealt apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import partitions_for, size_of, written

#: Rows of counts that are broadcast at most, by their bytes.
SMALL = 64 << 20


def before(window, value: str):
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranked(df: DataFrame, order: list[str], name: str = "pos", group: str | None = None, inside: str = "idx", size: str = "n") -> DataFrame:
    """``df`` with its place ``name`` by ``order``; rows that tie stand in any order.

    With a ``group``, which is to be the first of ``order``, also the place
    ``inside`` the group and the ``size`` of the group.
    """
    keys = [F.col(c) for c in order] + [F.monotonically_increasing_id()]
    dealt = df.repartitionByRange(partitions_for(df), *keys).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("__part", F.spark_partition_id()), "ranks")
    placed = dealt.withColumn("__at", F.col("_metadata.row_index"))
    found = [group] if group else []
    counts = placed.groupBy("__part", *found).agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    # One row for each range: the one task that sees all of them sees no more than that.
    whole = counts.groupBy("__part").agg(F.sum("__n").alias("__all"))
    whole = whole.select("__part", before(Window.orderBy("__part"), "__all").alias("__base"))
    if group:
        own = Window.partitionBy(group)
        counts = counts.select("__part", group, (before(own.orderBy("__part"), "__n") - F.col("__low")).alias("__shift"), F.sum("__n").over(own).alias(size))
        whole = whole.join(counts, "__part")
    whole = written(whole, "rank-counts")
    rows = placed.join(F.broadcast(whole) if size_of(whole) <= SMALL else whole, ["__part", *found])
    more = [(F.col("__at") + F.col("__shift")).cast("long").alias(inside), F.col(size).cast("long").alias(size)] if group else []
    return rows.select(*df.columns, (F.col("__at") + F.col("__base")).cast("long").alias(name), *more)
