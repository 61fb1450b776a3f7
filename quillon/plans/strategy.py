"""Which physical form a product takes, from counted sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a sparse side that is collected, and rows (or entries) up to which a side is broadcast.
BROADCAST_ROWS = 500_000
#: Rows of a matrix that a step of a blocked product may have, and the bytes of one of its arrays.
BLOCKED_ROWS, STEP_BYTES = 4_000_000, 16 << 20
#: Entries of a part of a sparse side, and bytes of the vectors of a group.
PART_ENTRIES, CELL_BYTES = 1 << 18, 64 << 20
#: Bytes of a side that is broadcast.
BROADCAST_BYTES = 256 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows and their bytes are few, else the frame as it is (AQE decides).

    Rows can hold arrays, so the values in them count too.
    """
    values = [F.sum(F.size(c)).alias(c) for c, t in df.dtypes if t.startswith("array")]
    found = df.agg(F.count(F.lit(1)).alias("__n"), *values).first()
    size = 8 * (len(df.columns) * found["__n"] + sum(found[v] or 0 for v in df.columns if v in found.asDict()))
    return F.broadcast(df) if found["__n"] <= most and size <= BROADCAST_BYTES else df
