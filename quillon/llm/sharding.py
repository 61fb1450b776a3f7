"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size
(``offset + j * skip`` modulo the size).  The shards take turns, each claiming
the next free slot of its preference order, until the table is full.  The table
has a fixed size, whatever the data, and is broadcast; placing a row is one hash
and one lookup.  Adding or removing a shard moves little more than its share.

Edge cases: a null key hashes as the text ``\\0null``, an empty one as itself; very
long keys are hashed whole; equal keys, and so repeated rows, share a shard; shards
claim in the order in which they are named, so there are no ties; an empty table
gives no rows; columns named slot or shard are replaced only in the result of
``place`` and the others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table, a prime: a hundred slots and more for each of 512 shards.
SLOTS = 65_537
SHARDS = 512


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation."""
    h = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, turns: Sequence[int] | None = None) -> np.ndarray:
    """The shard number of each slot.  ``turns``: slots a shard claims in a round (weights)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and each once")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, not less than the number of shards")
    turns = list(turns or [1] * len(shards))
    if min(turns) < 0 or not any(turns):
        raise ValueError("turns must not be negative, and not all zero")
    place = [preference(s, slots) for s in shards]
    at = [offset for offset, _ in place]
    table = np.full(slots, -1, dtype=np.int32)
    free = slots
    while free:
        for k, (_, skip) in enumerate(place):
            for _ in range(turns[k]):
                if not free:
                    break
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip) % slots
                table[at[k]] = k
                free -= 1
    return table


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its SHA-256, modulo the slots."""
    parts = [F.coalesce(k.cast("string"), F.lit("\0null")) for k in keys]
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("long"), F.lit(slots))


def table_frame(spark: SparkSession, table: np.ndarray) -> DataFrame:
    rows = [(i, int(s)) for i, s in enumerate(table)]
    return spark.createDataFrame(rows, "slot long, shard int")


def place(df: DataFrame, keys: Sequence[str], table: np.ndarray) -> DataFrame:
    """``df`` with its slot and shard.  The table is broadcast: its size is fixed."""
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(*[F.col(k) for k in keys], slots=len(table)))
    return keyed.join(F.broadcast(table_frame(df.sparkSession, table)), "slot")


def moved(before: np.ndarray, after: np.ndarray, names_before: Sequence[str], names_after: Sequence[str]) -> float:
    """The share of slots whose shard differs between two tables of one size."""
    a, b = np.asarray(names_before)[before], np.asarray(names_after)[after]
    return float((a != b).mean())
