"""Bloom filters as relations: bits that are set by an aggregation and merged as it merges.

A key is dealt to one of several filters by a hash, so each filter has bounded
bytes however many keys there are.  A filter's words are made with ``bit_or``: rows
combine where they are read, then by word.  A key that was put in is always found;
of others a share of about ``rate`` is.  Keys are hashed together, null as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..plans.work import written

#: Keys of a filter, bytes of all filters that a task may hold at once, and groups that the rows of a filter are dealt to.
KEYS, HELD, SPREAD = 1 << 20, 16 << 20, 32


def hashes(keys: list[str]) -> list[Column]:
    """The filter's own hash, and the two from which the places of a key follow."""
    return [F.xxhash64(F.lit(s), *keys) for s in (11, 12, 13)]


@dataclass(frozen=True)
class Bloom:
    """``filters``: g and bits (binary); ``count`` of them, of ``size`` bits, ``places`` for each key."""

    filters: DataFrame
    keys: list[str]
    count: int
    size: int
    places: int

    def maybe(self, df: DataFrame, keys: list[str] | None = None, name: str = "maybe") -> DataFrame:
        """``df`` with whether each row's key may have been put in.

        Filters of few bytes go to all tasks; otherwise rows are dealt to their filter,
        those of one filter (a key on very many rows, too) in ``SPREAD`` groups.
        """
        own = hashes(keys or self.keys)
        rows = df.select("*", F.pmod(own[0], F.lit(self.count)).alias("__g"), own[1].alias("__a"), own[2].alias("__b"))
        size, places = self.size, self.places
        shape = StructType([*df.schema.fields, StructField(name, BooleanType())])

        def found(batch: pa.RecordBatch, bits: np.ndarray) -> pa.Array:
            a, b = (batch.column(x).to_numpy().astype(np.uint64) for x in ("__a", "__b"))
            out = np.ones(len(a), bool)
            for i in range(places):
                at = spot(a, b, i, size)
                out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            return pa.array(out)

        def with_found(batch: pa.RecordBatch, hit: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(c) for c in shape.names[:-1]] + [hit], names=shape.names)

        if self.count * size <= 8 * HELD:
            held = {r.g: np.frombuffer(r.bits, np.uint8) for r in self.filters.collect()}

            def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                none = np.zeros(size // 8, np.uint8)
                for batch in batches:
                    g, out = batch.column("__g").to_numpy(), np.zeros(batch.num_rows, bool)
                    for k in np.unique(g):
                        at = np.flatnonzero(g == k)
                        out[at] = found(batch.take(pa.array(at)), held.get(int(k), none)).to_numpy(zero_copy_only=False)
                    yield with_found(batch, pa.array(out))

            return rows.mapInArrow(whole, shape)
        whole = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])
        dealt = rows.withColumns({"__r": F.pmod(whole, F.lit(SPREAD)), "__row": F.lit(True)})
        spread = self.filters.select(F.col("g").cast("long").alias("__g"), "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("__r"), F.lit(False).alias("__row"))
        both = spread.unionByName(dealt, allowMissingColumns=True).repartition("__g", "__r").sortWithinPartitions("__g", "__r", "__row")

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, now = np.zeros(size // 8, np.uint8), None
            for batch in batches:
                cells = np.stack([batch.column(c).to_numpy() for c in ("__g", "__r")], axis=1)
                row = batch.column("__row").to_numpy(zero_copy_only=False).astype(bool)
                cut = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1) | ~row[1:] | ~row[:-1]) + 1), batch.num_rows]
                for low, high in zip(cut, cut[1:]):
                    if high == low:
                        continue
                    part, cell = batch.slice(low, high - low), tuple(cells[low])
                    if cell != now:
                        bits, now = np.zeros(size // 8, np.uint8), cell
                    if row[low]:
                        yield with_found(part, found(part, bits))
                    else:
                        bits = np.frombuffer(part.column("bits")[0].as_py(), np.uint8)

        return both.mapInArrow(routed, shape)


def spot(a: np.ndarray, b: np.ndarray, i: int, size: int) -> np.ndarray:
    return (a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(size)


def sizes(n: int, rate: float) -> tuple[int, int, int]:
    """Filters, bits of each, and places of a key, for n keys and a share of false finds."""
    count = max(1, -(-n // KEYS))
    each = -(-n // count) * 1.1 + 64  # filters get unequally many keys
    size = 64 * math.ceil(-each * math.log(rate) / math.log(2) ** 2 / 64)
    return count, size, max(1, round(size / each * math.log(2)))


def built(df: DataFrame, keys: list[str], rate: float = 0.01, n: int | None = None) -> Bloom:
    """A filter of the keys of ``df``; ``n``: how many there are at most, counted if it is not given."""
    if not 0 < rate < 1:
        raise ValueError(f"a share of false finds of {rate}")
    count, size, places = sizes(df.count() if n is None else n, rate)
    own = hashes(keys)
    rows = df.select(F.pmod(own[0], F.lit(count)).alias("g"), own[1].alias("a"), own[2].alias("b"))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, a, b = (batch.column(x).to_numpy() for x in ("g", "a", "b"))
            a, b = a.astype(np.uint64), b.astype(np.uint64)
            at = np.concatenate([spot(a, b, i, size) for i in range(places)])
            words = np.stack([np.tile(g, places), (at >> np.uint64(6)).astype(np.int64)], axis=1)
            order = np.lexsort(words.T[::-1])
            words, masks = words[order], (np.uint64(1) << (at & np.uint64(63)))[order]
            first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])) if len(words) else np.zeros(0, int)
            merged = np.bitwise_or.reduceat(masks, first) if len(first) else masks
            yield pa.RecordBatch.from_arrays([pa.array(words[first, 0]), pa.array(words[first, 1]), pa.array(merged.view(np.int64))], names=["g", "word", "mask"])

    words = rows.mapInArrow(set_bits, "g long, word long, mask long").groupBy("g", "word").agg(F.bit_or("mask").alias("mask"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bits, e = np.zeros(size // 64, np.int64), batch.column("e")[i].values
                bits[e.field("word").to_numpy()] = e.field("mask").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("g").slice(i, 1), pa.array([bits.tobytes()], pa.binary())], names=["g", "bits"])

    filters = words.groupBy("g").agg(F.collect_list(F.struct("word", "mask")).alias("e")).mapInArrow(packed, "g long, bits binary")
    return Bloom(written(filters, "bloom"), keys, count, size, places)


def unseen(drawn: DataFrame, held: DataFrame, keys: list[str], rate: float = 0.01) -> DataFrame:
    """The different keys of ``drawn`` that ``held`` does not have.

    Keys that the filter of ``held`` does not know are new without a join; only the
    others, which are mostly held, are looked for.
    """
    marked = written(built(held, keys, rate).maybe(drawn.select(*keys).distinct()), "unseen")
    left = marked.where("maybe").drop("maybe").join(held.select(*keys).distinct(), keys, "left_anti")
    return marked.where("not maybe").drop("maybe").unionByName(left)
