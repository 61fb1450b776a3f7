"""Packing documents into training sequences: first-fit decreasing.

Documents are dealt into randomised groups, each packed on its own.  What
exceeds a sequence is cut off as full sequences; the rest is placed, longest
first, into the first bin with room, found in a tournament tree of the bins'
free capacities.  Bins that are still not full are then filled from the least
filled ones by cutting, so that a group has one sequence with padding at most.

Documents are dealt by a hash of id and text, so null ids and ids that repeat are
spread; a group that is crowded all the same is packed in parts of bounded size.

Edge cases: null or empty text is its end id alone; a very long text is cut into
full sequences and a rest; repeated rows are packed each, and of equal lengths
the one that comes first goes first; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, partitions_for, text_of
from .tokens import CACHE_WORDS, STEP, drop_encoders, word_encoder

CAPACITY = 4096
#: Documents of a group, on average.
GROUP = 1024
#: A group of so many times its documents, or of so many ids, is packed in parts.
CROWDED, HELD = 8, 32 << 20
SEED = 20_011
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """The free capacities of bins; each inner node holds the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """Put ``size`` into the first bin with room, and return the bin."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        bin_, free[at] = at - self.leaves, free[at] - size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return bin_


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Bins of (document, start, length).  Every token is in one piece."""
    bins: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        bins += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n % capacity:
            rest.append((d, whole, n % capacity))
    rest.sort(key=lambda x: (-x[2], x[0]))
    tree, open_ = Tournament(max(1, len(rest)), capacity), {}
    for piece in rest:
        open_.setdefault(tree.first(piece[2]), []).append(piece)
    return bins + topped_up(list(open_.values()), capacity)


def topped_up(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Fill the fuller bins from the emptier ones, cutting pieces."""
    filled = sorted(((sum(p[2] for p in b), b) for b in bins), key=lambda x: -x[0])
    i, j = 0, len(filled) - 1
    sums = [s for s, _ in filled]
    while i < j:
        gap = capacity - sums[i]
        if not gap:
            i += 1
            continue
        d, s, n = filled[j][1].pop()
        take = min(gap, n)
        filled[i][1].append((d, s + n - take, take))
        if take < n:
            filled[j][1].append((d, s, n - take))
        sums[i] += take
        sums[j] -= take
        if not sums[j]:
            j -= 1
    return [b for _, b in filled if b]


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP, seed: int = SEED, cache_words: int = CACHE_WORDS, step_bytes: int = STEP, keep_words: bool = True) -> DataFrame:
    """One row a piece; sequence_id names a sequence, offset is the place there.

    ``cache_words`` and ``step_bytes`` bound what a task holds: known words, and text that is encoded at once.
    The encoder and the words that it knows serve the next task of a worker too, unless ``keep_words`` is false.
    """
    bounded_batches(docs.sparkSession)
    groups = max(1, -(-docs.select(F.count(F.lit(1))).first()[0] // group))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)))
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])

    def packed(number: int, sequence: int, doc_ids: list[int | None], encoded: list[np.ndarray]) -> tuple[pa.RecordBatch, int]:
        """The pieces of a group whose first sequence has this number, and the next free one."""
        out: list[list] = [[] for _ in schema]
        bins = pack([len(e) for e in encoded], capacity)
        for k, pieces in enumerate(bins, sequence):
            at = 0
            for d, start, length in pieces:
                crc = zlib.crc32(encoded[d][start : start + length])
                for column, value in zip(out, (doc_ids[d], start, length, crc, len(encoded[d]), (number << 32) + k, at), strict=True):
                    column.append(value)
                at += length
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema), sequence + len(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows come sorted by group; one group is held at a time, as ids, and a crowded one in parts."""
        model, number, sequence = word_encoder(tokenizer, cache_words), None, 0
        doc_ids: list[int | None] = []
        encoded: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for first, ids, offsets in model.batches(batch.column(2), step_bytes):
                n, ids = len(offsets) - 1, ids.astype("<u4")
                names, marks = batch.column(1).slice(first, n).to_pylist(), offsets.tolist()
                for g, doc_id, a, b in zip(batch.column(0).slice(first, n).to_pylist(), names, marks, marks[1:], strict=False):
                    if g != number or len(doc_ids) >= CROWDED * group or held >= HELD:
                        if doc_ids:
                            out, sequence = packed(number, sequence, doc_ids, encoded)
                            yield out
                        if g != number:
                            number, sequence = g, 0
                        doc_ids, encoded, held = [], [], 0
                    doc_ids.append(doc_id)
                    encoded.append(ids[a:b])
                    held += b - a
        if doc_ids:
            yield packed(number, sequence, doc_ids, encoded)[0]
        doc_ids, encoded = [], []
        if not keep_words:
            del model
            drop_encoders()
        give_back()

    # The order in a group is set, so a task that runs again cuts and places the same pieces.
    dealt = dealt.select("group", "doc_id", "text").repartition(partitions_for(docs), "group").sortWithinPartitions("group", "doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(run, PIECE)
