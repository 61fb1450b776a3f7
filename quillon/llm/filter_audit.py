"""How filters of documents act on one another, for every order in which they can be applied.

Each document gets a mask with a bit for every filter that it fails.  Four filters
read the text alone.  The fifth, identical to the text of a smaller ``doc_id``,
is found by an RDD that is routed by a 64-bit fingerprint: a partition stores
chains of the texts that share a fingerprint, whole, each with its least id, and
emits the rows that are not of the least id.  What a mask counts in a part of the
table is a vector, merged with ``combineByKey``; all orders follow from vectors.

Texts are compared in two places: first where they are read, in chains of bounded
bytes, so that of a text that a third of all rows share a task sends one row for
each ``CHAIN_BYTES`` that it reads; then where their fingerprint is routed to.  A row
that is known not to be the least goes on without its text, routed by its own hash.

Edge cases: a null or empty text is one empty text; very long texts are compared and
counted whole; a null ``doc_id`` is smaller than all others; rows that share the least
id of a text are not failing; a null part is the empty string; of labels that repeat
for an id, any that says so counts, and a null id has none; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

NAMES = "ABCDE"
DUPLICATE = 1 << NAMES.index("E")
#: Bytes of text that a task keeps in its chains before it sends them on.
CHAIN_BYTES = 32 << 20
#: Bytes of text for each partition of fingerprints, which holds the different ones among them.
EACH = 32 << 20
#: An odd factor that spreads ids over partitions.
SPREAD = 0x9E3779B97F4A7C15
Counts = Iterable[tuple[tuple[str, int], int]]
CAPITALS, MARKS = bytes(range(65, 91)), re.compile(r"[#$%&*|]")
COUNTS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str) -> int:
    """Bits of the filters that read one text: few words, repeated words, capitals, marks."""
    raw = text.encode()
    words = raw.split()  # of bytes, this is at [\x20\x09-\x0D] alone
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * len(text)) << 2 | (MARKS.search(text) is not None) << 3


def less(a: int | None, b: int | None) -> bool:
    """Order of ids, null the least."""
    return b is not None and (a is None or a < b)


class Chains:
    """Texts by fingerprint, each with its least id, and counts by part and mask of the rows that have it.

    Rows that turn out not to be of the least id of their text are counted apart.
    """

    def __init__(self):
        self.held: dict[int, list[list]] = {}
        self.more: Counter = Counter()
        self.bytes = 0

    def add(self, print_: int, text: bytes, doc_id: int | None, rows: Counts) -> None:
        chain = self.held.setdefault(print_, [])
        for link in chain:
            if link[0] == text:
                if less(doc_id, link[1]):
                    self.known(link[1], link[2].items())
                    link[1:] = doc_id, Counter(dict(rows))
                elif less(link[1], doc_id):
                    self.known(doc_id, rows)
                else:
                    link[2].update(dict(rows))
                return
        chain.append([text, doc_id, Counter(dict(rows))])
        self.bytes += len(text) + 300

    def known(self, doc_id: int | None, rows: Counts) -> None:
        """Rows that are not of the least id."""
        for (part, mask), n in rows:
            self.more[doc_id, part, mask | DUPLICATE] += n

    def size(self) -> int:
        return self.bytes + 200 * len(self.more)

    def emptied(self) -> tuple[Iterator[tuple[int, bytes, int | None, Counter]], Iterator[tuple[int | None, str, int, int]]]:
        """The texts that are held, and the rows that are not of a least id; then nothing is held."""
        held, more = self.held, self.more
        self.__init__()
        return ((p, *link) for p, chain in held.items() for link in chain), ((*key, n) for key, n in more.items())


def read_texts(rows: Iterable[tuple], most: int) -> Iterator[tuple[int, tuple]]:
    """Rows (fingerprint, doc_id, part, text), keyed: (fingerprint, text, doc_id, counts), or (None, doc_id, part, mask, n) where the text is no more needed."""
    chains = Chains()

    def sent() -> Iterator[tuple[int, tuple]]:
        texts, more = chains.emptied()
        yield from ((print_, (print_, text, i, tuple(counts.items()))) for print_, text, i, counts in texts)
        yield from ((i * SPREAD >> 16 & 0xFFFFFFFF, (None, i, part, mask, n)) for i, part, mask, n in more)

    for print_, doc_id, part, text in rows:
        chains.add(print_, text.encode(), doc_id, [((part, text_mask(text)), 1)])
        if chains.size() > most:
            yield from sent()
    yield from sent()


def met_texts(rows: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
    """doc_id, part, mask and the number of rows, the fifth filter decided."""
    chains = Chains()
    for _, row in rows:
        if row[0] is None:
            yield row[1:]
            continue
        chains.add(*row)
    texts, more = chains.emptied()
    yield from more
    yield from ((i, part, mask, n) for _, _, i, counts in texts for (part, mask), n in counts.items())


def partitions_of(docs: DataFrame) -> int:
    """Partitions of fingerprints by the bytes that texts have when they are read; files are packed, so their sizes do not say."""
    total = docs.agg(F.sum(F.octet_length(text_of()).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // EACH))


def masks(docs: DataFrame, part: str = "source", fingerprint: Column | None = None, chain_bytes: int = CHAIN_BYTES) -> DataFrame:
    """doc_id, part, mask and the number n of such rows, over all of ``docs``."""
    key = F.xxhash64(text_of()) if fingerprint is None else fingerprint
    rows = docs.select(key.alias("p"), F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    keyed: RDD = rows.rdd.map(tuple).mapPartitions(partial(read_texts, most=chain_bytes))
    found = keyed.partitionBy(partitions_of(docs), lambda p: p).mapPartitions(met_texts)
    return docs.sparkSession.createDataFrame(found, "doc_id long, part string, mask int, n long", verifySchema=False)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many rows there are, are good, are toxic.

    Rows are added up by id before they meet their labels, so an id on many rows
    (or none on many) is no load for one task.
    """
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    summed = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    hit = lambda c: (F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return summed.join(known, "doc_id", "left").select("part", "mask", "n", hit("good"), hit("toxic"))


def vectors(rows: DataFrame) -> RDD:
    """(part, array of 3 x 32): rows, good rows and toxic rows of each mask."""

    def add(v: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        v[:, row[0]] += row[1:]
        return v

    pairs = rows.rdd.map(lambda r: (r[0], tuple(r)[1:]))
    return pairs.combineByKey(lambda row: add(np.zeros((3, 1 << len(NAMES)), np.int64), row), add, lambda a, b: a + b)


@lru_cache
def orders() -> tuple[list[tuple[str, int]], np.ndarray, dict[str, np.ndarray]]:
    """Orders and steps, the filter of each, and which masks each of them counts, as rows of zeros and ones."""
    names = [("".join(p), k + 1) for p in permutations(NAMES) for k in range(len(NAMES))]
    place = np.array([NAMES.index(order[step - 1]) for order, step in names])
    earlier = np.array([sum(1 << NAMES.index(f) for f in order[: step - 1]) for order, step in names])[:, None]
    mask, bit = np.arange(1 << len(NAMES))[None], 1 << place[:, None]
    fails, gone = (mask & bit) > 0, (mask & earlier) > 0
    which = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == bit}
    return names, place, {k: v.astype(np.int64) for k, v in which.items()}


def audited(item: tuple[str, np.ndarray]) -> Iterator[tuple]:
    """The rows of a part, from its vector."""
    part, (n, good, toxic) = item
    names, place, which = orders()
    removed = which["removed"] @ n
    shapley = np.zeros(len(NAMES), np.int64)
    np.add.at(shapley, place, removed)
    columns = [which["kept"] @ n, removed, which["redundant"] @ n, which["unique"] @ n, which["removed"] @ good, which["removed"] @ toxic, shapley[place]]
    for name, row in zip(names, np.stack(columns, axis=1).tolist(), strict=True):
        yield (part, *name, *row)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", fingerprint: Column | None = None, chain_bytes: int = CHAIN_BYTES) -> DataFrame:
    """A row for each part, order of filters and step: what the filter at that step does there."""
    found = written(masks(docs, part, fingerprint, chain_bytes), "audit-masks")
    counts = vectors(labelled(found, labels)).flatMap(audited)
    return docs.sparkSession.createDataFrame(counts, COUNTS, verifySchema=False)
