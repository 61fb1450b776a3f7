"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Words (lower case, cut at white space) give sets of shingles of five words; a
text of one to four words is one shingle.  Texts with the same words are one
node, whatever the number of their copies.  A forest has ``TREES`` prefix tries:
each holds a label of ``LONGEST`` hashes of every node, kept as one number, so
that a beginning of it is a shift and sorted labels are the trie.

Matching starts from whole labels and shortens them.  The least length is the
longest one with which all trees together find a pair at the threshold with the
probability ``RECALL`` (six hashes for 0.9999 at 0.8).  A beginning that is crowded
(more than ``CROWD`` labels) is not shortened that far: each label stops at the
first length where it is in company of bounded size, at the whole label at most,
for which the trees still promise 0.997.  Nodes that share a beginning are
compared by all their hashes, and those that are unlike (four standard errors
below the threshold) are no candidates, so that chance meetings do not hang
classes together; only nodes that share a crowded whole label are taken as they
are.

Candidates that hang together are compared by their exact shingle sets, in blocks
of bounded size; no pair is ever emitted, only each node's number of links and a
spanning forest.  Each text is shuffled once, to be set against one text of its
candidates; blocks get what the sets lack and add.

Edge cases: null counts as empty; texts without words are copies of one another
and unlike all others; very long texts count whole; repeated rows each count;
null ``doc_id`` is allowed, and greater than others; pairs at exactly the
threshold are linked; an empty table gives no rows; other columns are not read
(``one_of_each`` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import bounded_batches, fresh, give_back, sized, text_of, written
from .components import components

WORDS, SIMILARITY = 5, 0.8
TREES, LONGEST, RECALL = 32, 8, 0.9999
#: Labels that may share a beginning for it to be shortened to, and standard errors below the threshold.
CROWD, ERRORS = 256, 4
#: Copies of a text from which it is hot.
HOT = 1024
#: Nodes of a block; two blocks at most are in one task.  A label is so many blocks at most, until one has ``WIDER`` times
#: the nodes; more if the differences in one are more than so many hashes.
BLOCK, SPREAD, WIDER, BLOCK_HASHES = 256, 16, 8, 1 << 22
CACHE_WORDS = 100_000
SEED = 77_003


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix with which a pair of that similarity meets in some tree often enough."""
    length = longest
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str], hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def node_of(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


class Forest:
    """The labels of a shingle set: one number for each tree, a byte of it for each hash, first hash highest."""

    def __init__(self, trees: int = TREES, seed: int = SEED):
        self.trees = trees
        rng = np.random.RandomState(seed)
        n = trees * LONGEST
        self.a = rng.randint(0, 2**31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.randint(0, 2**31, n, dtype=np.int64).astype(np.uint32)

    def labels(self, found: np.ndarray) -> np.ndarray:
        s = (found >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(s), 1024):
            np.minimum(low, (s[at : at + 1024, None] * self.a + self.b).min(axis=0), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).view(">i8").astype(np.int64)


def signed(docs: DataFrame, size: int, forest: Forest) -> DataFrame:
    """doc_id, node and labels of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, nodes, labels = batch.slice(at, 1000), [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    nodes.append(node_of(words))
                    labels.append(forest.labels(shingles(words, hashes, size)) if words else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.array(labels, pa.list_(pa.int64()))], names=["doc_id", "node", "labels"])
        del hashes
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, node binary, labels array<long>")


def beginning(length: int) -> Column:
    return F.shiftright("label", 64 - 8 * length)


def company(nodes: DataFrame, least: int, crowd: int = CROWD) -> DataFrame:
    """node, tree, length, prefix, n: the beginnings that nodes share with others, and how many do.

    ``least``: to how many hashes a label is shortened.
    """
    places = nodes.select("node", F.posexplode("labels").alias("tree", "label"))
    shared = places.groupBy("tree", beginning(least).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = written(places.withColumn("prefix", beginning(least)).join(shared, ["tree", "prefix"]).select("node", "tree", "label", F.lit(least).alias("length"), "prefix", "n"), "places")
    done, rest = rows.where(F.col("n") <= crowd), rows.where(F.col("n") > crowd)
    for length in range(least + 1, LONGEST + 1):
        counts = rest.groupBy("tree", beginning(length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        rest = rest.select("node", "tree", "label", F.lit(length).alias("length"), beginning(length).alias("prefix")).join(counts, ["tree", "prefix"]).select(rows.columns)
        if length < LONGEST:
            done, rest = done.unionByName(rest.where(F.col("n") <= crowd)), rest.where(F.col("n") > crowd)
    return done.unionByName(rest).where("n > 1").drop("label")


def alike(labels: np.ndarray, least: float) -> np.ndarray:
    """For each node the first of those it hangs together with, by links of at least this share of equal hashes."""
    m, hashes = len(labels), labels.astype(np.int64).view(np.uint8).reshape(len(labels), -1)
    linked = np.zeros((m, m), bool)
    for at in range(0, m, 64):
        linked[at : at + 64] = (hashes[at : at + 64, None, :] == hashes[None, :, :]).mean(axis=2) >= least
    first = np.arange(m)
    while True:
        lower = np.where(linked, first[None, :], m).min(axis=1)
        if (lower == first).all():
            return first
        first = lower


def candidates(nodes: DataFrame, similarity: float, recall: float, trees: int, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect the candidates which share a beginning in some tree."""
    found = written(company(nodes, prefix_length(similarity, recall, trees), crowd), "company")
    n = trees * LONGEST
    least = similarity - ERRORS * (similarity * (1 - similarity) / n) ** 0.5
    keys = ["tree", "length", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by beginning and node; one beginning is held at a time."""
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def edges(keys: np.ndarray, labels: np.ndarray, nodes: pa.Array) -> pa.RecordBatch | None:
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            u, v = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                first = alike(labels[a:b], least)
                at = np.flatnonzero(first != np.arange(b - a))
                u.append(at + a)
                v.append(first[at] + a)
            u, v = np.concatenate(u), np.concatenate(v)
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(u)), nodes.take(pa.array(v))], names=["u", "v"]) if len(u) else None

        def joined() -> tuple[np.ndarray, np.ndarray, pa.Array]:
            return tuple(np.concatenate([h[i] for h in held]) for i in (0, 1)) + (pa.concat_arrays([h[2] for h in held]),)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "length", "prefix")], axis=1)
            held.append((own, batch.column("labels").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("node")))
            keys_, labels, nodes_ = joined()
            last = int(np.flatnonzero((keys_ != keys_[-1]).any(axis=1))[-1]) + 1 if (keys_[0] != keys_[-1]).any() else 0
            if last and (out := edges(keys_[:last], labels[:last], nodes_.slice(0, last))):
                yield out
            held[:] = [(keys_[last:], labels[last:], nodes_.slice(last))]
        if held and (out := edges(*joined())):
            yield out
        held.clear()
        give_back()

    near = found.where(F.col("n") <= crowd).join(nodes.select("node", "labels"), "node").select(*keys, "node", "labels")
    near = near.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "u binary, v binary")
    full = found.where(F.col("n") > crowd).select(*keys, "node")
    first = full.groupBy(*keys).agg(F.min("node").alias("v"))
    return near.unionByName(full.join(first, keys).select(F.col("node").alias("u"), "v"))


def links_in(sets: list[np.ndarray], sides: list[int], similarity: float, sizes: np.ndarray, common: np.ndarray, base: int, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) of shingle sets that are alike; of two blocks, only those across.

    ``sets`` are differences from one base set, which has ``base`` shingles: what two
    sets share is what both share with the base, and what their differences share.
    """
    none = np.zeros(0, np.int64)
    side = np.array(sides)
    left = np.flatnonzero(side == side.min()) if across else np.arange(len(sets))
    right = np.flatnonzero(side != side.min()) if across else left
    if not len(right):
        return none, none
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else none
    often = np.diff(np.concatenate([edge, [len(values)]]))
    column = np.repeat(np.arange(len(edge)), often)
    shared = np.repeat(often > 1, often)
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 1024
    cut = np.searchsorted(column, np.arange(0, (column.max() if len(column) else -1) + 1 + width, width))
    for k in range(len(cut) - 1):
        has = np.zeros((len(sets), width), np.float32)
        has[owner[cut[k] : cut[k + 1]], column[cut[k] : cut[k + 1]] - k * width] = 1
        both += has[left] @ has[right].T if across else has @ has.T
    a, b = [none], [none]
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        met = both[at : at + 256].astype(np.float64) + (common[rows][:, None] + common[right][None, :] - base)
        either = sizes[rows][:, None] + sizes[right][None, :] - met
        alike = (met > 0) & (met >= similarity * either - 1e-6)
        if not across:
            alike &= rows[:, None] < right[None, :]
        x, y = np.nonzero(alike)
        a.append(rows[x])
        b.append(right[y])
    return np.concatenate(a), np.concatenate(b)


def differences(texts: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """label, node, copies, size, common, base, diff: each node's shingles against those of one node of its label.

    ``texts`` has label, node, copies, text; ``members`` label and node.  The text of
    the label's least node goes to each of its parts, and the others to one part,
    so every text is shuffled once; near copies differ in few shingles.
    """
    counts = written(members.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.min("node").alias("pivot")), "counts")
    rows = texts.join(sized(counts), "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("ahead", F.col("node") == F.col("pivot"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("ahead"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    rows = rows.select("label", "part", "ahead", (F.col("part") == F.col("own")).alias("counts"), "node", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part, the text that the others are set against ahead of them; one part's is held."""
        hashes, now, base = WordHashes(), None, np.zeros(0, np.uint64)
        held: list[tuple] = []
        shape = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["label", "node", "copies", "size", "common", "base", "diff"]

        def out() -> pa.RecordBatch:
            *columns, diffs = zip(*held, strict=True)
            ends = np.cumsum([0, *map(len, diffs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(diffs).view(np.int64)))
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, shape, strict=True)), lists], names=names)

        for batch in batches:
            waiting = 0
            for label, part, ahead, counted, node, copies, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = shingles(words_of(text), hashes, size)
                if (label, part) != now:
                    now, base = (label, part), found if ahead else found[:0]
                if counted:
                    diff = np.setxor1d(found, base, assume_unique=True)
                    held.append((label, node, copies, len(found), (len(found) + len(base) - len(diff)) // 2, len(base), diff))
                    waiting += len(diff)
                if waiting > 1 << 18:
                    yield out()
                    waiting = 0
            if held:
                yield out()
        del hashes, base
        give_back()

    keys = ["label", "part"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.col("ahead").desc()).mapInArrow(run, "label binary, node binary, copies long, size long, common long, base long, diff array<long>")


def verified(texts: DataFrame, members: DataFrame, size: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(node, root, links) of nodes with links, for each block pair of their candidates.

    ``texts`` has label, node, copies, text; a label's nodes, in ``members``, are
    candidates.  What goes to each pair of blocks are differences, not texts, and a
    label is ``SPREAD`` blocks unless those are too large.
    """
    diffs = written(differences(texts, members, size), "differences")
    weight = diffs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("diff")).alias("hashes"))
    some = F.least(F.ceil(F.col("n") / block), F.greatest(F.lit(SPREAD), F.ceil(F.col("n") / (WIDER * block))))
    blocks = written(weight.select("label", F.greatest(some, F.ceil(F.col("hashes") / BLOCK_HASHES), F.lit(1)).cast("int").alias("blocks")), "blocks")
    rows = diffs.join(sized(blocks), "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "size", "common", "base", "diff")

    def group(across: bool, sides: list[int], nodes: list[bytes], copies: list[int], sizes: list[int], common: list[int], base: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        a, b = links_in(sets, sides, similarity, np.array(sizes), np.array(common), base[0], across)
        if not len(a):
            return None
        weight = np.array(copies, np.int64)
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        root = list(range(len(nodes)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in at], pa.binary()), pa.array([nodes[top(k)] for k in at], pa.binary()), pa.array(links[at])], names=["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block pair; one pair of blocks is held at a time."""
        now, held = None, tuple([] for _ in range(7))
        for batch in batches:
            lists = batch.column("diff")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sets = np.split(lists.flatten().to_numpy(), ends[:-1])
            for label, i, j, *rest in zip(*[c.to_pylist() for c in batch.columns[:9]], sets, strict=True):
                if (label, i, j) != now:
                    if len(held[0]) > 1 and (out := group(now[1] != now[2], *held)):
                        yield out
                    now, held = (label, i, j), tuple([] for _ in range(7))
                for column, value in zip(held, rest, strict=True):
                    column.append(value)
        if len(held[0]) > 1 and (out := group(now[1] != now[2], *held)):
            yield out
        del held
        give_back()

    keys = ["label", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node binary, root binary, links long")


def near_classes(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), n_links.

    Two documents are linked if their shingle sets' Jaccard similarity is at
    least ``similarity``; copies are linked; a class is what links connect.
    """
    return classified(docs, size, similarity, trees, recall).select("doc_id", "class_id", "n_links")


def classified(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, crowd: int = CROWD) -> DataFrame:
    """The rows of ``near_classes`` with node, and with first: whether the class keeps the row.

    Rows of one doc_id and node are all first if one is.
    """
    bounded_batches(docs.sparkSession)
    marked = written(signed(docs, size, Forest(trees)), "signed")
    nodes = written(marked.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("labels").alias("labels")), "nodes")
    together = components(candidates(nodes, similarity, recall, trees, crowd))
    members = written(together.join(nodes.select("node", "copies", "high"), "node"), "members")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    one = members.select("label", "node", "copies", "high")
    pairs = verified(with_node(texts, one), one, size, similarity)
    pairs = written(pairs, "links")
    found = components(pairs.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    linked = found.join(links, "node").join(nodes.select("node", "low"), "node")
    least = linked.groupBy("label").agg(F.min("low").alias("class_id"), F.min(F.struct(F.col("low").isNull(), F.col("low"), F.col("node")))["node"].alias("keeper"))
    linked = written(linked.join(least, "label").select("node", "class_id", "keeper", "links"), "linked")

    known = nodes.select("node", "copies", "low").join(linked, "node", "left").select("node", "copies", "low", F.coalesce("class_id", "low").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.coalesce("keeper", "node") == F.col("node")).alias("keeps"))
    known, rows = written(known, "known"), marked.select("doc_id", "node")
    # Texts with very many copies are few, so what is known of them goes to their rows.
    hot = written(known.where(F.col("copies") >= HOT), "hot")
    cold = rows.join(sized(hot.select("node")), "node", "left_anti").join(known.where(F.col("copies") < HOT), "node")
    every = cold.unionByName(rows.join(sized(hot), "node"))
    return every.select("doc_id", "class_id", "n_links", "node", (F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("low"))).alias("first"))


@F.arrow_udf(BinaryType())
def text_node(text: pa.Array) -> pa.Array:
    found = pa.array([node_of(words_of(t)) for t in text.to_pylist()], pa.binary())
    give_back()
    return found


def with_node(texts: DataFrame, one: DataFrame) -> DataFrame:
    """A text for each node: of the row that has the node's words and its largest id.

    Rows meet nodes by their words, so null ids, or an id on very many texts, meet
    no others; copies that share an id are combined before they are shuffled.
    """
    keyed = texts.withColumn("own", text_node("text"))
    met = keyed.join(sized(one), (F.col("own") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("high")))
    return met.select("label", "node", "copies", "text").dropDuplicates(["node"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id.

    An id alone does not tell a row, since it may be null or stand on several
    texts, so rows go by their id and their node.
    """
    classes = written(classified(docs), "classes")
    node, off, gone = (fresh(docs, x) for x in ("__node", "__off", "__gone"))
    lost = written(classes.where("not first").select(F.col("doc_id").alias(gone), F.col("node").alias(off)), "near-gone")
    keyed = docs.withColumn(node, text_node(text_of()))
    left = keyed.join(sized(lost), (F.col(node) == F.col(off)) & F.col("doc_id").cast("long").eqNullSafe(F.col(gone)), "left_anti")
    if classes.where("first").groupBy("doc_id", "node").count().where("count > 1").limit(1).count():  # rows that repeat with one doc_id
        left = left.dropDuplicates(["doc_id", node])
    return left.drop(node)
