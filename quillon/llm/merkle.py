"""A Merkle manifest of a table: leaves, subroots for each source, one root, and a proof for each row.

A node is the SHA-256 of its children's hexadecimal digests, sixteen to a run (the
last run of a level may be shorter, and one child alone is hashed as well); levels
follow until one node remains, so a lone leaf is its own subroot.  Leaves stand in
the order of ids within their source, and the subroots in the order of sources.

Leaves are ranked by one range sort: a range knows how many rows of a source come
before it, so no task sees a source.  Aligned blocks of 16**3 leaves are traversed
one by one in the fractal way: for each level a task holds the existing subtree,
which gives the siblings of the leaf at hand, and the desired one, which takes a
leaf for each one that is emitted and is complete when the existing one is used up.
Above the blocks, levels and proofs are grouped and joined by Spark; a proof from
there is appended to those of a block.

Edge cases: a null field is ``-``; very long texts are hashed whole; a null id comes
first, and rows that share an id stand in the order of their digests; a null source
comes before all others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, partitions_for, sized, written
from .exact_dedup import LOWER, UPPER

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, levels of a block, and leaves of one.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
PATH = "array<struct<at:int,run:array<string>>>"


def node(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def leaf(values: Sequence[Column], kinds: Sequence[str]) -> Column:
    """The digest of a row: ``-`` for null, else byte count, colon and value; whole numbers in decimal."""
    texts = [v if kind == "string" else v.cast("string") for v, kind in zip(values, kinds, strict=True)]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, order: str = "doc_id", by: str = "source", text: str = "text") -> DataFrame:
    """id, g (the source as a key that is never null), leaf, and probe: the leaf of what a tampered row holds.

    Where 5 divides the crc32 of the id in decimal, tampering lower-cases A-Z of the text.
    """
    kinds = [dict(docs.dtypes)[f] for f in fields]
    touched = F.translate(F.col(text), UPPER, LOWER)
    changed = [touched if f == text else F.col(f) for f in fields]
    tampers = (F.crc32(F.col(order).cast("string").cast("binary")) % 5 == 0) & (F.col(text) != touched)
    own = leaf([F.col(f) for f in fields], kinds)
    rows = docs.select(F.col(order).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("g"), own.alias("leaf"), F.when(tampers, leaf(changed, kinds)).alias("probe"))
    return rows.withColumn("probe", F.coalesce("probe", "leaf"))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (written) with ``idx``, the place in the group, and ``n``, the rows of the group; one range sort.

    The sorted ranges are written; of each only the number of rows of every group is
    counted, and what comes before is added to the place in the file.
    """
    sorted_ = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(partitions_for(rows, 16 << 20), group, *order, "__row")
    sorted_ = written(sorted_.sortWithinPartitions(group, *order, "__row").drop("__row").withColumn("__part", F.spark_partition_id()), "merkle-ranges")
    at = F.col("_metadata.row_index")
    placed = sorted_.select("*", at.alias("__at"))
    counts = placed.groupBy("__part", group).agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(inside.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = written(counts.select("__part", group, (before - F.col("__low")).alias("__base"), F.sum("__n").over(inside).alias("n")), "merkle-counts")
    return placed.join(sized(base), ["__part", group]).withColumn("idx", F.col("__at") + F.col("__base")).drop("__part", "__at", "__base")


class Growing:
    """A subtree that takes leaves one by one: the children of its top, and the open run of each level below."""

    def __init__(self, level: int, held: Sequence[str] = ()):
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]
        for x in held:
            self.take(x)

    def take(self, leaf_: str) -> None:
        level = 0
        self.runs[0].append(leaf_)
        while level < len(self.runs) - 1 and len(self.runs[level]) == FAN:
            self.runs[level + 1].append(node(self.runs[level]))
            self.runs[level] = []
            level += 1

    def children(self) -> list[str]:
        """The children of the top, when no leaves are left: shorter runs are closed."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self.runs[level + 1].append(node(self.runs[level]))
                self.runs[level] = []
        return self.runs[-1]


def height(n: int, most: int = LEVELS) -> int:
    """Levels above n leaves until one node remains, or ``most``."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


def block_root(held: Sequence[str], levels: int) -> str:
    return node(Growing(levels - 1, held).children()) if levels else held[0]


def traversed(held: Sequence[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in turn, its place in its run and the run, level by level.

    ``existing[l]`` has the run of level l in which the leaf at hand lies, and
    ``desired[l]`` grows the next one by a leaf for each leaf emitted.
    """
    spans = [FAN ** (level + 1) for level in range(levels)]
    existing = [Growing(level, held[:span]).children() for level, span in enumerate(spans)]
    desired = [Growing(level) for level in range(levels)]
    for p in range(len(held)):
        yield [(p // FAN**level % FAN, existing[level]) for level in range(levels)]
        for level, span in enumerate(spans):
            if p + span < len(held):
                desired[level].take(held[p + span])
            if (p + 1) % span == 0:
                existing[level], desired[level] = desired[level].children(), Growing(level)


def folded(digest: str, path: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, run in path:
        digest = node([*run[:at], digest, *run[at + 1 :]])
    return digest


def siblings(path: Sequence[tuple[int, Sequence[str]]]) -> list[str]:
    return [x for at, run in path for k, x in enumerate(run) if k != at]


def blocks(rows: DataFrame) -> DataFrame:
    """g, b, n and the rows of every aligned block in order; a row a block, of ``BLOCK`` elements at most."""
    cell = F.struct("idx", "id", "leaf", "probe")
    held = rows.groupBy("g", F.floor(F.col("idx") / BLOCK).alias("b")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(cell)).alias("e"))
    return held.select("g", "b", "n", F.col("e.id").alias("ids"), F.col("e.leaf").alias("leaves"), F.col("e.probe").alias("probes"))


def block_roots(held: DataFrame) -> DataFrame:
    """g, idx (of the block), h and m, the number of blocks of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [block_root(x.as_py(), height(n)) for x, n in zip(batch.column("leaves"), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("b"), pa.array(roots, pa.string()), pa.array([-(-n // BLOCK) for n in batch.column("n").to_pylist()], pa.int64())], names=["g", "idx", "h", "m"])

    return held.select("g", "b", "n", "leaves").mapInArrow(run, "g string, idx long, h string, m long")


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level above ``nodes`` (g, idx, h, m), and g, level and h of the top of each group."""
    runs, tops, level = [], [], 0
    while True:
        tops.append(nodes.where("m = 1").select("g", F.lit(level).alias("level"), "h"))
        more = nodes.where("m > 1")
        if not more.limit(1).count():
            return runs, reduce(DataFrame.unionByName, tops)
        up = F.floor(F.col("idx") / FAN)
        grouped = more.groupBy("g", up.alias("idx")).agg(F.max("m").alias("m"), F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("e"))
        runs.append(written(grouped.select("g", "idx", F.col("e.h").alias("run"), F.ceil(F.col("m") / FAN).alias("m")), "merkle-level"))
        nodes, level = runs[-1].select("g", "idx", F.sha2(F.array_join("run", "").cast("binary"), 256).alias("h"), "m"), level + 1


def descended(runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """g, idx and path of each node under the runs; ``tops``: g, level, path and what else all nodes of a group get.

    Paths go down from the top, a level at a time; both sides of a join have a row for each node.
    """
    others = [c for c in tops.columns if c not in ("g", "level", "path")]
    ended = lambda level: tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("idx"), "path", *others)
    paths = ended(len(runs))
    for level in reversed(range(len(runs))):
        met = runs[level].select("g", "idx", "run").join(paths, ["g", "idx"]).select("g", "idx", "run", "path", *others, F.posexplode("run").alias("at", "__h"))
        own = F.array(F.struct("at", "run"))
        down = met.select("g", (F.col("idx") * FAN + F.col("at")).alias("idx"), F.concat(own, "path").cast(PATH).alias("path"), *others)
        paths = down.unionByName(ended(level))
    return paths


def proofs(held: DataFrame, whole: bool) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of the rows of blocks with their path; ``whole``: the proof too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, held_, probes, path, subroot, root = (batch.column(c)[i] for c in ("ids", "n", "leaves", "probes", "path", "subroot", "root"))
                above, root = [(x["at"], x["run"]) for x in path.as_py()], root.as_py()
                own, tail = held_.as_py(), "".join(siblings(above)).encode()
                found: list[list] = [[], [], []]
                for probe, below in zip(probes.as_py(), traversed(own, height(n.as_py())), strict=True):
                    beside = siblings(below)
                    digest = sha256("".join(beside).encode())
                    digest.update(tail)
                    found[0].append(digest.hexdigest())
                    found[1].append(folded(folded(probe, below), above))
                    found[2].append(beside + siblings(above) if whole else None)
                size = len(own)
                fixed = [pa.array([x] * size, pa.string()) for x in (subroot.as_py(), root)]
                columns = [ids.values, pa.array(own, pa.string()), *fixed, pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array([x == root for x in found[1]], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found[2], pa.list_(pa.string()))] * whole, names=NAMES + ["proof"] * whole)

    kind = dict(held.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    shape = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * whole
    return held.mapInArrow(run, shape)


NAMES = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, order: str = "doc_id", by: str = "source", text: str = "text", whole: bool = False) -> DataFrame:
    """A row for each row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``whole``: also ``proof``, the siblings from the leaf to the root.
    """
    bounded_batches(docs.sparkSession)
    rows = written(leaves(docs, fields, order, by, text), "merkle-leaves")
    held = written(blocks(ranked(rows, "g", "id", "leaf")), "merkle-blocks")
    runs, tops = climbed(written(block_roots(held), "merkle-roots"))
    subroots = written(tops, "merkle-subroots")
    # The subroots are the leaves of one more tree.
    sources = written(ranked(subroots.withColumn("all", F.lit("")), "all", "g"), "merkle-sources")
    over, top = climbed(sources.select(F.col("all").alias("g"), "idx", "h", F.col("n").alias("m")))
    root = (top.first() or {"h": None})["h"]
    paths = descended(over, top.select("g", "level", F.array().cast(PATH).alias("path"))).select("idx", F.col("path"))
    heads = written(sources.join(paths, "idx").select("g", "level", "path", F.col("h").alias("subroot")), "merkle-heads")
    paths = written(descended(runs, heads), "merkle-paths").withColumnRenamed("idx", "b")
    return proofs(held.join(sized(paths), ["g", "b"]).withColumn("root", F.lit(root).cast("string")), whole)
