"""MatrixMarket files as a data source: ``spark.read.format("matrixmarket")``.

Reading: the head is read by the driver, the lines by tasks, each a range of bytes.
Option ``base`` says from what number indices count (1; the text reader in
``matrix_market`` finds it out, and counts the entries, which takes a pass).
Symmetric files give both halves; pattern entries get the seeded values.

Writing: a task writes a file of its own under a name that nobody else has, in a
folder beside the target.  Only the files that were reported at the end are named
in their order, the head is put before them, and the folder gets its name in one
step.  What failed or ran twice is never seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.hashing import uniform
from ..matrix import Matrix
from ..plans.work import partitions_for
from .files import FormatError, lines_from, parts_of, place
from .matrix_market import Header, Kind, Storage, parse_header

#: Bytes of a partition.
EACH = 32 << 20


def head_of(path: str) -> tuple[Header, int]:
    """The head of the first file, and the bytes that it takes."""
    system, name = place(path)
    name, size = parts_of(system, name)[0]
    held, raw = [], b""
    with system.open_input_file(name) as f:
        while len(raw) < size:
            raw += f.read_at(64 << 10, len(raw))
            at, held = 0, []
            for line in raw.split(b"\n")[: None if len(raw) >= size else -1]:
                at += len(line) + 1
                held.append(line.decode("utf-8", "replace").strip())
                if len(held) > 1 and held[-1] and not held[-1].startswith("%"):
                    return parse_header(held), min(at, size)
    return parse_header(held), size


@dataclass
class Piece(InputPartition):
    path: str
    low: int
    high: int


class MarketReader(DataSourceReader):
    def __init__(self, path: str, base: int, each: int):
        self.path, self.base, self.each = path, base, each

    def partitions(self) -> list[Piece]:
        system, name = place(self.path)
        _, low = head_of(self.path)
        out = []
        for part, size in parts_of(system, name):
            out += [Piece(part, at, min(size, at + self.each)) for at in range(low, size, self.each)]
            low = 0
        return out or [Piece(name, 0, 0)]

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        if part.high <= part.low:
            return
        head, _ = head_of(self.path)
        need = {Kind.pattern: 2, Kind.complex: 4}.get(head.kind, 3)
        system, _ = place(self.path)
        for lines in lines_from(system, part.path, part.low, part.high):
            words = [x.split() for x in lines if x.strip() and not x.startswith(b"%")]
            if short := next((x for x in words if len(x) < need), None):
                raise FormatError(f"an entry of too few words: {short!r}")
            try:
                k, c = (np.array([int(x[i]) for x in words], np.int64) - self.base for i in (0, 1))
                v = np.array([sum(map(float, x[2:need])) for x in words], np.float64)
            except ValueError as e:
                raise FormatError(str(e)) from None
            if len(k) and (min(k.min(), c.min()) < 0 or k.max() >= head.rows or c.max() >= head.cols):
                raise FormatError(f"an entry is outside {head.rows} x {head.cols}")
            if head.storage is Storage.symmetric:
                off = k != c
                k, c, v = np.concatenate([k, c[off]]), np.concatenate([c, k[off]]), np.concatenate([v, v[off]])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(v, mask=np.full(len(v), head.kind is Kind.pattern))], names=["k", "c", "v"])


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    entries: int


class MarketWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, cols: int, kind: Kind, overwrite: bool):
        self.path, self.rows, self.cols, self.kind, self.overwrite = path, rows, cols, kind, overwrite
        system, name = place(path)
        if system.get_file_info(name).type != fs.FileType.NotFound and not overwrite:
            raise FormatError(f"{path} exists")
        self.folder = f"{name.rstrip('/')}.{uuid.uuid4().hex}.writing"
        system.create_dir(self.folder)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        system, _ = place(self.path)
        name, n = f"_{uuid.uuid4().hex}", 0
        with system.open_output_stream(f"{self.folder}/{name}") as f:
            for batch in batches:
                k, c = (pc.cast(batch.column(i), pa.int64()) for i in (0, 1))
                if batch.num_rows and (k.null_count or c.null_count or pc.min(k).as_py() < 0 or pc.max(k).as_py() >= self.rows or pc.min(c).as_py() < 0 or pc.max(c).as_py() >= self.cols):
                    raise FormatError(f"an entry is null or outside {self.rows} x {self.cols}")
                words = [pc.cast(pc.add(x, 1), pa.string()) for x in (k, c)]
                if self.kind is not Kind.pattern:
                    v = batch.column(2)
                    words.append(pa.array([repr(x) for x in v.to_pylist()]) if pa.types.is_floating(v.type) else pc.cast(v, pa.string()))
                lines = pc.binary_join_element_wise(*words, " ")
                if batch.num_rows:
                    f.write(("\n".join(lines.to_pylist()) + "\n").encode())
                n += batch.num_rows
        return Part(TaskContext.get().partitionId(), name, n)

    def commit(self, messages: list[Part | None]) -> None:
        system, name = place(self.path)
        parts = sorted((m for m in messages if m and m.entries), key=lambda m: m.number)
        head = Header(True, self.kind, Storage.general, self.rows, self.cols, sum(m.entries for m in parts))
        known = {m.name for m in parts}
        for x in system.get_file_info(fs.FileSelector(self.folder)):
            if x.base_name not in known:
                system.delete_file(x.path)
        with system.open_output_stream(f"{self.folder}/part-00000000") as f:
            f.write((head.text() + "\n").encode())
        for i, m in enumerate(parts):
            system.move(f"{self.folder}/{m.name}", f"{self.folder}/part-{i + 1:08d}")
        if self.overwrite and system.get_file_info(name).type != fs.FileType.NotFound:
            (system.delete_dir if system.get_file_info(name).type == fs.FileType.Directory else system.delete_file)(name)
        system.move(self.folder, name)

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = place(self.path)
        if system.get_file_info(self.folder).type == fs.FileType.Directory:
            system.delete_dir(self.folder)


class MatrixMarket(DataSource):
    """Options: ``path``, ``base`` (1), ``bytesperpartition``; to write, ``rows``, ``cols`` and ``kind`` (real)."""

    @classmethod
    def name(cls) -> str:
        return "matrixmarket"

    def schema(self) -> str:
        return "k long, c long, v double"

    def reader(self, schema) -> MarketReader:
        head, _ = head_of(self.options["path"])
        if not head.coordinate or head.storage in (Storage.skew, Storage.hermitian):
            raise FormatError(f"{head.code()} is not read; only general and symmetric coordinate files are")
        return MarketReader(self.options["path"], int(self.options.get("base", 1)), int(self.options.get("bytesperpartition", EACH)))

    def writer(self, schema, overwrite: bool) -> MarketWriter:
        if missing := {"rows", "cols"} - {k.lower() for k in self.options}:
            raise FormatError(f"options {sorted(missing)} are missing")
        return MarketWriter(self.options["path"], int(self.options["rows"]), int(self.options["cols"]), Kind(self.options.get("kind", "real")), overwrite)


def read(spark: SparkSession, path: str, base: int = 1, seed: int = 0, each: int = EACH) -> Matrix:
    """A matrix from a file or folder; the number of entries is that of the lines there are."""
    spark.dataSource.register(MatrixMarket)
    head, _ = head_of(path)
    entries = spark.read.format("matrixmarket").option("base", base).option("bytesperpartition", each).load(path)
    if head.kind is Kind.pattern:
        entries = entries.withColumn("v", uniform("k", "c", seed, high=10.0))
    return Matrix(entries, head.rows, head.cols)


def write(m: Matrix, path: str, kind: Kind = Kind.real, overwrite: bool = False) -> None:
    """A folder of parts in row-major order."""
    m.df.sparkSession.dataSource.register(MatrixMarket)
    dealt = m.df.select("k", "c", "v").repartitionByRange(partitions_for(m.df), "k", "c").sortWithinPartitions("k", "c")
    dealt.write.format("matrixmarket").options(rows=m.rows, cols=m.cols, kind=kind.value, path=path).mode("overwrite" if overwrite else "append").save()
