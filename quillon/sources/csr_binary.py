"""The binary row form as a data source: ``spark.read.format("csrbinary")``.

A file is three unsigned 64-bit numbers (rows, columns, entries), the row pointer
(rows + 1 numbers) and the columns of the entries, row after row; numbers are
little-endian, of 4 bytes (or 8: option ``indexbytes``).  Values are not stored.

A partition reads a range of bytes of the columns, and finds the row of its first
entry by halving the pointer part, of which it then reads what its entries need.
Tasks that write put their numbers where they belong in one file under another
name, so a task that runs twice writes the same bytes twice; the file gets its name
when all tasks are done and their numbers add up.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.hashing import uniform
from ..matrix import Matrix
from ..operators.layout import row_pointer
from ..operators.ranks import ranked
from ..plans.work import partitions_for
from .files import FormatError, local_path, parts_of, place

HEAD = 24
#: Entries of a partition, and numbers that are read at once.
EACH, STEP = 4 << 20, 1 << 18


@dataclass(frozen=True)
class Head:
    rows: int
    cols: int
    entries: int
    width: int

    @property
    def columns_at(self) -> int:
        return HEAD + (self.rows + 1) * self.width

    @property
    def size(self) -> int:
        return self.columns_at + self.entries * self.width


def numbers(f, at: int, count: int, width: int) -> np.ndarray:
    raw = f.read_at(count * width, at)
    if len(raw) != count * width:
        raise FormatError(f"{len(raw)} bytes at {at}, not {count * width}")
    return np.frombuffer(raw, np.dtype(f"<i{width}")).astype(np.int64)


def read_head(path: str, width: int = 4) -> Head:
    """The head of a file whose size, first pointer and last pointer fit it."""
    system, name = place(path)
    [(name, size)] = parts_of(system, name)
    with system.open_input_file(name) as f:
        raw = f.read_at(HEAD, 0)
        if len(raw) < HEAD:
            raise FormatError(f"{path}: {len(raw)} bytes are no head")
        head = Head(*(int(x) for x in np.frombuffer(raw, "<u8")), width)
        if not head.rows or not head.cols or head.size != size:
            raise FormatError(f"{path}: {size} bytes, but {head.size} for {head.rows} x {head.cols} with {head.entries} entries")
        ends = [int(numbers(f, HEAD + k * width, 1, width)[0]) for k in (0, head.rows)]
    if ends != [0, head.entries]:
        raise FormatError(f"{path}: pointers go from {ends[0]} to {ends[1]}, not from 0 to {head.entries}")
    return head


def row_at(f, head: Head, entry: int) -> int:
    """The row of an entry: the last whose pointer is not beyond it."""
    low, high = 0, head.rows  # pointer[low] <= entry < pointer[high]
    while high - low > 1:
        middle = (low + high) // 2
        if numbers(f, HEAD + middle * head.width, 1, head.width)[0] <= entry:
            low = middle
        else:
            high = middle
    return low


@dataclass
class Range(InputPartition):
    low: int
    high: int


class CsrReader(DataSourceReader):
    def __init__(self, path: str, width: int, each: int):
        self.path, self.width, self.each = path, width, each

    def partitions(self) -> list[Range]:
        n = read_head(self.path, self.width).entries
        return [Range(low, min(n, low + self.each)) for low in range(0, n, self.each)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        head = read_head(self.path, self.width)
        system, name = place(self.path)
        with system.open_input_file(name) as f:
            at = part.low
            row = row_at(f, head, at) if part.high > part.low else 0
            while at < part.high:
                ends = numbers(f, HEAD + (row + 1) * head.width, min(STEP, head.rows - row), head.width)
                if ends[0] < at or np.any(np.diff(ends) < 0):
                    raise FormatError(f"{self.path}: pointers after row {row} are not in order")
                stop = int(min(ends[-1], part.high))
                for low in range(at, stop, STEP):
                    high = min(low + STEP, stop)
                    cols = numbers(f, head.columns_at + low * head.width, high - low, head.width)
                    if len(cols) and (cols.min() < 0 or cols.max() >= head.cols):
                        raise FormatError(f"{self.path}: a column outside {head.cols} among entries {low} to {high}")
                    rows = row + np.searchsorted(ends, np.arange(low, high), side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(cols, pa.int64())], names=["k", "c"])
                at, row = max(at, stop), row + len(ends)


@dataclass
class Done(WriterCommitMessage):
    pointers: int
    columns: int


class CsrWriter(DataSourceArrowWriter):
    """Rows (kind, at, value): kind 0 is the pointer of row ``at``, kind 1 the column of entry ``at``."""

    def __init__(self, path: str, head: Head, overwrite: bool):
        self.path, self.head = local_path(path), head
        if os.path.exists(self.path) and not overwrite:
            raise FormatError(f"{path} exists")
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.temporary, "wb") as f:
            f.write(np.array([head.rows, head.cols, head.entries], "<u8").tobytes())
            f.truncate(head.size)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        head, counts = self.head, [0, 0]
        kind = np.dtype(f"<i{head.width}")
        with open(self.temporary, "r+b") as f:
            for batch in batches:
                kinds, at, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                for k, base in enumerate((HEAD, head.columns_at)):
                    mine, value = at[kinds == k], values[kinds == k]
                    if len(value) and (value.max() > np.iinfo(kind).max or value.min() < 0):
                        raise FormatError(f"{value.max()} does not fit in {head.width} bytes")
                    for run, part in zip(*(np.split(x, np.flatnonzero(np.diff(mine) != 1) + 1) for x in (mine, value)), strict=True):
                        if len(run):
                            f.seek(base + int(run[0]) * head.width)
                            f.write(part.astype(kind).tobytes())
                    counts[k] += len(value)
            f.flush()
            os.fsync(f.fileno())
        return Done(*counts)

    def commit(self, messages: list[Done | None]) -> None:
        found = [sum(getattr(m, x) for m in messages if m) for x in ("pointers", "columns")]
        if found != [self.head.rows + 1, self.head.entries]:
            os.remove(self.temporary)
            raise FormatError(f"{found} numbers were written for {self.head}")
        os.replace(self.temporary, self.path)

    def abort(self, messages: list[Done | None]) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


class CsrBinary(DataSource):
    """Options: ``path``, ``indexbytes`` (4), ``entriesperpartition``; to write, ``rows``, ``cols`` and ``entries``."""

    @classmethod
    def name(cls) -> str:
        return "csrbinary"

    def schema(self) -> str:
        return "k long, c long"

    def option(self, name: str, default: int | None = None) -> int:
        value = self.options.get(name, default)
        if value is None:
            raise FormatError(f"option {name} is missing")
        return int(value)

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options["path"], self.option("indexbytes", 4), self.option("entriesperpartition", EACH))

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        head = Head(self.option("rows"), self.option("cols"), self.option("entries"), self.option("indexbytes", 4))
        return CsrWriter(self.options["path"], head, overwrite)


def read(spark: SparkSession, path: str, seed: int = 0, width: int = 4, each: int = EACH) -> Matrix:
    """A matrix from a binary file; its values, which the file does not have, are 10 times a hash in [0, 1)."""
    head = read_head(path, width)
    spark.dataSource.register(CsrBinary)
    entries = spark.read.format("csrbinary").option("indexbytes", width).option("entriesperpartition", each).load(path)
    return Matrix(entries.withColumn("v", uniform("k", "c", seed, high=10.0)), head.rows, head.cols)


def write(m: Matrix, path: str, width: int = 4, overwrite: bool = False) -> None:
    """The structure of ``m`` (repeats too) as one binary file."""
    spark = m.df.sparkSession
    spark.dataSource.register(CsrBinary)
    columns = ranked(m.df.select("k", "c"), ["k", "c"]).select(F.lit(1).alias("kind"), F.col("pos").alias("at"), F.col("c").cast("long").alias("value"))
    n = columns.count()
    pointers = row_pointer(m).select(F.lit(0).alias("kind"), F.col("k").cast("long").alias("at"), F.col("start").alias("value"))
    last = spark.range(1).select(F.lit(0).alias("kind"), F.lit(m.rows).cast("long").alias("at"), F.lit(n).cast("long").alias("value"))
    both = pointers.unionByName(last).unionByName(columns)
    dealt = both.repartitionByRange(partitions_for(both), "kind", "at").sortWithinPartitions("kind", "at")
    writer = dealt.write.format("csrbinary").options(rows=m.rows, cols=m.cols, entries=n, indexbytes=width, path=path)
    writer.mode("overwrite" if overwrite else "append").save()
