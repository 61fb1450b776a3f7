"""Token ids in directly addressable codes.

An id is split into chunks of eight bits.  Level 0 holds the lowest chunk of
every id; a bitmap marks ids that continue, and the next level holds one chunk
for each of those.  A directory of ranks (ones before every 512th bit) finds an
id's place on the next level at once, so any token is read without decoding
others.

A file, all numbers little endian::

    magic "QDAC0001" | documents, tokens, levels: u64
    doc ids: i64 each | has an id: u8 each | start of each document, and the end: u64
    per level: length u64 | chunks u8 each | bitmap, padded to 8 bytes | ranks u64

Files are written in ascending ``doc_id`` order (null first), each under a
temporary name and moved when whole, so a task that runs again replaces its
files.  Edge cases: null or empty text has the end id alone; very long texts are
whole in one file, however few others it then has; repeated rows, and rows with
one ``doc_id``, are all written, by the hash of their texts; an empty table gives
no files and no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, partitions_for, running_sum, text_of, work_path, written
from .tokens import byte_encoder, offsets_of

MAGIC = b"QDAC0001"
RANK_BITS = 512
#: A file is closed after this many tokens.
FILE_TOKENS = 4 << 20


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % 8))
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(((rest & 255).astype(np.uint8), bits, ranks))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(8)


def to_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack_levels(ids)
    parts = [MAGIC, np.array([len(doc_ids), len(ids), len(levels)], "<u8"), np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], "u1"), starts.astype("<u8")]
    for chunks, bits, ranks in levels:
        parts += [np.array([len(chunks)], "<u8"), chunks, bits, ranks]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class TokenFile:
    """A file's bytes, read by place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.data, self.at = data, 8
        docs, self.n_tokens, levels = map(int, self.take("<u8", 3))
        ids, has = self.take("<i8", docs), self.take("u1", docs)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has, strict=True)]
        self.starts = self.take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(self.take("<u8", 1)[0])
            self.levels.append((self.take("u1", n), self.take("u1", -(-n // 64) * 8), self.take("<u8", -(-n // RANK_BITS) + 1)))

    def take(self, kind: str, n: int) -> np.ndarray:
        found = np.frombuffer(self.data, kind, n, self.at)
        self.at += found.nbytes
        return found

    def token(self, i: int) -> int:
        """Token i of the file: one step for each level it has, no decoding of others."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i // 8] >> (i % 8) & 1:
                break
            block = i // RANK_BITS
            before = bits[block * RANK_BITS // 8 : i // 8]
            i = int(ranks[block]) + int(np.unpackbits(before).sum()) + int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count()
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end of the file."""
        out = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        lo, hi = start, end
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            first = lo - lo % RANK_BITS
            window = np.unpackbits(bits[first // 8 : -(-hi // 8)], bitorder="little").astype(bool)
            more = window[lo - first : hi - first]
            if not more.any():
                break
            where = where[more]
            lo = int(ranks[first // RANK_BITS]) + int(window[: lo - first].sum())
            hi = lo + len(where)
        return out


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode and write; returns path, start and tokens of the files, one row each.

    The running sum of tokens is made in two levels, so that neither the driver
    nor one task holds a row of every file.
    """
    bounded_batches(docs.sparkSession)
    kind = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("name", pa.string()), ("tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, model = TaskContext.get().partitionId(), byte_encoder(tokenizer)
        store, at = filesystem(folder)
        store.create_dir(at, recursive=True)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = number = 0

        def close() -> pa.RecordBatch:
            nonlocal number, held
            name = f"part-{part:07d}-{number:05d}.qdac"
            temporary = f"{at}/.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(to_bytes(doc_ids, offsets_of(np.concatenate(sizes)), np.concatenate(ids)))
            if store.get_file_info(f"{at}/{name}").type.name != "NotFound":
                store.delete_file(f"{at}/{name}")
            store.move(temporary, f"{at}/{name}")
            row = pa.RecordBatch.from_pylist([{"part": part, "number": number, "name": name, "tokens": held}], kind)
            number, held = number + 1, 0
            doc_ids.clear(), ids.clear(), sizes.clear()
            return row

        for batch in batches:
            for first, found, offsets in model.batches(batch.column(1)):
                k, n = 0, len(offsets) - 1
                names = batch.column(0).slice(first, n).to_pylist()
                while k < n:
                    # Documents up to the one that fills the file.
                    end = min(n, int(np.searchsorted(offsets, offsets[k] + file_tokens - held)))
                    end = max(end, k + 1)
                    doc_ids += names[k:end]
                    ids.append(found[offsets[k] : offsets[end]])
                    sizes.append(np.diff(offsets[k : end + 1]))
                    held += int(offsets[end] - offsets[k])
                    k = end
                    if held >= file_tokens:
                        yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # Rows of one id (or of none) have a set order, so that a task that runs again writes the same files, and may be many tasks.
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order)
    files = written(ordered.mapInArrow(write, "part long, number long, name string, tokens long"), "token-manifest")
    before = running_sum(files.groupBy("part").agg(F.sum("tokens").alias("n")), "part", "n", "before")
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(before, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return written(placed.select(F.concat(F.lit(folder + "/"), "name").alias("path"), "start", "tokens"), "token-places")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = filesystem(row["path"])
                with store.open_input_stream(name) as f:
                    held = TokenFile(f.read())
                if held.n_tokens != row["tokens"]:
                    raise ValueError(f"{row['path']} is not the file that was written")
                ids, marks = memoryview(held.tokens(0, held.n_tokens).astype("<u4").tobytes()), (4 * held.starts).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(marks, marks[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(held.doc_ids, pa.int64()), pa.array(held.starts[:-1] + row["start"]), pa.array(np.diff(held.starts)), pa.array(crc, pa.int64())], schema=kind)

    n = files.count()
    return files.repartition(max(1, min(n, 100_000)), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = work_path(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, tokenizer))
