"""MatrixMarket text files, and Parquet as the binary form."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..matrix import Matrix
from ..operators.layout import block_expanded, csr_rows, rebased, renumbered, symmetric
from .files import FormatError, place


class Kind(str, Enum):
    real = "real"
    complex = "complex"
    pattern = "pattern"
    integer = "integer"


class Storage(str, Enum):
    general = "general"
    symmetric = "symmetric"
    hermitian = "hermitian"
    skew = "skew-symmetric"


@dataclass(frozen=True)
class Header:
    coordinate: bool
    kind: Kind
    storage: Storage
    rows: int
    cols: int
    entries: int

    def code(self) -> str:
        return " ".join(["matrix", "coordinate" if self.coordinate else "array", self.kind.value, self.storage.value])

    def text(self) -> str:
        return f"%%MatrixMarket {self.code()}\n{self.rows} {self.cols} {self.entries}"


def parse_banner(line: str) -> tuple[bool, Kind, Storage]:
    words = line.split()
    if len(words) != 5 or words[0] != "%%MatrixMarket":
        raise FormatError(f"no banner: {line[:80]!r}")
    if words[1] != "matrix":
        raise FormatError(f"not a matrix: {words[1]}")
    if words[2] not in ("coordinate", "array"):
        raise FormatError(f"unknown format {words[2]}")
    try:
        return words[2] == "coordinate", Kind(words[3]), Storage(words[4])
    except ValueError as e:
        raise FormatError(str(e)) from None


def parse_header(lines: list[str]) -> Header:
    """The header of a file, from its first lines; % lines after the banner are comments."""
    if not lines:
        raise FormatError("an empty file")
    coordinate, kind, storage = parse_banner(lines[0])
    size = next((x for x in lines[1:] if x.strip() and not x.startswith("%")), None)
    if size is None:
        raise FormatError("no line of sizes")
    try:
        numbers = [int(x) for x in size.split()]
    except ValueError:
        raise FormatError(f"sizes: {size!r}") from None
    if len(numbers) != (3 if coordinate else 2) or min(numbers[:2]) <= 0 or numbers[-1] < 0:
        raise FormatError(f"sizes: {size!r}")
    return Header(coordinate, kind, storage, numbers[0], numbers[1], numbers[2] if coordinate else numbers[0] * numbers[1])


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines and their place: file by name, part of the file, and the order inside the part."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(F.trim("value").alias("line"), place.alias("place"))


def first_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines up to that of sizes, however many comments there are, from the first file."""
    lines, n = placed_lines(spark, path), 64
    first = lines.agg(F.min("place.file")).first()[0]
    if first is None:
        return []
    lines = lines.where((F.col("place.file") == first) & (F.col("place.part") == 0)).orderBy("place").select("line")
    while True:
        head = [r.line for r in lines.limit(n).collect()]
        if len(head) < n or any(x and not x.startswith("%") for x in head[1:]):
            return head
        n *= 4


def read(spark: SparkSession, path: str, force_symmetric: bool = False, seed: int = 0, complex_as_sum: bool = True) -> Matrix:
    """A sparse matrix from a coordinate file.

    Pattern entries get seeded values, 10 times a hash in [0, 1).  Complex values
    become the sum of their parts.  If an index is 0 the file counts from 0.
    Skew and hermitian files are refused unless ``force_symmetric``.
    """
    header = parse_header(first_lines(spark, path))
    if not header.coordinate:
        raise FormatError("a dense file; only coordinate files are read")
    if header.storage in (Storage.skew, Storage.hermitian) and not force_symmetric:
        raise FormatError(f"{header.storage.value} files are only read as symmetric, on request")
    if header.kind is Kind.complex and not complex_as_sum:
        raise FormatError("complex values")
    rows = placed_lines(spark, path).where("line <> '' and not line like '\\%%'")
    n, sizes = rows.agg(F.count(F.lit(1)), F.min("place")).first()
    if n - 1 < header.entries:
        raise FormatError(f"{n - 1} entries, not {header.entries}")
    rows = rows.where(F.col("place") > F.struct(F.lit(sizes.file).alias("file"), F.lit(sizes.part).cast("long").alias("part"), F.lit(sizes["at"]).cast("long").alias("at")))
    if n - 1 > header.entries:  # what follows the entries is not read
        rows = first_rows(rows, header.entries)
    words = F.split("line", r"\s+")
    need = {Kind.pattern: 2, Kind.complex: 4}.get(header.kind, 3)
    value = {Kind.pattern: F.lit(0.0), Kind.complex: words[2].cast("double") + words[3].cast("double")}.get(header.kind, words[2].cast("double"))
    short = rows.where(F.size(words) < need).limit(1).collect()
    if short:
        raise FormatError(f"an entry of too few words: {short[0].line!r}")
    entries = rows.select(words[0].cast("long").alias("k"), words[1].cast("long").alias("c"), value.alias("v"))
    entries = rebased(entries) if header.entries else entries
    found = Matrix(entries, header.rows, header.cols).validated()
    if header.kind is Kind.pattern:
        found = Matrix(found.df.withColumn("v", uniform("k", "c", seed, high=10.0)), found.rows, found.cols)
    if force_symmetric or header.storage is Storage.symmetric:
        found = Matrix(symmetric(found.df), found.rows, found.cols)
    return found


def read_csr(spark: SparkSession, path: str, force_symmetric: bool = False) -> DataFrame:
    """k, cols, vals: from a binary form if the suffix is ``bin`` (Parquet if it is a folder), else from text."""
    from . import csr_binary

    if path.rstrip("/").rpartition(".")[2] != "bin":
        return csr_rows(read(spark, path, force_symmetric))
    system, name = place(path)
    whole = system.get_file_info(name).type == fs.FileType.File
    return csr_rows(csr_binary.read(spark, path) if whole else read_binary(spark, path))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by place: the rank within a file's part, after the parts before it."""
    part = [F.col("place.file").alias("file"), F.col("place.part").alias("part")]
    counts = rows.groupBy(*part).count()
    before = counts.select("file", "part", F.coalesce(F.sum("count").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.select("line", *part, "place").withColumn("r", F.row_number().over(Window.partitionBy("file", "part").orderBy("place")))
    return ranked.join(before, ["file", "part"]).where(F.col("before") + F.col("r") <= n).select("line", "place")


def write(m: Matrix, folder: str, pattern: bool = False, compressed: bool = False) -> None:
    """A folder of text parts in order, the header in the first.

    ``compressed``: rows are numbered without gaps, and ``folder``.aux has the
    original number of each.
    """
    spark, entries = m.df.sparkSession, m.df
    rows = m.rows
    if compressed:
        numbers = renumbered(m)
        rows = numbers.count()
        numbers.orderBy("compressed_row").write.parquet(f"{folder}.aux")
        entries = entries.join(numbers, entries["k"] == numbers["original_row"] - 1).select((F.col("compressed_row") - 1).alias("k"), "c", "v")
    header = Header(True, Kind.pattern if pattern else Kind.real, Storage.general, rows, m.cols, m.df.count())
    head = spark.createDataFrame([(-1, i, x) for i, x in enumerate(header.text().split("\n"))], "k long, c long, line string")
    body = lines_with_place(Matrix(entries, rows, m.cols), pattern)
    head.unionByName(body).orderBy("k", "c").select("line").write.text(folder)


def lines_with_place(m: Matrix, pattern: bool) -> DataFrame:
    value = [] if pattern else [F.col("v").cast("string")]
    return m.df.select(F.col("k").cast("long").alias("k"), F.col("c").cast("long").alias("c"), F.concat_ws(" ", (F.col("k") + 1).cast("string"), (F.col("c") + 1).cast("string"), *value).alias("line"))


def write_binary(m: Matrix, folder: str) -> None:
    """Parquet with values; the shape is in a file beside it."""
    m.df.select("k", "c", "v").write.parquet(f"{folder}/entries")
    m.df.sparkSession.createDataFrame([(m.rows, m.cols)], "rows long, cols long").write.parquet(f"{folder}/shape")


def read_binary(spark: SparkSession, folder: str) -> Matrix:
    rows, cols = spark.read.parquet(f"{folder}/shape").first()
    return Matrix(spark.read.parquet(f"{folder}/entries"), rows, cols)


def write_blocks(blocks: DataFrame, size: int, rows: int, cols: int, folder: str, index_only: bool = True) -> None:
    """Block coordinates alone, as a pattern, or all their entries."""
    if index_only:
        m = Matrix(blocks.select(F.col("br").alias("k"), F.col("bc").alias("c"), F.lit(1.0).alias("v")), -(-rows // size), -(-cols // size))
    else:
        m = Matrix(block_expanded(blocks, size), rows, cols)
    write(m, folder, pattern=index_only)


def read_blocks(spark: SparkSession, path: str, size: int, seed: int = 0) -> DataFrame:
    """br, bc, vals from a pattern file of block coordinates; payloads are seeded."""
    if parse_header(first_lines(spark, path)).kind is not Kind.pattern:
        raise FormatError("a file of block coordinates is a pattern")
    places = read(spark, path, seed=seed).df.select(F.col("k").alias("br"), F.col("c").alias("bc"))
    return places.withColumn("vals", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda p: F.shiftrightunsigned(F.xxhash64("br", "bc", p, F.lit(seed)), 11).cast("double") / float(1 << 53)))


def lines_or(empty: str, lines: DataFrame) -> DataFrame:
    """The lines in order, or one that says there is nothing."""
    if lines.limit(1).count():
        return lines
    return lines.sparkSession.createDataFrame([(empty,)], "line string")


def dump(m: Matrix) -> DataFrame:
    """Lines "(k, c): v" in order; an empty matrix says so."""
    return lines_or("<Empty matrix>", m.df.orderBy("k", "c").select(F.format_string("(%d, %d): %s", F.col("k").cast("long"), F.col("c").cast("long"), F.col("v").cast("string")).alias("line")))


def dump_rows(rows: DataFrame) -> DataFrame:
    """The same lines from rows (k, cols, vals)."""
    cells = rows.select("k", F.posexplode(F.arrays_zip("cols", "vals")).alias("p", "e")).orderBy("k", "p")
    return lines_or("<Empty matrix>", cells.select(F.format_string("(%d, %d): %s", F.col("k").cast("long"), F.col("e.cols").cast("long"), F.col("e.vals").cast("string")).alias("line")))


def dump_blocks(blocks: DataFrame) -> DataFrame:
    """Lines "(br, bc): values" of blocks (br, bc, vals)."""
    values = F.concat_ws(" ", F.transform("vals", lambda v: v.cast("string")))
    return lines_or("<Empty matrix>", blocks.orderBy("br", "bc").select(F.format_string("(%d, %d): %s", F.col("br").cast("long"), F.col("bc").cast("long"), values).alias("line")))
