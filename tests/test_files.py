"""Files as data sources: the binary row form and MatrixMarket, whole, broken, and written by tasks that fail."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.matrix import Matrix
from quillon.sources import csr_binary, files, market_format, matrix_market
from quillon.sources.files import FormatError
from quillon.sources.matrix_market import Kind


def matrix(spark, entries, rows=50, cols=40):
    return Matrix(spark.createDataFrame(entries, "k long, c long, v double").repartition(3), rows, cols)


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(5)
    return [(rng.choice([0, 7, 7, 7, 20, 21, 48]), rng.randrange(40), rng.randrange(100) / 4) for _ in range(900)]


def places(df):
    return sorted((r.k, r.c) for r in df.collect())


# Binary


@pytest.mark.parametrize("each, width", [(7, 4), (100, 8), (1 << 20, 4)])
def test_binary_round_trip(spark, tmp_path, entries, each, width):
    path = str(tmp_path / "m.bin")
    csr_binary.write(matrix(spark, entries), path, width)
    raw = open(path, "rb").read()
    assert list(np.frombuffer(raw, "<u8", 3)) == [50, 40, 900] and len(raw) == 24 + (51 + 900) * width
    lengths = [sum(k == r for k, _, _ in entries) for r in range(50)]
    assert list(np.frombuffer(raw, f"<i{width}", 51, 24)) == [sum(lengths[:r]) for r in range(51)]
    got = csr_binary.read(spark, path, width=width, each=each)
    assert (got.rows, got.cols) == (50, 40) and places(got.df) == sorted((k, c) for k, c, _ in entries)
    assert got.df.rdd.getNumPartitions() == -(-900 // each)
    assert 0 <= got.df.agg(F.min("v")).first()[0] and os.listdir(tmp_path) == ["m.bin"]
    rows = {r.k: r.cols for r in matrix_market.read_csr(spark, path).collect()} if width == 4 else None
    assert rows is None or rows[7] == sorted(c for k, c, _ in entries if k == 7)


def test_binary_by_its_name_alone(spark, tmp_path, entries):
    csr_binary.write(matrix(spark, entries), str(tmp_path / "m.bin"))
    df = spark.read.format("csrbinary").load(str(tmp_path / "m.bin"))
    assert df.columns == ["k", "c"] and df.count() == 900
    empty = Matrix(spark.createDataFrame([], "k long, c long, v long"), 3, 2)
    csr_binary.write(empty, str(tmp_path / "none.bin"))
    assert csr_binary.read(spark, str(tmp_path / "none.bin")).df.count() == 0


def test_broken_binary(spark, tmp_path, entries):
    path = str(tmp_path / "m.bin")
    csr_binary.write(matrix(spark, entries), path)
    whole = open(path, "rb").read()
    for raw in (whole[:-1], whole[:10], b"", whole + b"x", whole[:24] + b"\x01" + whole[25:]):
        (tmp_path / "bad.bin").write_bytes(raw)
        with pytest.raises(FormatError):
            csr_binary.read(spark, str(tmp_path / "bad.bin"))
    outside = np.frombuffer(whole, "<i4", offset=24).copy()
    outside[51 + 450] = 40  # a column that there is not
    (tmp_path / "bad.bin").write_bytes(whole[:24] + outside.tobytes())
    with pytest.raises(Exception, match="a column outside 40"):
        csr_binary.read(spark, str(tmp_path / "bad.bin"), each=64).df.count()
    outside[51 + 450], outside[10] = 0, 899
    (tmp_path / "bad.bin").write_bytes(whole[:24] + outside.tobytes())
    with pytest.raises(Exception, match="not in order"):
        csr_binary.read(spark, str(tmp_path / "bad.bin")).df.count()
    with pytest.raises(Exception, match="exists"):
        csr_binary.write(matrix(spark, entries), path)
    csr_binary.write(matrix(spark, entries[:5]), path, overwrite=True)
    assert csr_binary.read(spark, path).df.count() == 5


def test_binary_tasks_that_run_twice_or_fail(spark, tmp_path, entries):
    path = str(tmp_path / "m.bin")
    writer = csr_binary.CsrWriter(path, csr_binary.Head(2, 9, 3, 4), False)
    batch = lambda rows: iter([pa.RecordBatch.from_pylist([dict(zip(("kind", "at", "value"), r, strict=True)) for r in rows])])
    first, second = [(0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 4)], [(1, 1, 5), (1, 2, 6)]
    writer.write(batch(first[:2]))  # an attempt that is lost
    done = [writer.write(batch(first)), writer.write(batch(second))]
    writer.write(batch(second))  # and one whose result came too late
    assert not os.path.exists(path)
    writer.commit(done)
    assert places(csr_binary.read(spark, path).df) == [(0, 4), (0, 5), (1, 6)] and os.listdir(tmp_path) == ["m.bin"]
    writer = csr_binary.CsrWriter(str(tmp_path / "n.bin"), csr_binary.Head(2, 9, 3, 4), False)
    with pytest.raises(FormatError):
        writer.commit([writer.write(batch(first))])
    writer.abort([])
    assert os.listdir(tmp_path) == ["m.bin"]


# MatrixMarket


@pytest.mark.parametrize("each", [11, 300, 1 << 20])
def test_market_round_trip(spark, tmp_path, entries, each):
    path = str(tmp_path / "m.mtx")
    market_format.write(matrix(spark, entries), path)
    got = market_format.read(spark, path, each=each)
    assert sorted(map(tuple, got.df.collect())) == sorted(entries) and (got.rows, got.cols) == (50, 40)
    again = matrix_market.read(spark, path)  # the strict reader takes the same parts
    assert sorted(map(tuple, again.df.collect())) == sorted(entries)
    assert spark.read.format("matrixmarket").load(path).columns == ["k", "c", "v"]
    assert os.listdir(tmp_path) == ["m.mtx"] and sorted(os.listdir(path))[0] == "part-00000000"


@pytest.mark.parametrize("each", [1, 5, 64])
def test_market_files_of_others(spark, tmp_path, each):
    def put(text):
        (tmp_path / "a.mtx").write_text(text)
        return str(tmp_path / "a.mtx")

    read = lambda text, **x: sorted(map(tuple, market_format.read(spark, put(text), each=each, **x).df.collect()))
    assert read("%%MatrixMarket matrix coordinate real general\n% note\n\n2 3 2\n1 1 2.5\n%x\n2 3 -1") == [(0, 0, 2.5), (1, 2, -1.0)]
    assert read("%%MatrixMarket matrix coordinate integer symmetric\n2 2 2\n1 1 4\n2 1 5\n") == [(0, 0, 4.0), (0, 1, 5.0), (1, 0, 5.0)]
    assert read("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 2 3\n") == [(0, 0, 5.0)]
    assert read("%%MatrixMarket matrix coordinate real general\n2 2 1\n0 1 1\n", base=0) == [(0, 1, 1.0)]
    pattern = read("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n1 2\n")
    assert pattern[0][:2] == (0, 1) and 0 <= pattern[0][2] < 10
    assert read("%%MatrixMarket matrix coordinate real general\n2 2 0\n") == []
    for text in ("2 2 1\n3 1 1\n", "2 2 1\n1 1\n", "2 2 1\n0 1 1\n", "2 2 1\n1 x 1\n"):
        with pytest.raises(Exception, match="outside|too few|invalid"):
            read("%%MatrixMarket matrix coordinate real general\n" + text)
    for head in ("%%MatrixMarket matrix array real general\n1 1\n1\n", "", "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 1\n"):
        with pytest.raises(Exception, match="FormatError|not read|no banner|empty"):
            read(head)


def test_market_tasks_that_run_twice_or_fail(spark, tmp_path):
    path = str(tmp_path / "m.mtx")
    writer = market_format.MarketWriter(path, 4, 4, Kind.integer, False)
    part = lambda rows: iter([pa.RecordBatch.from_pylist([dict(zip("kcv", r, strict=True)) for r in rows])])

    class Context:
        number = 0

        def partitionId(self):
            return self.number

    held, market_format.TaskContext = market_format.TaskContext, type("T", (), {"get": staticmethod(Context)})
    try:
        writer.write(part([(0, 0, 1)]))  # lost before its result was reported
        done = [writer.write(part([(0, 0, 1), (1, 1, 2)]))]
        Context.number = 1
        done.append(writer.write(part([(3, 3, 3)])))
    finally:
        market_format.TaskContext = held
    assert not os.path.exists(path)
    writer.commit(done[::-1])
    assert sorted(map(tuple, matrix_market.read(spark, path).df.collect())) == [(0, 0, 1.0), (1, 1, 2.0), (3, 3, 3.0)]
    assert [open(f"{path}/{x}").read() for x in sorted(os.listdir(path))][1:] == ["1 1 1\n2 2 2\n", "4 4 3\n"]

    bad = Matrix(spark.range(100).selectExpr("id as k", "id as c", "id as v"), 50, 50)  # fails in some task
    with pytest.raises(Exception, match="outside 50 x 50"):
        market_format.write(bad, str(tmp_path / "n.mtx"))
    assert os.listdir(tmp_path) == ["m.mtx"]
    with pytest.raises(Exception, match="exists"):
        market_format.write(matrix(spark, [(0, 0, 1.0)]), path)
    market_format.write(matrix(spark, [(0, 0, 1.0)]), path, overwrite=True)
    assert matrix_market.read(spark, path).df.count() == 1


@pytest.mark.parametrize("step", [3, 10, 1000])
def test_lines_belong_to_one_range(tmp_path, step):
    text = b"a\n\nbbbb\ncc\nlast one without an end"
    (tmp_path / "t").write_bytes(text)
    system, name = files.place(f"file://{tmp_path}/t")
    for each in (1, 2, 5, 9, 100):
        got = [x for low in range(0, len(text), each) for some in files.lines_from(system, name, low, min(low + each, len(text)), step) for x in some]
        assert got == text.split(b"\n")
