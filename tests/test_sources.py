"""MatrixMarket files, binary form, generators."""

import pytest

from quillon.functions import hashing
from quillon.matrix import Matrix, ShapeError
from quillon.sources import generators
from quillon.sources import matrix_market as mm

HEAD = "%%MatrixMarket matrix coordinate real general"


def put(tmp_path, text):
    path = tmp_path / "m.mtx"
    path.write_text(text)
    return str(path)


def entries(m):
    return sorted(map(tuple, m.df.collect()))


def test_forms(spark, tmp_path):
    read = lambda text, **x: entries(mm.read(spark, put(tmp_path, text), **x))
    assert read(f"{HEAD}\n% note\n2 3 2\n1 1 2.5\n2 3 -1\n") == [(0, 0, 2.5), (1, 2, -1.0)]
    assert read(f"{HEAD}\n2 2 1\n0 1 1\n") == [(0, 1, 1.0)]
    assert read(f"{HEAD}\n2 2 1\n2 2 1\n1 1 9\n") == [(1, 1, 1.0)]
    assert read(f"{HEAD}\n3 3 3\n3 3 3\n1 1 1\n1 2 1\n") == [(0, 0, 1.0), (0, 1, 1.0), (2, 2, 3.0)]
    symmetric = "%%MatrixMarket matrix coordinate integer symmetric\n2 2 2\n1 1 4\n2 1 5\n"
    assert read(symmetric) == [(0, 0, 4.0), (0, 1, 5.0), (1, 0, 5.0)]
    assert read("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 2 3\n") == [(0, 0, 5.0)]
    pattern = "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n1 2\n"
    first = read(pattern, seed=3)
    assert first == read(pattern, seed=3) and 0 <= first[0][2] < 10


@pytest.mark.parametrize(
    "text",
    [
        "",
        "%MatrixMarket matrix coordinate real general\n1 1 1\n1 1 1\n",
        "%%MatrixMarket tensor coordinate real general\n1 1 1\n1 1 1\n",
        "%%MatrixMarket matrix list real general\n1 1 1\n1 1 1\n",
        "%%MatrixMarket matrix coordinate odd general\n1 1 1\n1 1 1\n",
        "%%MatrixMarket matrix array real general\n1 1\n1\n",
        "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 1\n",
        f"{HEAD}\n2 2 2\n1 1 1\n",
        f"{HEAD}\n2 2 1\n3 1 1\n",
        f"{HEAD}\n2 2 1\n1 1\n",
    ],
)
def test_malformed(spark, tmp_path, text):
    with pytest.raises((mm.FormatError, ShapeError)):
        mm.read(spark, put(tmp_path, text))


def test_round_trips(spark, tmp_path):
    m = Matrix(spark.createDataFrame([(0, 2, 2.5), (2, 0, -3.0)], "k long, c long, v double"), 3, 3)
    mm.write(m, str(tmp_path / "text"))
    back = mm.read(spark, str(tmp_path / "text"))
    assert entries(back) == entries(m) and (back.rows, back.cols) == (3, 3)
    mm.write(m, str(tmp_path / "packed"), compressed=True)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "packed.aux")).orderBy("compressed_row").collect()] == [(1, 1), (2, 3)]
    assert mm.read(spark, str(tmp_path / "packed")).rows == 2
    mm.write_binary(m, str(tmp_path / "binary"))
    assert entries(mm.read_binary(spark, str(tmp_path / "binary"))) == entries(m)
    blocks = spark.createDataFrame([(0, 1, [1.0, 2.0, 3.0, 4.0])], "br long, bc long, vals array<double>")
    mm.write_blocks(blocks, 2, 4, 4, str(tmp_path / "blocks"))
    assert [(r.br, r.bc, len(r.vals)) for r in mm.read_blocks(spark, str(tmp_path / "blocks"), 2).collect()] == [(0, 1, 4)]
    assert [r.line for r in mm.dump(m).collect()] == ["(0, 2): 2.5", "(2, 0): -3.0"]


@pytest.mark.parametrize("scale", [4, 8])
def test_graph(spark, scale):
    edges = generators.power_law_edges(spark, scale, 4)
    found = {tuple(r) for r in edges.collect()}
    assert len(found) == edges.count() == 2 * (4 << scale)  # both directions of exactly so many
    assert all(s != d and (d, s) in found and 0 <= s < 2**scale for s, d in found)
    assert found == {tuple(r) for r in generators.power_law_edges(spark, scale, 4).collect()}


@pytest.mark.parametrize("scale", [1, 3, 8, 12])
def test_scramble_is_a_permutation(spark, scale):
    from pyspark.sql import functions as F

    df = spark.range(1 << scale).select(generators.scrambled(F.col("id"), scale).alias("x"))
    assert sorted(r.x for r in df.collect()) == list(range(1 << scale))


def test_random_values(spark):
    from pyspark.sql import functions as F

    m = generators.random_dense(spark, 50, 40, seed=1)
    low, high, mean = m.df.agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert -1 <= low < -0.9 and 0.9 < high < 1 and abs(mean) < 0.1
    normal = generators.random_dense(spark, 50, 40, normal=True).df.agg(F.avg("v"), F.stddev("v")).first()
    assert abs(normal[0]) < 0.1 and abs(normal[1] - 1) < 0.1
    assert spark.range(1).select(hashing.base_name(F.lit("/a/b.c")), hashing.round_up(F.lit(13), 8)).first()[:] == ("b.c", 16)


def test_stream(spark, tmp_path):
    from quillon.streaming.profile import running_profile

    spark.createDataFrame([("a", 2), ("a", 5), ("b", 1)], "label string, elapsed long").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("label string, elapsed long").parquet(str(tmp_path / "log"))
    query = running_profile(stream).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("seen").collect()} == {("a", 2, 7, 5, 2), ("b", 1, 1, 1, 1)}


def test_text_over_several_parts(spark, tmp_path):
    """What is written in parts is read again, whatever order the parts come in."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m = generators.random_dense(spark, 200, 200, seed=3)
        mm.write(m, str(tmp_path / "parts"))
        assert len(list((tmp_path / "parts").glob("part-*"))) > 1
        back = mm.read(spark, str(tmp_path / "parts"))
        assert (back.rows, back.cols) == (200, 200) and entries(back) == entries(m)
        assert mm.read_csr(spark, str(tmp_path / "parts")).count() == 200
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_rows_by_suffix_and_dumps(spark, tmp_path):
    m = Matrix(spark.createDataFrame([(0, 2, 2.5), (2, 0, -3.0)], "k long, c long, v double"), 3, 3)
    mm.write_binary(m, str(tmp_path / "m.bin"))
    rows = mm.read_csr(spark, str(tmp_path / "m.bin"))
    assert [r.line for r in mm.dump_rows(rows).collect()] == ["(0, 2): 2.5", "(2, 0): -3.0"]
    empty = Matrix(m.df.where("false"), 3, 3)
    assert [r.line for r in mm.dump(empty).collect()] == ["<Empty matrix>"] == [r.line for r in mm.dump_rows(rows.where("false")).collect()]
    blocks = spark.createDataFrame([(0, 1, [1.0, 2.0])], "br long, bc long, vals array<double>")
    assert [r.line for r in mm.dump_blocks(blocks).collect()] == ["(0, 1): 1.0 2.0"]


def test_graph_that_cannot_be(spark):
    with pytest.raises(ShapeError):
        generators.power_law_edges(spark, 2, 4)


def test_strings(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(hashing.joined(F.lit("a"), F.lit(None), F.lit(1)), hashing.repeated(F.lit("ab"), 3), hashing.suffix(F.lit("/x.y/c.bin")), hashing.suffix(F.lit("/x.y/c"))).first()
    assert tuple(row) == ("a1", "ababab", "bin", "")
