"""A hand-worked 4 x 4 matrix with an empty row, and the shapes that break."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.matrix import Matrix, ShapeError
from quillon.operators import kernels, layout, metrics, tensor

ENTRIES = [(0, 2, 2), (0, 0, 1), (2, 3, 5), (2, 0, 3), (3, 1, -1), (3, 3, 4)]
INPUTS = [(0, [1, 2, 3, 4]), (1, [0, 1, 0, -1])]
GRADS = [(0, [1, 1, 1, 1]), (1, [2, 0, -1, 3])]


@pytest.fixture(scope="module")
def m(spark):
    return Matrix(spark.createDataFrame(ENTRIES, "k long, c long, v long"), 4, 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "n long, x array<long>")


def cells(df, name):
    return df.select("n", F.posexplode("x").alias("c" if name == "x" else "k", name))


@pytest.mark.parametrize("strategy", [None, "vector", "coordinate", "blocked", "tiled"])
def test_products(spark, m, strategy):
    out = {(r.n, r.k): r.o for r in kernels.forward(m, frame(spark, INPUTS), strategy).collect()}
    assert [[out[n, k] for k in range(4)] for n in range(2)] == [[7, 0, 23, 14], [0, 0, -5, -5]]
    out = {(r.n, r.c): r.d for r in kernels.backward(m, frame(spark, GRADS), strategy).collect()}
    assert [[out[n, c] for c in range(4)] for n in range(2)] == [[4, -1, 2, 9], [-1, -3, 4, 7]]


def test_update_keeps_every_entry(spark, m):
    x, g = cells(frame(spark, INPUTS), "x"), cells(frame(spark, GRADS), "g")
    out = kernels.update(m, x, g).orderBy("k", "c").collect()
    assert [r.dv for r in out] == [1, 3, 1, 5, 5, 1]
    blocked = kernels.blocked_update(m, x, g, 2, 2, 1).orderBy("k", "c").collect()
    assert [r.dv for r in blocked] == [1, 3, 1, 5, 5, 1]
    none = kernels.update(m, x.where("n < 0"), g)
    assert [r.dv for r in none.collect()] == [0] * 6


def test_unknown_kernel(spark, m):
    with pytest.raises(ValueError):
        kernels.forward(m, frame(spark, INPUTS), "other")


@pytest.mark.parametrize("n", [1, 15, 16, 79, 80, 81, 145, 159])
def test_batch_sizes(spark, m, n):
    got = kernels.forward(m, frame(spark, [(i, [i, 1, 0, -i]) for i in range(n)]), "blocked").collect()
    assert {(r.n, r.k): r.o for r in got} == {(i, k): o for i in range(n) for k, o in enumerate([i, 0, -2 * i, -1 - 4 * i])}


def test_layouts(m):
    rows = {r.k: (list(r.cols), list(r.vals)) for r in layout.csr_rows(m).collect()}
    assert rows == {0: ([0, 2], [1, 2]), 2: ([0, 3], [3, 5]), 3: ([1, 3], [-1, 4])}
    assert [r.start for r in layout.row_pointer(m).orderBy("k").collect()] == [0, 2, 2, 4]
    assert [tuple(r) for r in layout.row_table(m).orderBy("i").collect()] == [(0, 0, 0), (1, 2, 2), (2, 3, 4)]
    assert [r.pos for r in layout.transpose_map(m).orderBy("pos_t").collect()] == [0, 2, 4, 1, 3, 5]
    assert {(r.kb, r.cb): r.nnz for r in layout.block_counts(m, 2, 2).collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 2, (1, 1): 2}
    assert sum(r.v for r in layout.densified(m).collect()) == 14
    back = layout.block_expanded(layout.block_payloads(m, 3), 3).where("v <> 0").collect()
    assert sorted(map(tuple, back)) == sorted(ENTRIES)


def test_slices_and_shapes(spark, m):
    assert sorted(map(tuple, m.slice_rows(2, 2).df.collect())) == [(0, 0, 3), (0, 3, 5), (1, 1, -1), (1, 3, 4)]
    with pytest.raises(ShapeError):
        m.slice_rows(3, 2)
    with pytest.raises(ShapeError):
        Matrix(m.df, 3, 4).validated()
    with pytest.raises(ShapeError):
        Matrix(m.df, 0, 4)
    empty = Matrix(m.df.where("false"), 2, 4)
    assert [r.o for r in kernels.forward(empty, frame(spark, INPUTS), "blocked").collect()] == [0] * 4
    doubled = Matrix(m.df.union(m.df), 4, 4)
    assert doubled.coalesced().df.agg(F.sum("v")).first()[0] == 28


def test_tensors(spark):
    t = tensor.filled(spark, (2, 3, 4), F.col("i0") + 10 * F.col("i1") + 100 * F.col("i2"))
    assert t.strides == (1, 2, 6) and t.size == 24 and t.rank == 3
    assert [r.v for r in t.fiber(1, i0=1, i2=2).orderBy("i").collect()] == [201, 211, 221]
    assert t.ordered(backwards=True).first().offset == 23
    assert t.at(1, 2, 3).first().v == 321
    assert tensor.from_nested(spark, [[1, 2], [3, 4]]).dims == (2, 2)
    with pytest.raises(ShapeError):
        tensor.from_nested(spark, [[1, 2], [3]])
    with pytest.raises(ShapeError):
        t.fiber(1, i0=1)


def test_errors_and_profile(spark):
    e = spark.createDataFrame([(0, 3.0), (1, 4.0)], "i int, v double")
    a = spark.createDataFrame([(0, 3.0), (1, 4.5)], "i int, v double")
    assert metrics.errors(e, a, ["i"]).first().rel_l2 == pytest.approx(0.1)
    assert not metrics.close(e, a, ["i"]) and metrics.close(e, e, ["i"])
    assert not metrics.close(e, spark.createDataFrame([(0, float("nan")), (1, 4.0)], "i int, v double"), ["i"])
    log = spark.createDataFrame([("a", 2, 10), ("a", 4, 10), ("b", 5, 0)], "label string, elapsed long, ops long")
    rows = {r.label: r for r in metrics.profile(log).collect()}
    assert rows["b"].rate is None and rows["Total"].most == 9 and rows["a"].average == 3


FORMS = ["vector", "coordinate", "blocked", "tiled"]


@pytest.mark.parametrize("strategy", FORMS)
def test_shapes_of_products(spark, m, strategy):
    for x in ([1], [1, 2, 3, 4, 5], None):
        with pytest.raises(Exception, match="ShapeError"):
            kernels.forward(m, frame(spark, [(0, x)]), strategy).collect()


def test_shapes_of_other_products(spark, m):
    cells = spark.createDataFrame([(0, 0, 1)], "i long, j long, v long")
    with pytest.raises(ShapeError):
        kernels.gemm(cells, cells, shapes=((2, 3), (2, 3)))
    assert kernels.gemm(cells, cells, transpose_b=True, shapes=((2, 3), (2, 3))).count() == 1
    with pytest.raises(ShapeError):
        kernels.spmv(m, spark.createDataFrame([(4, 1)], "c long, x long"))
    assert [r.y for r in kernels.spmv(m, spark.createDataFrame([(0, 2)], "c long, x long")).orderBy("k").collect()] == [2, 0, 6, 0]


@pytest.mark.parametrize("strategy", FORMS)
def test_decimals_keep_their_digits(spark, strategy):
    m = Matrix(spark.createDataFrame([(0, 0, 2.5), (1, 1, 0.25)], "k long, c long, v double").selectExpr("k", "c", "cast(v as decimal(10,2)) as v"), 2, 2)
    x = spark.createDataFrame([(0, [2, 3])], "n long, x array<long>")
    assert sorted((r.k, r.o) for r in kernels.forward(m, x, strategy).collect()) == [(0, 5.0), (1, 0.75)]


def test_decimals_in_updates(spark, m):
    x = cells(frame(spark, INPUTS), "x").selectExpr("n", "c", "cast(x / 2 as decimal(10,1)) as x")
    out = kernels.update(m, x, cells(frame(spark, GRADS), "g")).orderBy("k", "c").collect()
    assert [r.dv for r in out] == [0.5, 1.5, 0.5, 2.5, 2.5, 0.5]


def test_whole_number_division(spark):
    big = 2**53 + 1
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(-7).cast("long").alias("b")).select(hashing.floor_div("a", 1), hashing.ceil_div("a", 1), hashing.floor_div("b", 2), hashing.ceil_div("b", 2), layout.div(F.lit(2**62 + 3), 4)).first()
    assert tuple(row) == (big, big, -4, -3, 2**60)


@pytest.mark.parametrize("tiles", [(2, 3, 2), (1, 1, 1), (256, 256, 64)])
def test_tiles_of_any_size(spark, m, tiles):
    kb, cb, nb = tiles
    x, g = frame(spark, [(0, [1, 2, 3, 4]), (7, [0, 1, 0, -1])]), frame(spark, [(0, [1, 1, 1, 1]), (7, [2, 0, -1, 3])])
    out = {(r.n, r.k): r.o for r in kernels.tiled(m, x, "long", kb, cb, nb).collect()}
    assert [[out[n, k] for k in range(4)] for n in (0, 7)] == [[7, 0, 23, 14], [0, 0, -5, -5]]
    back = kernels.update_vectors(m, x, g.withColumnRenamed("x", "g"), kb, cb, nb).orderBy("k", "c").collect()
    assert [r.dv for r in back] == [1, 3, 1, 5, 5, 1]
    empty = Matrix(m.df.where("false"), 2, 4)
    assert [r.o for r in kernels.tiled(empty, x, "long", kb, cb, nb).collect()] == [0] * 4
    assert kernels.tiled(m, x.where("n > 99"), "long", kb, cb, nb).count() == 0


def test_more_entries_than_are_collected(spark):
    n = 520_000
    m = Matrix(spark.range(n).selectExpr("id % 1000 as k", "(id * 7) % 1300 as c", "id % 5 - 2 as v"), 1000, 1300)
    x = spark.range(3).selectExpr("id as n", "transform(sequence(0, 1299), c -> (c * 3 + id) % 11 - 5) as x")
    want = {}
    for i in range(n):
        for b in range(3):
            key = (b, i % 1000)
            want[key] = want.get(key, 0) + (i % 5 - 2) * (((i * 7) % 1300 * 3 + b) % 11 - 5)
    assert {(r.n, r.k): r.o for r in kernels.forward(m, x).collect()} == want
    with pytest.raises(ShapeError):
        kernels.forward(m, x, "blocked")


def test_places_of_repeats(spark):
    rows = [(0, 1, 5), (0, 1, 3), (1, 0, 1), (0, 1, 3), (1, 1, 2), (2, 0, 9)]
    m = Matrix(spark.createDataFrame(rows, "k long, c long, v long").repartition(3), 3, 130)
    pairs = sorted(tuple(r) for r in layout.transpose_map(m).collect())
    order = sorted(range(6), key=lambda i: rows[i])
    by_column = sorted(range(6), key=lambda p: (rows[order[p]][1], rows[order[p]][0], p))
    assert pairs == list(enumerate(by_column))
    wide = Matrix(spark.range(300).selectExpr("0L as k", "(id * 7) % 300 as c", "1 as v"), 1, 300)  # one row that is cut into parts
    assert [(r.c, r.pos) for r in layout.positioned(wide).orderBy("c").collect()] == [(i, i) for i in range(300)]


def test_running_sums_over_ranges(spark):
    df = spark.range(50).selectExpr("id * 3 as k", "id as n").repartition(4)
    got = {r.k: (r.i, r.before) for r in layout.running(df, "k", {"i": F.lit(1), "before": F.col("n")}, span=16).collect()}
    assert got == {3 * i: (i, sum(range(i))) for i in range(50)}


def test_lookup_with_first_insert(spark):
    held = layout.first_inserted(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "key string, at int, name string"), ["key"], "at", "name")
    asked = spark.createDataFrame([("a",), ("c",)], "key string")
    assert sorted(tuple(r) for r in layout.looked_up(asked, held, ["key"], "name").collect()) == [("a", "y"), ("c", None)]


def test_padding_and_printing(spark):
    t = tensor.filled(spark, (2, 3), F.col("i0") * 10 + F.col("i1")).padded(2, 1)
    assert (t.rows, t.cols, t.leading, t.leading_size, t.strides) == (2, 3, (4, 4), 16, (1, 4))
    assert [r.offset for r in t.ordered().collect()] == [0, 1, 4, 5, 8, 9]
    assert [r.line for r in t.printed().collect()] == ["0 1 2", "10 11 12"]
    cube = tensor.filled(spark, (2, 2, 2), F.col("i0") + 2 * F.col("i1") + 4 * F.col("i2"))
    assert [r.line for r in cube.printed().collect()] == ["[:, :, 0]", "0 2", "1 3", "[:, :, 1]", "4 6", "5 7"]
    assert [r.line for r in tensor.constant(spark, (3,), 7).printed().collect()] == ["7"] * 3 and tensor.constant(spark, (3,), 7).length == 3
    low, high = tensor.random(spark, (20, 5, 4), seed=2, low=2.0, high=4.0).df.agg(F.min("v"), F.max("v")).first()
    assert 2 <= low < 2.1 and 3.9 < high < 4
    for bad in (lambda: t.padded(-1, 0), lambda: cube.rows, lambda: tensor.Tensor(t.df, (2, 3), (1, 3))):
        with pytest.raises(ShapeError):
            bad()


def test_norms_in_place(spark):
    df = spark.createDataFrame([(0, [3, -4]), (1, [0, 0])], "n long, x array<long>")
    assert [tuple(r)[2:] for r in tensor.array_norms(df).orderBy("n").collect()] == [(7, 25, 4), (0, 0, 0)]
    assert [r.x for r in tensor.array_normalised(df).orderBy("n").collect()] == [[0.6, -0.8], [0.0, 0.0]]


def test_listing_and_pairs(spark):
    log = spark.createDataFrame([("b", 2, 10), ("a", 4, 10)], "label string, elapsed long, ops long")
    assert [r.label for r in metrics.listing(log).collect()] == ["a", "b", "Total"]
    events = [("a", 1, "begin"), ("a", 25, "end"), ("a", 26, "end"), ("b", 3, "begin"), ("b", 95, "end"), ("b", 99, "begin"), ("b", 99, "end")]
    got = metrics.paired(spark.createDataFrame(events, "label string, at long, kind string"), span=10).collect()
    assert sorted(tuple(r) for r in got) == [("a", 24, False), ("b", 0, True), ("b", 92, True)]


ODD = [(0, [1, 2, 3, 4]), (7, [0, 1, 0, -1]), (7, [5, None, 1, 1]), (7, [5, None, 1, 1]), (None, [1, 1, 1, 1]), (None, [2, 0, 0, 0]), (9, [None] * 4)]


def plain_products(entries, rows, vectors):
    """Every vector by itself, repeats summed, nulls as 0."""
    out = []
    for n, x in vectors:
        o = [0] * rows
        for k, c, v in entries:
            o[k] += (v or 0) * (x[c] or 0)
        out += [(str(n), k, v) for k, v in enumerate(o)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "double"])
@pytest.mark.parametrize("strategy", [None, *FORMS])
def test_all_forms_give_the_same_rows(spark, strategy, kind):
    entries = [*ENTRIES, (0, 2, 7), (2, 3, None), (2, 3, 5)]
    w = Matrix(spark.createDataFrame(entries, "k long, c long, v long").selectExpr("k", "c", f"cast(v as {kind}) as v"), 4, 4)
    x = spark.createDataFrame(ODD, "n long, x array<long>").selectExpr("n", f"cast(x as array<{kind}>) as x").repartition(3)
    got = sorted((str(r.n), r.k, r.o) for r in kernels.forward(w, x, strategy).collect())
    assert got == plain_products(entries, 4, ODD)
    for bad in [(None, 0, 1), (0, None, 1), (4, 0, 1), (0, -1, 1)]:
        with pytest.raises(Exception, match="ShapeError"):
            kernels.forward(Matrix(w.df.union(spark.createDataFrame([bad], "k long, c long, v long")), 4, 4), x, strategy).collect()


@pytest.mark.parametrize("most, cb", [(3, 4), (3, 2), (1, 3), (1000, 1)])
def test_parts_of_crowded_rows(spark, most, cb):
    """A row with half of all entries is several parts, and so are strips; rows without entries are there."""
    entries = [(5, i % 4, i) for i in range(40)] + [(k, k % 4, 1) for k in range(0, 12, 2)] + [(1, 3, 2), (11, 0, 1)]
    w = Matrix(spark.createDataFrame(entries, "k long, c long, v long"), 14, 4)
    x = spark.createDataFrame(ODD, "n long, x array<long>")
    got = sorted((str(r.n), r.k, r.o) for r in kernels.tiled(w, x, "long", kb=5, cb=cb, nb=2, most=most).collect())
    assert got == plain_products(entries, 14, ODD)
    parts = kernels.row_parts(kernels.stored(w, "long"), 14, 5, cb, most).collect()
    assert max(len(r.c) for r in parts) <= 2 * most
    if most == 3 and cb == 4:
        assert sum(r.k[0] == 5 and r.piece >= 0 for r in parts) == 14


@pytest.mark.parametrize("strategy, most", [("held", 100), ("grid", 100), ("grid", 2), (None, 3)])
def test_updates_of_odd_rows(spark, strategy, most):
    entries = [*ENTRIES, (0, 2, 7), (2, 3, None)]
    w = Matrix(spark.createDataFrame(entries, "k long, c long, v long"), 4, 4)
    grads = [(0, [1, 1, 1, 1]), (7, [2, None, -1, 3]), (7, [1, 0, 0, 1]), (None, [9, 9, 9, 9]), (8, [1, 1, 1, 1])]
    x, g = spark.createDataFrame(ODD, "n long, x array<long>"), spark.createDataFrame(grads, "n long, g array<long>")
    met = [(a, b) for n, a in ODD for m_, b in grads if n is not None and n == m_]
    want = sorted((k, c, sum((a[c] or 0) * (b[k] or 0) for a, b in met)) for k, c, _ in entries)
    assert sorted(map(tuple, kernels.update_vectors(w, x, g, 3, 3, 2, most, strategy).collect())) == want
    there = lambda df, name, place: df.select("n", F.posexplode(name).alias(place, name))
    assert sorted(map(tuple, kernels.update(w, there(x, "x", "c"), there(g, "g", "k"), 2, 2, 2, most, strategy).collect())) == want
    if strategy == "held":
        with pytest.raises(ShapeError):
            kernels.update_vectors(w, x, g, most=2, strategy="held")


def test_grids_have_cells_for_all_tasks(spark):
    """Few columns and many vectors: the vectors are dealt to groups, so more than one task has rows."""
    w = Matrix(spark.range(640).selectExpr("id % 10 as k", "id % 64 as c", "id as v"), 10, 64)
    x = spark.range(4000).selectExpr("id as n", "transform(sequence(0, 63), c -> c + id) as x")
    out = kernels.tiled(w, x, "long", most=10_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join what is as small as here
    try:
        assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1 and out.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dense_matrix_times_vector(spark):
    a, x = spark.createDataFrame(ODD, "n long, x array<long>"), spark.createDataFrame([(0, 2), (3, -1), (3, 1), (1, None)], "c long, x long")
    want = sorted((str(n), 2 * (v[0] or 0)) for n, v in ODD)
    assert sorted((str(r.n), r.y) for r in kernels.gemv(a, x, 4).collect()) == want
    assert {r.y for r in kernels.gemv(a, x.where("false"), 4).collect()} == {0}
    import quillon.operators.kernels as module

    held, module.BROADCAST_ROWS = module.BROADCAST_ROWS, 1
    try:
        assert sorted((str(r.n), r.y) for r in kernels.gemv(a, x.where("c <> 3"), 4).collect()) == want
    finally:
        module.BROADCAST_ROWS = held


def test_pieces_of_rows(spark, m):
    got = {(r.k, r.piece): (r.cols, r.vals) for r in layout.csr_pieces(m, 1).collect()}
    assert got == {(0, 0): ([0], [1]), (0, 1): ([2], [2]), (2, 0): ([0], [3]), (2, 1): ([3], [5]), (3, 0): ([1], [-1]), (3, 1): ([3], [4])}
    assert sorted(map(tuple, layout.row_places(m).collect())) == [(0, 0, 0), (0, 1, 2), (2, 0, 0), (2, 1, 3), (3, 0, 1), (3, 1, 3)]
