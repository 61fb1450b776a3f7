"""Bloom filters, structure and values apart, stored tiles, tuning."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from quillon.matrix import Matrix, ShapeError
from quillon.operators import bloom, kernels, structure
from quillon.plans import tuning
from quillon.sources import tile_store

ENTRIES = [(0, 2, 2), (0, 0, 1), (2, 3, 5), (2, 0, 3), (3, 1, -1), (3, 3, 4)]
INPUTS = [(0, [1, 2, 3, 4]), (1, [0, 1, 0, -1])]
GRADS = [(0, [1, 1, 1, 1]), (1, [2, 0, -1, 3])]


@pytest.fixture(scope="module")
def m(spark):
    return Matrix(spark.createDataFrame(ENTRIES, "k long, c long, v long"), 4, 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "n long, x array<long>")


@pytest.mark.parametrize("keys, held", [(1 << 20, 16 << 20), (500, 16 << 20), (500, 0)])
def test_bloom(spark, monkeypatch, keys, held):
    """One filter, several, and several that rows are dealt to: every key that was put in is found."""
    monkeypatch.setattr(bloom, "KEYS", keys)
    monkeypatch.setattr(bloom, "HELD", held)
    inside = spark.range(0, 12_000, 2).selectExpr("id as src", "cast(id % 7 as string) as dst")
    made = bloom.built(inside.repartition(3), ["src", "dst"], 0.02)
    assert made.count == max(1, -(-6000 // keys)) and made.filters.count() == made.count
    found = made.maybe(spark.range(0, 12_000).selectExpr("id as src", "cast(id % 7 as string) as dst", "id as more"))
    by = {r["even"]: (r["hits"], r["n"]) for r in found.groupBy((F.col("src") % 2 == 0).alias("even")).agg(F.sum(F.col("maybe").cast("int")).alias("hits"), F.count("more").alias("n")).collect()}
    assert by[True] == (6000, 6000) and by[False][1] == 6000 and by[False][0] <= 6000 * 0.02 * 1.5
    assert found.columns == ["src", "dst", "more", "maybe"]
    none = bloom.built(inside.where("false"), ["src", "dst"])
    assert none.maybe(inside).where("maybe").count() == 0


def test_bloom_of_one_hot_key_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(bloom, "KEYS", 10)
    monkeypatch.setattr(bloom, "HELD", 0)
    inside = spark.createDataFrame([(None, 1), (2, None), (3, 3)] + [(i, 9) for i in range(50)], "a long, b long")
    made = bloom.built(inside, ["a", "b"])
    asked = spark.range(3000).selectExpr("3L as a", "3L as b", "id").unionByName(inside.selectExpr("a", "b", "-1L as id"))
    assert made.maybe(asked).where("maybe").count() == 3053


def test_unseen_keys(spark):
    drawn = spark.createDataFrame([(1, 2), (1, 2), (3, 4), (5, 6)], "src long, dst long")
    held = spark.createDataFrame([(3, 4), (3, 4), (8, 8)], "src long, dst long")
    for rate in (0.5, 0.001):
        assert sorted(map(tuple, bloom.unseen(drawn, held, ["src", "dst"], rate).collect())) == [(1, 2), (5, 6)]
    assert bloom.unseen(drawn.where("false"), held, ["src", "dst"]).count() == 0


def test_values_change_over_one_structure(spark, m):
    held, values = structure.taken_apart(Matrix(m.df.union(m.df.where("k = 0")), 4, 4))  # entries that repeat, too
    assert values.count() == 8 and [r.pos for r in held.back.orderBy("pos_t").collect()] == [0, 1, 4, 6, 2, 3, 5, 7]
    for step in (1, -3):
        want = {(r.n, r.c): r.d for r in kernels.backward(held.matrix(values), frame(spark, GRADS)).collect()}
        assert {(r.n, r.c): r.d for r in held.backward(values, frame(spark, GRADS)).collect()} == want
        x, g = (frame(spark, rows).select("n", F.posexplode("x").alias(a, b)) for rows, a, b in ((INPUTS, "c", "x"), (GRADS, "k", "g")))
        change = held.update(x, g)
        assert [r.v for r in change.orderBy("pos").collect()] == [1, 1, 3, 3, 1, 5, 5, 1]
        before = {r.pos: r.v for r in values.collect()}
        values = structure.stepped(values, change, step)
        assert {r.pos: r.v - before[r.pos] for r in values.collect()} == {r.pos: step * r.v for r in change.collect()}
    plan = held.transposed(values).df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()  # the order of the transposed places is read, not made again


@pytest.fixture
def stored(spark, tmp_path):
    run, made = uuid.uuid4().hex, []

    def put(name, rows, nb=2, buckets=3):
        made.append(f"t_{name}_{run}")
        return tile_store.store(frame(spark, rows), made[-1], 4, nb, buckets)

    yield put
    for table in made:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_stored_tiles(spark, m, stored):
    x, g = stored("x", [*INPUTS, (7, [1, 1, 1, 1]), (7, [1, 0, 0, 0])]), stored("g", [*GRADS, (7, [1, 2, 0, 1]), (9, [5, 5, 5, 5])])
    want = sorted(map(tuple, kernels.update_vectors(m, x.vectors(spark), g.vectors(spark).withColumnRenamed("x", "g")).collect()))
    found = tile_store.update(m, x, g)
    assert sorted(map(tuple, found.collect())) == want
    want = sorted(map(tuple, kernels.forward(m, x.vectors(spark)).collect()))
    assert sorted(map(tuple, tile_store.forward(m, x).collect())) == want
    assert tile_store.update(Matrix(m.df.where("false"), 4, 4), x, g).count() == 0
    with pytest.raises(ShapeError):
        tile_store.update(m, x, tile_store.Tiles(g.table, 4, 3, 3))
    with pytest.raises(Exception, match="without n"):
        stored("bad", [(None, [1, 2, 3, 4])])


def test_stored_tiles_meet_without_an_exchange(spark, m, stored):
    """Also where neither side is small enough to be broadcast."""
    x, g = stored("p", INPUTS), stored("q", GRADS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tile_store.update(m, x, g)._jdf.queryExecution().executedPlan().toString()
        inside = plan[plan.index("MapInArrow") :] if "MapInArrow" in plan else plan
        dense = inside[: inside.rindex("FileScan")]
        assert re.search("SortMergeJoin|ShuffledHashJoin", dense) and inside.count("Bucketed: true") == 2 and "Exchange" not in dense
        assert "Exchange" not in tile_store.forward(m, x)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tuning_chooses_by_time(spark, m):
    def refused(w, x):
        raise ShapeError("not this one")

    x = spark.range(600).selectExpr("id as n", "array(id, 1L, 0L, -id) as x")
    found = tuning.measured(m, x, {"plain": lambda w, v: kernels.forward(w, v, "blocked"), "refused": refused}, sample=50)
    assert [t.name for t in found] == ["plain"] and found[0].total >= 0
    called = []
    forms = {k: (lambda w, v, k=k: called.append(k) or kernels.forward(w, v, k)) for k in ("blocked", "coordinate")}
    out = tuning.tuned(m, x, forms, sample=50)
    assert out.count() == 2400 and called.count("blocked") + called.count("coordinate") == 7
    assert {r.config for r in tuning.report(m, x, candidates=forms, sample=20).collect()} == {"blocked", "coordinate"}
