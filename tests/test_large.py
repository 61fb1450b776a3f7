"""Sizes and values beyond those of the small tables."""

import numpy as np
import pandas as pd

from quillon.llm import tokens
from quillon.operators import kernels
from quillon.plans import work
from quillon.streaming import keyed


def test_products_beyond_a_long(spark):
    """Whole products that a long does not hold are exact, also of one another; those that fit stay longs."""
    rows = [(0, 0, 3_000_000_001), (0, 1, 4_000_000_007), (1, 1, -5_000_000_009)]
    a = spark.createDataFrame(rows, "i long, j long, v long")
    held = {(i, j): v for i, j, v in rows}
    square = {(i, j): sum(held.get((p, i), 0) * held.get((p, j), 0) for p in (0, 1)) for i in (0, 1) for j in (0, 1)}
    both = kernels.gemm(a, a, transpose_a=True)
    assert {(r.i, r.j): int(r.v) for r in both.collect()} == square
    got = kernels.gemm(a, both, alpha=2, beta=3, c=a)
    want = {(i, j): 2 * sum(held.get((i, p), 0) * square[p, j] for p in (0, 1)) + 3 * held.get((i, j), 0) for i in (0, 1) for j in (0, 1)}
    assert max(map(abs, want.values())) > 2**63
    assert {(r.i, r.j): int(r.v) for r in got.collect()} == want
    assert dict(kernels.gemm(a.selectExpr("i", "j", "v div 1000 v"), a.selectExpr("i", "j", "v div 1000 v")).dtypes)["v"] == "bigint"
    assert dict(kernels.gemm(a, a, alpha=0.5).dtypes)["v"] == "double"


def test_ranges_follow_what_is_read(spark, tmp_path):
    """Joined tables are dealt to as many ranges as their bytes need, not their product."""
    for name in ("a", "b"):
        spark.range(300_000).selectExpr("id", "xxhash64(id) AS x").write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("a", "b"))
    both = a.join(b.withColumnRenamed("x", "y"), "id")
    assert work.size_of(both) > 1 << 40
    assert work.partitions_for(both) == 4
    assert 4 < work.partitions_for(a, each=1 << 18) <= work.partitions_for(both, each=1 << 18) < 100


def test_no_encoder_outlives_a_task_that_keeps_no_words():
    """What a worker held for packing is given up, and the next task has its own."""
    held = tokens.word_encoder()
    assert tokens.word_encoder() is held
    tokens.drop_encoders()
    assert not tokens._encoders and tokens.word_encoder() is not held


def test_a_range_pairs_rows_by_their_neighbours():
    """Repeats at one time, begins that another follows, and begins that were open for too long."""
    at, begins = np.array([0, 0, 0, 5, 9, 50, 51]), np.array([True, True, False, False, True, False, True])
    rows = [(r.what, r.began, r.at) for part in keyed.between("a", at, begins, 20) for r in part.itertuples()]
    assert [(w, None if b is pd.NA else b, None if t is pd.NA else t) for w, b, t in rows] == [("open", 9, None), ("replaced", 0, None), ("pair", 0, 0), ("unmatched", None, 5), ("unmatched", None, 50)]
