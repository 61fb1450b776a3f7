"""Keyed state over streams: the same rows as the batch forms, under any cut into batches and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import layout, metrics
from quillon.streaming import keyed

LOG = "label string, ts timestamp, at long, kind string"
MINUTE = 60_000_000


def put(spark, folder, rows, schema, number):
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    frame.write.mode("append").parquet(f"{folder}/in-{number}")
    return f"{folder}/in-{number}"


def run(spark, folder, schema, operator, batches, name):
    """Each batch is a run of its own that goes on from the checkpoint of those before."""
    import os
    import shutil

    source = f"{folder}/{name}-source"
    os.makedirs(source)
    with keyed.rocksdb(spark):
        for n, rows in enumerate(batches):
            made = put(spark, folder, rows, schema, f"{name}-{n}")
            for k, x in enumerate(sorted(x for x in os.listdir(made) if x.endswith(".parquet"))):
                shutil.copy(f"{made}/{x}", f"{source}/{n:03d}-{k}.parquet")
            stream = operator(spark.readStream.schema(schema).parquet(source))
            query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}-out").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    return [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{folder}/{name}-out").collect()]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), at * MINUTE // 7 + (at % 3), rng.choice(["begin", "end", "end"])) for at in sorted(rng.randrange(2000) for _ in range(160))]
    return [r for r in rows]


def stamped(rows):
    import datetime

    zero = datetime.datetime(2024, 1, 1)
    base = int(zero.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000
    return [(x, zero + datetime.timedelta(microseconds=at), base + at, kind) for x, at, kind in rows]


@pytest.mark.parametrize("cuts", [1, 4])
def test_pairs_of_a_stream(spark, tmp_path, log, cuts):
    rows = stamped(log)
    late = stamped([("z", 10_000 * MINUTE, "begin")])  # moves the watermark past all others
    size = -(-len(rows) // cuts)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    batches = [random.Random(n).sample(b, len(b)) for n, b in enumerate(batches)] + [late, stamped([("z", 10_001 * MINUTE, "begin")])]
    got = run(spark, str(tmp_path), LOG, lambda s: keyed.paired(s, "0 seconds"), batches, f"pairs{cuts}")
    want = metrics.paired(spark.createDataFrame([(x, at, kind) for x, _, at, kind in rows], "label string, at long, kind string")).collect()
    assert sorted((r[0], r[3]) for r in got if r[4] == "pair") == sorted((r.label, r.elapsed) for r in want)
    ends = sum(kind == "end" for *_, kind in rows)
    assert sum(r[4] in ("pair", "unmatched") for r in got if r[0] != "z") == ends


def test_open_begins_are_given_up(spark, tmp_path):
    rows = [("a", 0, "begin"), ("a", 30 * MINUTE, "end"), ("b", 0, "begin"), ("b", MINUTE, "end"), ("c", 5, "begin")]
    late = [[("z", t * MINUTE, "begin")] for t in (100, 200, 300)]
    got = run(spark, str(tmp_path), LOG, lambda s: keyed.paired(s, "0 seconds", within=10 * MINUTE), [stamped(rows), *map(stamped, late)], "open")
    assert sorted((r[0], r[4]) for r in got if r[0] != "z") == [("a", "open"), ("a", "unmatched"), ("b", "pair"), ("c", "open")]


@pytest.mark.parametrize("cuts", [1, 3])
def test_lookups_of_a_stream(spark, tmp_path, cuts):
    rng = random.Random(4)
    rows = [(rng.choice("abcd"), at, rng.choice(["insert", "query", "query"]), f"v{at}") for at in range(90)] + [("e", 90, "query", None)]
    schema = "key string, at long, kind string, value string"
    size = -(-len(rows) // cuts)
    got = run(spark, str(tmp_path), schema, keyed.looked_up, [rows[i : i + size] for i in range(0, len(rows), size)], f"look{cuts}")
    held = layout.first_inserted(spark.createDataFrame([(k, at, v) for k, at, kind, v in rows if kind == "insert"], "key string, at long, value string"), ["key"], "at", "value")
    first = {r.key: r.value for r in held.collect()}
    want = [(k, at, first[k] if k in first and int(first[k][1:]) < at else None) for k, at, kind, _ in rows if kind == "query"]
    assert sorted(map(str, got)) == sorted(map(str, want))
