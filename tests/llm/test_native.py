"""PII, exact dedup, fingerprints: against plain versions, and edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, fingerprints, pii

DOCS = "doc_id long, text string, lang string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base(text):
    found, counts = [], []
    for k, (name, (pattern, ok)) in enumerate(PLAIN.items()):
        mine = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m[0])]
        counts.append(len(mine))
        found += mine
    return counts, [x[2] for x in sorted(found)]


def test_pii_spans(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in ("ab.@-+%_012 é🙂\n", "0123456789 -.+4", "ab@.c_d-e", "+1 ()2345.") for _ in range(300)]
    texts += [None, "", "1" * 3000, "card 4111 1111 1111 1111.", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "256.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.scan(df).collect():
        counts, spans = base(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(","))
    assert pii.scan(df.where("false")).count() == 0


def test_pii_model_and_redaction(spark):
    text = 'api_key = "abcdef0123456789abcdef0123456789" phone: (555) 123-4567; order no. 123-456-7890; mail a@b.org é'
    df = spark.createDataFrame([(1, text, "en", 5), (2, None, None, None), (3, "a@b.org@c.de", "x", 1)], "doc_id long, text string, t string, n_email int")
    rows = {r.doc_id: r for r in pii.redact(df).collect()}
    assert rows[1].text == 'api_key = "[SECRET]" phone: [LOCAL_PHONE]; order no. 123-456-7890; mail [EMAIL] é'
    assert rows[1].t == "en" and rows[1].n_email == 5 and rows[2].text is None and "[EMAIL]" in rows[3].text


def test_pii_generators_need_nothing_else(spark):
    """An address without two digits in a row is found, whatever else the text has."""
    text = "mac a1:b2:c3:d4:e5:f6 of the device"
    df = spark.createDataFrame([(0, text), (1, text + " 12")], "doc_id long, text string")
    assert [r.spans for r in pii.scan(df).collect()] == ["mac:4:21"] * 2
    assert pii.redact(df).where("doc_id = 0").first().text == "mac [MAC] of the device"


def groups(texts):
    out = {}
    for i, t in texts:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        out.setdefault(key, []).append(i)
    return out


@pytest.fixture(scope="module")
def copies():
    return [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "ÀB"), (6, "àb"), (7, "x" * 50_000), (8, "X" * 50_000), (9, "abd"), (10, "abc")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)], ids=["whole", "weak"])
def test_exact_groups(spark, copies, digest):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    rows = exact_dedup.exact_groups(df, digest).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in copies]
    for members in groups(copies).values():
        mine = [r for r in rows if r.doc_id in members]
        assert {(r.keep_id, r.group_size) for r in mine} == {(max(members), len(members))}
        assert [r.doc_id for r in mine if r.kept] == [max(members)]


def test_exact_over_batches(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    rows = exact_dedup.exact_groups(df, files_per_batch=1).collect()
    assert {r.doc_id for r in rows if r.kept} == {max(m) for m in groups(copies).values()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)], ids=["whole", "weak"])
def test_exact_state_outlives_a_call(spark, copies, digest, tmp_path):
    """The second call hits what the first has seen, by content where digests collide."""
    state = f"file://{tmp_path}/state"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = exact_dedup.exact_groups(frame(copies[:6]), digest, state=state).collect()
    later = [*copies[6:], (11, "ABC"), (12, "new one"), (0, None)]
    second = exact_dedup.exact_groups(frame(later), digest, state=state).collect()
    for rows, seen in ((first, copies[:6]), (second, copies[:6] + later)):
        held = {i: m for m in groups(seen).values() for i in m}
        for r in rows:
            assert (r.keep_id, r.group_size, r.kept) == (max(held[r.doc_id]), len(held[r.doc_id]), r.doc_id == max(held[r.doc_id]))
    assert sorted(r.doc_id for r in second) == sorted(i for i, _ in later)
    assert exact_dedup.exact_groups(frame([(13, "abc")]).where("false"), digest, state=state).count() == 0


def test_exact_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "A", "y"), (None, "b", "z"), (2, "c", None)], DOCS)
    rows = exact_dedup.exact_groups(df).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 3
    left = exact_dedup.drop_copies(df.withColumn("digest", F.lit(1)).withColumn("kept", F.lit(2)))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "b"), (1, "a"), (2, "c")]
    assert left.columns == ["doc_id", "text", "lang", "digest", "kept"]
    assert exact_dedup.exact_groups(df.where("false")).count() == 0


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 300, 900]))) for _ in range(30)]
    texts += ["", None, "one", "one", texts[0]]
    docs = [(10 * i, t) for i, t in enumerate(texts)] + [(10**15, texts[1]), (-(10**15), "a b c d e f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    order = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b, c = shingle_set(t), shingle_set(edited), shingle_set(following)
        for value, other in ((got[i].near_edited, b), (got[i].near_next, c)):
            want = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(value - want) < 0.16
    assert got[0].fingerprint == got[340].fingerprint and len(got[0].fingerprint) == 512
    only = fingerprints.fingerprints(df.where("doc_id = 0")).first()
    assert only.near_next == 1.0
    assert fingerprints.fingerprints(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], "doc_id long, text string")
    assert fingerprints.fingerprints(odd).count() == 4
