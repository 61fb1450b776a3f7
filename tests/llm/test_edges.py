"""Odd rows for every operator and stage, plain versions of what SQL cannot say, and recall."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from quillon.llm import exact_dedup, fingerprints, html_text, near_join, packing, pieces, pii, sharding, token_files, tokens, toxicity

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
END = struct.pack("<I", tokens.END_ID)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and names that operators use themselves."""
    rows = [(1, "some text of a few words", "en"), (1, "some text of a few words", "en"), (None, "some text", None), (None, None, None), (2, "", "fr"), (3, LONG, "en"), (4, "Some Text", "x")]
    names = ["__score", "__node", "__off", "__gone", "__digest", "__d", "__id", "t", "slot2", "group", "guest"]
    df = spark.createDataFrame([(*r, "s", None, *["kept"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    return df.repartition(3)


def texts_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def test_token_files_of_odd_rows(odd):
    rows = token_files.round_trip(odd).collect()
    plain = [b"".join(x) + END for x in zip(tokens.byte_encoder().encode([t for _, _, t in texts_of(odd)]), strict=True)]
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(x) // 4, zlib.crc32(x)) for x in plain)
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack_documents(odd).collect()
    assert sum(r.length for r in rows) == sum(len(x) // 4 + 1 for x in tokens.word_encoder().encode([t for _, _, t in texts_of(odd)]))
    many = spark.createDataFrame([(5, "again and again")] * 3000, "doc_id long, text string")
    rows = packing.pack_documents(many, group=64).collect()  # one hot group, packed in parts
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == 3000 * rows[0].doc_tokens
    for x in by.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 4096


def first_fit(lengths, capacity):
    """First-fit decreasing, plainly: the first bin with room, one after the other."""
    free, out = [], {}
    for d, n in sorted(((d, n % capacity) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[1], x[0])):
        k = next((i for i, f in enumerate(free) if f >= n), len(free))
        free += [capacity] * (k == len(free))
        free[k] -= n
        out[d] = k
    return out


def test_first_fit_against_a_plain_search():
    rng = random.Random(11)
    for _ in range(20):
        lengths = [rng.randint(1, 300) for _ in range(60)]
        tree, got = packing.Tournament(60, 128), {}
        for d, n in sorted(((d, n % 128) for d, n in enumerate(lengths) if n % 128), key=lambda x: (-x[1], x[0])):
            got[d] = tree.first(n)
        assert got == first_fit(lengths, 128)


def test_fingerprints_of_odd_rows(odd):
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == 7 and all(len(r.fingerprint) == 512 and 0 <= r.near_next <= 1 for r in rows)
    assert sorted(r.n_chars for r in rows) == sorted(len(t) for _, _, t in texts_of(odd))
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1


def test_pieces_and_spans_of_odd_rows(odd):
    assert sorted(r.decoded for r in pieces.encoded(odd).collect()) == sorted(t for _, _, t in texts_of(odd))
    assert len(pii.scan(odd).collect()) == 7 and pii.redact(odd).columns == odd.columns


def test_pages_of_odd_rows(spark):
    long = "<article>" + "<p>".join(f"line {i} of a long page" for i in range(20_000))
    df = spark.createDataFrame([(1, "http://a/1", long, "x"), (1, "http://a/1", long, "x"), (None, None, None, None), (2, "", "", "y")], "page_id long, url string, html string, text string")
    rows = html_text.main_text(df).collect()
    assert len(rows) == 4 and sorted(r.n_chars for r in rows)[2:] == [len("\n".join(f"line {i} of a long page" for i in range(20_000)))] * 2
    assert html_text.main_text(df).columns == ["page_id", "url", "text", "n_chars"]


def test_placement_against_a_plain_table(spark, odd):
    """The table by the rule itself: turns, each the next free slot of its permutation."""
    names, slots = [f"shard-{i:04d}" for i in range(13)], 1009
    orders = []
    for name in names:
        h = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
    plain = {}
    while len(plain) < slots:
        for k, order in enumerate(orders):
            if len(plain) < slots:
                plain[next(s for s in order if s not in plain)] = k
    table = sharding.lookup_table(names, slots)
    assert table.tolist() == [plain[s] for s in range(slots)]
    rows = sharding.place(odd, ["doc_id"], table).collect()
    assert len(rows) == 7
    for r in rows:
        key = "\0null" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.sha256(key.encode()).hexdigest()[:15], 16) % slots and r.shard == plain[r.slot]
    assert sharding.place(odd.where("false"), ["doc_id"], table).count() == 0


def plain_features(text, lexicon):
    """The dense features, one after the other."""
    words = re.findall(r"\w+", text.lower())
    n, chars = max(1, len(words)), max(1, len(text))

    def kinds(w):
        stems = [w[:k] + "*" for k in (4, 5, 6) if len(w) > k]
        whole, stem = w in lexicon, any(s in lexicon for s in stems)
        clear = w.translate(str.maketrans("013457@$!", "oieastasi"))
        hidden = not (whole or stem or w in toxicity.SECOND) and not w.isalpha() and any(t in lexicon for t in [clear, *[clear[:k] + "*" for k in (4, 5, 6) if len(clear) > k]])
        return whole, stem, hidden

    marks = [kinds(w) for w in words]
    hits = [i for i, m in enumerate(marks) if any(m)]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    whole, stem, hidden = (sum(m[k] for m in marks) for k in range(3))
    near = sum(any(abs(i - j) <= 3 for j in second) for i in hits)
    tight = max((sum(i <= j < i + 20 for j in hits) for i in hits), default=0)
    count = lambda p: len(re.findall(p, text))
    return [
        np.log1p(len(words)), whole / n, stem / n, hidden / n, np.log1p(whole), np.log1p(stem), sum(m[0] and m[1] for m in marks), near / n, near, len(second) / n, tight,
        sum(c.isupper() for c in text) / chars, count(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b") / n, text.count("!") / chars, text.count("?") / chars, count(r"[^\w\s]") / chars,
        count(r"\b\w*[^\W\d_][0-9@$*!]+[^\W\d_]\w*") / n, count(r"(\w)\1\1") / n,
    ]


def test_features_against_plain_ones():
    rng = random.Random(12)
    words = ["you", "zorg", "zorgling", "z0rg", "KRUMP", "krump", "a", "the", "soooo", "b@d", "Ünd", "vous", "x1y", "!!", "?", "été"]
    lexicon = frozenset(["zorg", "krum*", "krump", "zorgl*"])
    for text in ["", "!", LONG[:500], *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for _ in range(200)]]:
        assert np.allclose(toxicity.features(text, toxicity.Codes(lexicon)), plain_features(text, lexicon)), text


def test_isotonic_against_a_plain_search():
    """Pooled blocks by minimax: the greatest mean from the left of the least mean to the right."""
    from quillon.llm import boost

    rng = np.random.RandomState(4)
    for n in (1, 5, 40):
        raw, y = np.sort(rng.rand(n)), rng.randint(0, 2, n).astype(float)
        mean = [[y[i : j + 1].mean() for j in range(n)] for i in range(n)]
        want = [max(min(mean[i][j] for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        got = boost.isotonic(raw, y)(raw)
        order = [(want[k], got[k]) for k in range(n)]
        assert all(b[1] >= a[1] - 1e-12 for a, b in zip(order, order[1:], strict=False))
        assert all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(order, order[1:], strict=False) if a[0] == b[0] and a[0] not in (0.0, 1.0))


def test_span_features_are_the_same_in_sql(spark):
    rng = random.Random(13)
    cases = [(k, pii.made(rng, k, rng.random() < 0.5), rng.choice(["token = ", "order no. ", "call ", "; ", ""])) for k in pii.MORE for _ in range(40)]
    cases += [("iban", "DE89 3704 0044 0532 0130 00", "iban "), ("secret", "a" * 30, "x ")]
    df = spark.createDataFrame([(i, b + m, (len(b), pii.KINDS.index(k), len(b) + len(m), m)) for i, (k, m, b) in enumerate(cases)], "i int, t string, x struct<s:int,k:int,e:int,m:string>")
    rows = df.selectExpr("i", f"array({', '.join(pii.features_sql())}) as f").collect()
    for r in rows:
        assert np.allclose(r.f, pii.features_of(*cases[r.i])), cases[r.i]


def test_span_quality_by_kind():
    got = pii.quality()
    assert set(got) == set(pii.MORE) and all(p >= 0.95 and r >= 0.75 for p, r in got.values()), got
    assert len(set(pii.model()[1].values())) >= 4


def test_many_matches_in_one_text(spark):
    """More matches than a run holds, at their places."""
    text = " ".join(f"é user{i}@host{i % 7}.example.org, 10.0.{i % 300}.1" for i in range(3_000))
    row = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    mails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert row.n_email == 3_000 and [f"email:{a}:{b}" for a, b in mails] == [x for x in row.spans.split(",") if x.startswith("email")]
    clean = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean.count("[EMAIL]") == 3_000 and "@" not in clean


def test_recall_of_the_forest(spark):
    """Against all pairs of the documents of sf0.01, at the query's own settings."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, words = {}, {}
    for r in docs.collect():
        w = (r.text or "").lower().split()
        words[r.doc_id] = tuple(w)
        sets[r.doc_id] = frozenset(hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets, key=lambda i: len(sets[i]))
    links = dict.fromkeys(ids, 0)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if len(x) < 0.8 * len(y):
                break
            if words[i] == words[j] or (x and len(x & y) >= 0.8 * len(x | y)):
                links[i] += 1
                links[j] += 1
    got = {r.doc_id: r.n_links for r in near_join.near_classes(docs).collect()}
    found = sum(min(got[i], n) for i, n in links.items())
    assert found >= 0.99 * sum(links.values()) > 0 and all(got[i] <= n for i, n in links.items())


def test_crowded_beginnings_lose_nothing(spark):
    """Copies that crowd every trie, with a bound of four labels: longer beginnings are taken, and all links stay."""
    rng = random.Random(14)
    first = [f"w{k}" for k in range(300)]
    docs = [(0, " ".join(first))]
    for i in range(1, 60):
        other = list(first)
        for _ in range(2):
            other[rng.randrange(300)] = f"x{i}"
        docs.append((i, " ".join(other)))
    docs += [(100 + i, " ".join(f"y{i}x{k}" for k in range(50))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = near_join.classified(df, crowd=4).collect()
    assert {r.class_id for r in rows if r.doc_id < 100} == {0} and {r.n_links for r in rows if r.doc_id >= 100} == {0}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    want = {i: sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i) for i in sets}
    assert {r.doc_id: r.n_links for r in rows} == want


def test_labels_by_hand():
    forest = near_join.Forest(trees=4)
    found = near_join.shingles("a b c d e f g h".split(), near_join.WordHashes())
    low = ((found >> np.uint64(32)).astype(np.uint32)[:, None] * forest.a + forest.b).min(axis=0)
    want = [int.from_bytes(bytes(((int(v) * 0x9E3779B1) % 2**32 >> 24) for v in low[8 * t : 8 * t + 8]), "big", signed=True) for t in range(4)]
    assert forest.labels(found).tolist() == want


def test_pipeline_of_odd_rows(spark, odd, small):
    """Every stage takes nulls, empty and long texts, repeated rows, clashing names and no rows at all."""
    import corpus_pipeline

    docs, columns = odd, odd.columns
    counts = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("false"), small).count() == 0
        docs = corpus_pipeline.written(stage(spark, docs, small), name)
        counts.append(docs.count())
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.where("__node <> 'kept' or slot2 <> 'kept'").count() == 0
    # Of equal rows one stays; null and empty are one text, and the greater id of it stays.
    assert counts[0] == 7 and counts[1] == counts[2] == counts[3] == 4
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, 4}


def test_dedup_of_odd_rows(odd):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == 7 and sum(r.kept for r in rows) == 4
    assert near_join.near_classes(odd).count() == 7


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from quillon.llm import common

    class Context:
        master = "yarn"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        common.work_root(Session)


def test_work_folders_are_released(spark):
    from quillon.llm import common

    since = common.made()
    a, b = (common.written(spark.range(3).select("id"), x) for x in "ab")
    kept = common._made[-1]
    common.release(spark, since, keep=kept)
    assert b.count() == 3 and common._made[since:] == [kept]
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT_EXIST|FAILED_READ"):
        a.collect()
