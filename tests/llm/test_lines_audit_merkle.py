"""Line dedup, filter audit, Merkle manifest: against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillon.llm import filter_audit, line_dedup, merkle

LONG = "\n".join(f"line {i % 700} of a very long text that goes on" for i in range(20_000))
ROWS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["__t1", "__gone", "__lines", "h1", "at", "key", "part", "mask", "n", "idx", "g", "leaf", "n_lines"]


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    shared = [f"  This line stands in several documents, number {i}\t" for i in range(4)]
    rows = [(i, "\n".join(rng.choice([*shared, shared[0].upper(), f"own {i}", "", "É" * 40, "é" * 39]) for _ in range(rng.randint(0, 9))), rng.choice(["en", None]), rng.choice(["a", "b", "hot", "hot", None]), i) for i in range(120)]
    rows += [(None, None, None, None, None), (None, shared[1], "en", "b", 1), (3, "", "fr", "", 0), (200, LONG, "en", "hot", len(LONG)), (201, LONG, "en", "a", None), (7, shared[2] + "\r", None, "é", 3), (7, shared[2] + "\r", None, "é", 3), (500, "SAME text", "en", "a", 9)]
    return rows + [(i, "SAME text", "en", "hot", 9) for i in range(300, 400)] + [(299, "SAME text", "en", "hot", 9)] * 2


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, ROWS)
    return df.select("*", *[F.lit("kept").alias(c) for c in CLASH]).repartition(parts, F.hash("doc_id", "text"))


# Lines


def plain_lines(rows, chars=40, docs=5):
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for n, r in enumerate(rows):
        for key in {strip(x) for x in (r[1] or "").split("\n")}:
            holders[key].append((r[0] is not None, r[0] or 0, n))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if not (len(strip(x)) >= chars and len(holders[strip(x)]) >= docs and max(holders[strip(x)])[:2] != (r[0] is not None, r[0] or 0))]
        out.append((r[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("heavy", [200_000, 3])
def test_lines(spark, odd, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)  # with few, the rest goes by a shuffle
    got = line_dedup.drop_lines(frame(spark, odd))
    assert set(got.columns) == set(ROWS.replace(" long", "").replace(" string", "").split(", ")) | set(CLASH) | {"n_dropped"}
    want = plain_lines(odd)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == Counter(want)
    assert sum(x[2] for x in want) > 100
    assert line_dedup.drop_lines(frame(spark, odd).where("false")).count() == 0


def test_lines_stay_without_python(spark, odd):
    plan = line_dedup.drop_lines(frame(spark, odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


# Filters


def plain_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    order = lambda d: (d is not None, d or 0)
    for d, text, *_ in rows:
        least[text or ""] = min(least.get(text or "", order(d)), order(d))
    docs = defaultdict(list)
    for d, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": order(d) > least[text]}
        docs[source or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part, held in docs.items():
        shapley = Counter()
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                here = [x for x in held if f in x[0] and not x[0] & set(p[:k])]
                shapley[f] += len(here)
                out[part, "".join(p), k + 1] = [sum(not x[0] & set(p[: k + 1]) for x in held), len(here), sum(f in x[0] and bool(x[0] & set(p[:k])) for x in held), sum(x[0] == {f} for x in held), sum(x[1] for x in here), sum(x[2] for x in here)]
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                out[part, "".join(p), k + 1].append(shapley[f])
    return out


@pytest.mark.parametrize("bound, one", [(32 << 20, False), (2_000, False), (32 << 20, True)])
def test_audit(spark, odd, bound, one):
    """With chains of few bytes texts meet only where they are routed to; with one fingerprint all texts share a chain."""
    rows = odd + [(i, f"word{'$' * (i % 2)} A B C d e" * (i % 70), "en", "hot", 1) for i in range(1000, 1060)]
    labels = [(i, i % 3 % 2, i % 2) for i in range(0, 1100, 2)] + [(None, 1, 1), (4, 1, None), (4, None, 1)]
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fingerprint=F.lit(5).cast("long") if one else None, chain_bytes=bound)
    found = {tuple(r)[:3]: list(r)[3:] for r in got.collect()}
    assert got.count() == len(found) and found == plain_audit(rows, labels)
    assert filter_audit.audit(frame(spark, rows).where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_chains_order():
    chains = filter_audit.Chains()
    for i in (5, 3, None, 9, None):
        chains.add(1, b"x", i, [(("p", 0), 1)])
    texts, more = chains.emptied()
    assert [(i, dict(c)) for _, _, i, c in texts] == [(None, {("p", 0): 2})]
    assert sorted(more) == [(i, "p", 16, 1) for i in (3, 5, 9)]


# Manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root, and for each leaf its runs with its place in them."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            paths[k].append((i % 16, runs[i // 16]))
        nodes, at = [h(r) for r in runs], [i // 16 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda d, text, lang, source, n: h(map(field, (d, source, lang, n, text)))
    by = defaultdict(list)
    for d, text, lang, source, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and text is not None
        by[source].append(((d is not None, d or 0), digest(d, text, lang, source, n), digest(d, low(text) if hit else text, lang, source, n), d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[1] for x in sorted(by[s])]) for s in sources}
    root, above = tree([subs[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for x, path in zip(sorted(by[s]), subs[s][1], strict=True):
            path, probe = path + up, x[2]
            for at, run in path:
                probe = h([*run[:at], probe, *run[at + 1 :]])
            proof = [y for at, run in path for k, y in enumerate(run) if k != at]
            out.append((x[3], x[1], subs[s][0], root, h(proof), probe, probe == root, tuple(proof)))
    return out


def test_manifest(spark, odd, monkeypatch):
    rows = odd + [(10_000 + i, f"Text {i}", "en", f"s{i % 21}", i) for i in range(300)]
    got = merkle.manifest(frame(spark, rows), whole=True)
    want = plain_manifest(rows)
    assert Counter((*tuple(r)[:7], tuple(r.proof)) for r in got.collect()) == Counter(want)
    assert 0 < sum(not x[6] for x in want) < len(want)
    assert merkle.manifest(frame(spark, rows).where("false")).count() == 0
    one = [(1, "A", None, None, None)]
    assert [tuple(r) for r in merkle.manifest(frame(spark, one)).collect()] == [x[:7] for x in plain_manifest(one)]


def test_manifest_of_many_blocks(spark):
    """A source of more leaves than a block, so that levels above blocks are grouped and joined."""
    rows = [(i, f"Row {i}", "en", "big", i) for i in range(2 * 4096 + 17)] + [(i, "x", "en", "small", i) for i in range(20)]
    got = {(r.id, r.leaf): tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, ROWS).repartition(5)).collect()}
    want = {x[:2]: x[:7] for x in plain_manifest(rows)}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 600, 4095, 4096])
def test_traversal(n):
    held = [h([str(i)]) for i in range(n)]
    root, paths = tree(held)
    levels = merkle.height(n)
    assert merkle.block_root(held, levels) == root
    for k, path in enumerate(merkle.traversed(held, levels)):
        assert path == paths[k]
        assert merkle.folded(held[k], path) == root


# Mends of earlier operators


def test_comments_by_their_names():
    from quillon.llm.html_text import blocks_of, kept_blocks

    page = "<article><p>Story.</p><div class='comments-section'>a</div><div id=user-comments>b</div><div class='post-comments'>c</div><section class=comments-on-method>yes</section></article>"
    found = blocks_of(page)
    assert kept_blocks([r for r, _ in found], [t for _, t in found], None) == ["Story.", "yes"]


def test_near_copies_without_ids(spark):
    """Rows without an id, or of one id, meet nodes by their words: as many rows as there are texts."""
    from quillon.llm import near_join

    rows = [(None if i % 2 else 5, " ".join(f"w{(i // 4) * 100 + k + (k == 39) * (i % 4)}" for k in range(80))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_join.near_classes(docs).collect()
    assert len(found) == 80 and {r.n_links for r in found} == {3}
    texts = docs.selectExpr("doc_id", "text")
    nodes = texts.withColumn("node", near_join.text_node("text")).groupBy("node").agg(F.max("doc_id").alias("high"), F.count("node").alias("copies"))
    assert near_join.with_node(texts, nodes.withColumn("label", F.col("node"))).count() == 80


def test_packing_and_files_whatever_the_order(spark):
    """Rows that arrive in another order give the same pieces, with null ids and one id on many rows too."""
    from quillon.llm import packing, token_files

    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * (i % 40)) for i in range(200)]
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        found.append((sorted(map(str, packing.pack_documents(docs, group=32).collect())), sorted(map(str, token_files.round_trip(docs).collect()))))
    assert found[0] == found[1]


def test_work_folders_of_another_thread_stay(spark):
    import threading

    from quillon.llm import common

    since, other = common.made(), []
    thread = threading.Thread(target=lambda: other.append((common.work_path(spark, "x"), common.made())))
    thread.start()
    thread.join()
    assert other[0][1] == 1 and common.made() == since


def page_text(page: str) -> list[str]:
    from quillon.llm.html_text import blocks_of, kept_blocks

    found = blocks_of(page)
    return kept_blocks([r for r, _ in found], [t for _, t in found], None)


def test_forms_that_wrap_the_page():
    prose = " ".join(f"word{i}" for i in range(13))
    assert page_text(f"<body><form id=aspnetForm><p>{prose}</p><p>Short.</p></form></body>") == [prose, "Short."]
    assert page_text("<body><form id=aspnetForm><nav>Menu</nav><div>Short story.</div><footer>foot</footer></form></body>") == ["Short story."]
    assert page_text(f"<form>A<form>{prose}</form><header>x</header>B</form>C") == ["A", "B", "C"]
    # Forms for input stay dropped.
    assert page_text(f"<body><p>Hi there.</p><form>{prose}</form></body>") == ["Hi there."]
    assert page_text(f"<article>Story.</article><form>{prose}</form>") == ["Story."]
    assert page_text("<body><form>Name <input> Mail</form></body>") == []
    assert page_text(f"<body><form class=login><p>{prose}</p></form></body>") == []


def test_encoder_forgets_its_words():
    from quillon.llm import tokens

    model, texts = tokens.word_encoder(), ["Hello, World! x\ny", "abc abc", "", "Élan vital; don't"]
    before = [*model.encode(texts)]
    model.forget()
    assert not model.known and [*model.encode(texts)] == before


def test_large_classes_ship_differences(spark, monkeypatch):
    """A class of near copies: each text is set against one other, in any number of parts and blocks, and links stay."""
    from quillon.llm import near_join

    base = [f"w{k}" for k in range(120)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 90, 3)] + [" ".join([*base, f"end{i}"]) for i in range(10)] + [" ".join(base[:110])] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    want = {i: sum(j != i and len(p & q) >= 0.8 * len(p | q) for j, q in enumerate(plain)) for i, p in enumerate(plain)}
    members = docs.withColumn("node", near_join.text_node("text")).groupBy("node").agg(F.count("node").alias("copies"), F.first("text").alias("text")).withColumn("label", F.lit(bytearray(b"one")))
    for block, hashes in ((256, 1 << 22), (3, 1 << 22), (3, 40)):
        monkeypatch.setattr(near_join, "BLOCK", block)
        monkeypatch.setattr(near_join, "BLOCK_HASHES", hashes)
        found = near_join.differences(members, members, 5).collect()
        assert len(found) == len({bytes(r.node) for r in found}) == 41
        assert sum(len(r.diff) for r in found) < 0.3 * sum(r.size for r in found)
        assert all(r.size + r.base - 2 * r.common == len(r.diff) for r in found)
        assert {r.doc_id: r.n_links for r in near_join.near_classes(docs).collect()} == want


def test_pairs_of_sets_against_a_plain_count():
    import numpy as np

    from quillon.llm import near_join

    rng = np.random.RandomState(4)
    base = np.arange(40)
    sets = [np.setdiff1d(np.arange(44), rng.choice(44, rng.randint(0, 8), replace=False)) for _ in range(30)] + [np.array([99])]
    sides = [int(k > 12) for k in range(31)]
    common = np.array([len(np.intersect1d(s, base)) for s in sets])
    sizes = np.array([len(s) for s in sets])
    for across in (False, True):
        a, b = near_join.links_in([np.setxor1d(s, base) for s in sets], sides, 0.8, sizes, common, 40, across)
        like = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
        want = {(i, j) for i in range(31) for j in range(i + 1, 31) if like(sets[i], sets[j]) and (not across or sides[i] != sides[j])}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and want
    assert not len(near_join.links_in([base, base], [1, 1], 0.8, np.array([40, 40]), np.zeros(2, int), 0, True)[0])
