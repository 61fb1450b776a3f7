"""The other operators: against plain versions, round trips, and edge cases."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from quillon.llm import boost, html_text, near_join, packing, pieces, pii, sharding, token_files, tokens, toxicity

END = tokens.END_ID.to_bytes(4, "little")
ODD = ["", " ", "\n", "  a", "a  ", "a\n\nb", "x" * 5000, "it's a.b, no!! İ. Σ é🙂 <|endoftext|> \x1c▁ <s>", "a\tb\r\nc d"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    signs = list("aab bB  \n\t.,'s'll 12éΣ  \x1c漢🙂İ\r!%")
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(500)]


@pytest.mark.parametrize("name", ["byte", "word"])
def test_cached_ids_are_the_tokenizers_own(texts, name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[name]))
    model = {"byte": tokens.byte_encoder, "word": tokens.word_encoder}[name]()
    for _ in range(2):
        for t, ids in zip(texts, model.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte", "word"])
def test_special_tokens_are_the_tokenizers_own(name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[name]))
    model = {"byte": tokens.byte_encoder, "word": tokens.word_encoder}[name]()
    end, start = "<|endoftext|>", "<|startoftext|>"
    odd = [f"a {end} b", f"inside{end}word", f"{end}, {end}!", f"x{end}{end}\n\n y", end, f" {end} ", f"{end.upper()} a{start.upper()}", f"{start}Hi there.{end}", f"a{end[:-1]} b {start}"]
    rng = random.Random(6)
    odd += ["".join(rng.choice([end, start, " ", "a", "Bc", "\n", ".", "İ", "é", end[:5]]) for _ in range(12)) for _ in range(300)]
    for _ in range(2):
        for t, ids in zip(odd, model.encode(odd), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_file_reads_any_token():
    rng = random.Random(2)
    ids = np.array([rng.choice([0, 255, 256, 50_256, 70_000, 2**32 - 1]) for _ in range(3000)])
    held = token_files.TokenFile(token_files.to_bytes([1, None, -3], np.array([0, 10, 10, 3000]), ids))
    assert held.doc_ids == [1, None, -3]
    assert [held.token(i) for i in range(3000)] == ids.tolist()
    for a, b in [(0, 0), (0, 3000), (511, 513), (512, 1024), (2999, 3000)]:
        assert held.tokens(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        held.token(3000)
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else")


def test_token_files(spark, texts, tmp_path):
    docs = spark.createDataFrame([(7 * i - 50, t) for i, t in enumerate(texts)] + [(10**9, None)], "doc_id long, text string").repartition(5)
    files = token_files.write_files(docs, str(tmp_path / "f"), file_tokens=500)
    rows = sorted(token_files.read_files(files).collect())
    at = 0
    for r, ids in zip(rows, tokens.byte_encoder().encode([*texts, ""]), strict=True):
        ids += END
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    assert files.count() > 5
    assert token_files.round_trip(docs.where("false")).count() == 0


def test_packing(spark, texts):
    texts = texts + ["word " * 9000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(docs, group=100).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in enumerate(tokens.word_encoder().encode([t or "" for t in texts])):
        ids, at = ids + END, 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_packs_leave_one_open_bin():
    rng = random.Random(5)
    lengths = [rng.choice([1, 5, 700, 4096, 4097, 20_000, 3000]) for _ in range(400)]
    bins = packing.pack(lengths)
    fills = sorted(sum(n for _, _, n in b) for b in bins)
    assert sum(fills) == sum(lengths) and fills[1:] == [4096] * (len(fills) - 1)
    tree = packing.Tournament(5, 10)
    assert [tree.first(s) for s in (6, 6, 4, 5, 4)] == [0, 1, 0, 2, 1]


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    assert sharding.moved(table, sharding.lookup_table(names[:-1], 1009), names, names[:-1]) < 0.3
    assert np.bincount(sharding.lookup_table(["a", "b"], 1009, turns=[2, 1]))[0] > 600
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)
    df = spark.createDataFrame([(i, "x") for i in range(500)] + [(None, "y")], "doc_id long, slot string")
    rows = sharding.place(df, ["doc_id"], table).collect()
    assert len(rows) == 501 and all(table[r.slot] == r.shard for r in rows)
    assert len({r.shard for r in rows}) == 7


def test_pieces(spark, texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain, varied = pieces.Pieces(rate=0.0), pieces.Pieces(rate=0.3)
    for t in texts:
        if "▁" not in t:
            assert np.frombuffer(plain.encode(t), "<u4").tolist() == own.encode(t)
        for v in range(2):
            assert varied.decode(varied.encode(t, v)) == t
    word = "international communication"
    assert len({varied.encode(word, v) for v in range(8)}) > 1
    assert varied.encode(word, 3) == pieces.Pieces(rate=0.3).encode(word, 3)
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    for r in pieces.encoded(docs).collect():
        assert r.decoded == (texts[r.doc_id] if r.doc_id is not None else "")
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.n_tokens


def test_pieces_vary_with_place_and_document(spark):
    varied, word = pieces.Pieces(), " communication"
    plain, sizes = pieces.Pieces(rate=0.0).encode(word[1:]), {}  # some skips lead there by another way
    for v in range(3000):
        ids = varied.encode(word[1:], v)
        sizes[ids] = sizes.get(ids, 0) + 1
    assert len(sizes) > 8
    came = len(word) - len(plain) // 4
    whole = varied.gap(varied.part_keys(77, 20_000)) >= came
    assert abs(whole.mean() - 0.9**came) < 0.02 and sizes[plain] / 3000 > 0.9**came  # each candidate is skipped with the rate
    docs = [(i, "communication " * 400) for i in range(3)] + [(None, "communication " * 400 + "x"), (None, "communication " * 400 + "y")]
    rows = pieces.encoded(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len({bytes(r.ids)[:400] for r in rows}) == 5
    long = "internationalcommunication" * 40  # not in the cache, and cut as if it were
    assert varied.decode(varied.encode(long, 5)) == long and varied.encode(long, 5) != varied.encode(long, 6)


def agenda(model, word, gaps):
    """Merge-dropout of one word, plainly: the best pair left of all, again and again."""
    part, skipped, until = list(word), set(), next(gaps)
    while True:
        at = [sum(map(len, part[:i])) for i in range(len(part))]
        found = [(model.scores[a + b], at[i], i) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if a + b in model.scores and (at[i], a + b) not in skipped]
        if not found:
            return part
        _, place, i = min(found)
        if until:
            part[i : i + 2] = [part[i] + part[i + 1]]
            until -= 1
        else:
            skipped.add((place, part[i] + part[i + 1]))
            until = next(gaps)


@pytest.mark.parametrize("rate", [0.1, 0.6])
def test_pieces_against_a_plain_agenda(spark, texts, rate):
    docs = [*enumerate([t for t in texts if len(t) < 100] + ["an international communication, of all.\nNext ones", "same", "same"]), (None, "same")]
    rows = pieces.encoded(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, ids string"), rate=rate).collect()
    variants = {tuple(r[:2]): r[2] for r in spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", f"xxhash64({pieces.SEED}, doc_id, text)").collect()}
    model, held = pieces.Pieces(rate=rate), {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, t in docs:
        key = xxhash.xxh3_64_intdigest(struct.pack("<Q", variants[i, t] & pieces.MASK), seed=pieces.SEED)
        want, n = [], 0
        for w in model.words(t):
            for p in model.parts_of(w):
                n += 1
                want += model.packed(agenda(model, p, model.gaps((key + n * pieces.GOLDEN) & pieces.MASK)))
        assert np.frombuffer(held[i].ids, "<u4").tolist() == want and held[i].decoded == t
    assert pieces.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    words = {i: " ".join((t or "").lower().split()) for i, t in docs}
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if words[ids[a]] == words[ids[b]] or (x and len(x & y) >= 0.8 * len(x | y)):
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = top(ids[a]), top(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (top(i), links[i]) for i in sets}


def test_near_join(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    docs = []
    for _ in range(12):
        first = [rng.choice(words) for _ in range(rng.choice([4, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            other = list(first)
            for _ in range(rng.randint(0, 5)):
                other[rng.randrange(len(other))] = rng.choice(words)
            docs.append((len(docs), " ".join(other)))
    docs += [(900, None), (901, ""), (902, "Hi"), (903, "hi "), (904, "long " * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_classes(df).collect()} == want
    monkeypatch.setattr(near_join.verified, "__defaults__", (3,))  # blocks of three nodes: large classes are cut up
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_classes(df).collect()} == want
    left = near_join.one_of_each(df.selectExpr("*", "1 as node", "2 as label"))
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for c, _ in want.values()})
    assert near_join.near_classes(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert near_join.near_classes(odd).count() == 4


def test_one_of_each_by_id_and_text(spark):
    text = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcdefg"}
    near = {c: t + " end" for c, t in text.items()}
    docs = [(1, text["a"]), (None, near["a"]), (None, text["b"]), (None, text["c"])]  # a null id near another, and unrelated ones
    docs += [(2, text["d"]), (5, near["d"]), (5, text["e"])]  # an id on a copy and on a text of its own
    docs += [(None, text["f"]), (None, near["f"]), (7, text["g"]), (7, near["g"]), (7, near["g"].upper())]  # classes of one id
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    left = near_join.one_of_each(df)
    assert left.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text[0].lower()) for r in left.collect()))
    assert got == [(0, "b"), (0, "c"), (0, "f"), (1, "a"), (2, "d"), (5, "e"), (7, "g")]


def test_prefix_length():
    n = near_join.prefix_length()
    promise = lambda k: 1 - (1 - 0.8**k) ** near_join.TREES
    assert promise(n) >= near_join.RECALL > promise(n + 1)


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>menu</a></nav>{}<footer>f &copy;</footer></body>"


def test_html(spark):
    menu = "<div><a>home sweet home</a> <a>all the news today and more</a></div>"
    pages = [(i, f"http://h.example/{i}", f"<body>{menu}<p>Own words of page {i} with {i * 7}</p><div class='cookie-notice'>we use cookies</div><form>x</form>") for i in range(4)]
    main = "<article><h1>A &amp;amp; B</h1><p><b>one<br>two <i>thr</i>ee\n\n x<p>if a < b<script>var t='</p>';</script><div id=comments>no</div><aside>no</aside></article><p>out</p>"
    pages += [(10, "u", PAGE.replace("{}", main)), (11, None, None), (12, "u", ""), (None, None, "<p>only <b>text &lt;3</p"), (13, "u", "<article>never closed <p>x"), (13, "u", "<article>never closed <p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = html_text.main_text(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert [got[i] for i in range(4)] == [f"Own words of page {i} with {i * 7}" for i in range(4)]
    assert got[10] == "A &amp; B\none two three x\nif a < b"
    assert got[11] == got[12] == "" and got[None] == "only text <3" and got[13] == "never closed\nx"
    assert html_text.main_text(df.where("false")).count() == 0


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>", "<div id=page class=no-sidebar>", "<div class='share-price'>", "<div class=social>", "<form id=f>", "<div class='page menu-engineering'>"])
def test_html_wrappers(wrapper):
    read = lambda page: [t for r, t in html_text.blocks_of(page) if r == html_text.MAIN]
    assert read(f"<body>{wrapper}<header>h</header><article><p>story</article><div class=sidebar>s</div>") == ["story"]
    assert read(f"<body>{wrapper}<main><h1>t</h1>story</main>") == ["t", "story"]
    inside = "<article><h2 id='comments-on-method'>m</h2><section id='related-work'>w</section><div class=share-price>p</div>{}</article>"
    assert read(inside.replace("{}", "<div class='site-ad'>x</div><div class=cookie-notice>x</div><ul class='related-posts'><li>x</ul><div id=comments>x</div>")) == ["m", "w", "p"]
    for proper in ("<nav>", "<aside>", "<footer>", "<div id=comments>", "<div class='site-footer'>", "<div role=navigation>"):
        assert read(f"<body>{proper}<article>no</article>") == []
    assert read("<body><div class=related-posts><article>no</article></div><div class=sidebar><main>yes</main></div>") == ["yes"]


def hosted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_text.main_text(df.repartition(3)).collect())]


def test_html_shared_story(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES", 4)  # a host of several groups
    menu = "".join(f"<li>entry {i}</li>" for i in range(9))
    own = [" ".join(f"w{i}x{k}" for k in range(30)) + " as of this day and year" for i in range(30)]
    story = " ".join(f"story{k}" for k in range(40))
    pages = [(f"http://s.example/{i}", f"<ul>{menu}</ul><p>{x}</p><div>all rights reserved here</div>") for i, x in enumerate(own)]
    pages += [(f"http://s.example/copy{i}", f"<ul>{menu}</ul><h2>{i}. print</h2><p>{story}</p>") for i in range(3)]
    pages += [("http://s.example/again", f"<ul>{menu}</ul><p>{story}</p><p>crawl {i}</p>") for i in range(12)]
    pages += [(f"http://s.example/second{i}", f"<ul>{menu}</ul><p>{own[0]} more</p>") for i in range(12)]
    got = hosted(spark, pages)
    assert got[:30] == own
    assert got[30:33] == [f"{i}. print\n{story}" for i in range(3)]
    assert got[33:45] == [f"{story}\ncrawl {i}" for i in range(12)]
    assert got[45:] == [own[0] + " more"] * 12
    assert hosted(spark, [(f"http://two.example/{i}", f"<p>{story}</p><p>{i}</p>") for i in range(2)]) == [f"{story}\n{i}" for i in range(2)]


def test_html_body_beside_articles(spark):
    menu = "<div>" + " ".join(f"entry{i}" for i in range(15)) + "</div>"
    body = [" ".join(f"b{i}x{k}" for k in range(20)) for i in range(6)]
    teaser = "<article class=card>read this too</article>"
    pages = [(f"http://t.example/{i}", f"{menu}<h1>Head {i}</h1>{teaser if i % 2 else ''}<p>{x}</p>") for i, x in enumerate(body)]
    assert hosted(spark, pages) == [f"Head {i}\n" + "read this too\n" * (i % 2) + x for i, x in enumerate(body)]


def test_suffix_array_against_sorting():
    rng = np.random.RandomState(3)
    for n in (1, 2, 50, 400):
        codes = np.append(rng.randint(0, 3, n), -1)
        order, shared = html_text.suffix_array(codes)
        suffixes = [tuple(codes[i:].tolist()) for i in range(n + 1)]
        assert order.tolist() == sorted(range(n + 1), key=suffixes.__getitem__)
        for a, b, k in zip(order, order[1:], shared[1:], strict=False):
            x, y = suffixes[a], suffixes[b]
            assert x[:k] == y[:k] and x[k : k + 1] != y[k : k + 1]


def test_runs_against_brute_force():
    rng = random.Random(8)
    for _ in range(20):
        streams = [[rng.choice("abc") for _ in range(rng.randint(1, 40))] for _ in range(6)]
        pages = [0, 1, 1, 2, 3, 3]
        lengths = html_text.shared_lengths(streams, pages)
        for k, words in enumerate(streams):
            for i in range(len(words)):
                best = 0
                for j, other in enumerate(streams):
                    if pages[j] != pages[k]:
                        for at in range(len(other)):
                            n = 0
                            while i + n < len(words) and at + n < len(other) and words[i + n] == other[at + n]:
                                n += 1
                            best = max(best, n)
                assert lengths[k][i] == best
            for a, b in html_text.maximal_runs(lengths[k], 3):
                assert b - a >= 3 and not any(x <= a and b <= y and (x, y) != (a, b) for x, y in html_text.maximal_runs(lengths[k], 1))


def test_suffix_runs():
    streams = ["a b c d e f".split(), "x a b c d e y".split(), "a b c".split(), "q q q q q q q".split()]
    found = html_text.runs_of([1, 2, 3, 4], [1, 2, 3, 4], streams, 5)
    assert {(k, p) for k, p, _ in found} == {(1, 0), (2, 1)} and len({r for _, _, r in found}) == 1
    assert html_text.runs_of([1], [1], [["a"]], 5) == []


def test_html_runs_decide_rows(spark):
    """Of pages that declare nothing, what the runs take away; of declared ones, nothing."""
    notice = " ".join(f"notice{k}" for k in range(30))
    own = [" ".join(f"o{i}x{k}" for k in range(25)) for i in range(8)]
    bare = [(f"http://r.example/{i}", f"<p>{x}</p><p>{notice}</p>") for i, x in enumerate(own)]
    assert hosted(spark, bare) == own
    declared = [(u, f"<article>{h}</article>") for u, h in bare]
    assert hosted(spark, declared) == [f"{x}\n{notice}" for x in own]


def test_trees_and_calibration():
    rng = np.random.RandomState(0)
    x = rng.rand(2000, 4)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boost.fit(x[:1500], y[:1500], rounds=40)
    raw = trees.raw(x)
    assert ((raw[1500:] > 0) == y[1500:]).mean() > 0.95
    level = boost.isotonic(raw[1500:], y[1500:])
    p = level(np.sort(raw))
    assert (np.diff(p) >= 0).all() and 0 < p[0] < 0.1 and 0.9 < p[-1] < 1
    assert not boost.fit(x, np.ones(len(x))).trees


def test_toxicity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["zorg", "zorgling", "krump", "you krump"]))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, toxic))
    docs += [(5000, None, "y"), (5001, "", "y"), (None, "you krump zorg", "y"), (5002, "krump " * 20_000, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    known = spark.createDataFrame([*labels, (1, None), (7, labels[7][1])], "doc_id long, toxic int")
    rows = toxicity.score_documents(df, known).collect()
    truth, right, held = dict(labels), 0, 0
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and r.doc_id in truth:
            held += 1
            right += truth[r.doc_id] == r.predicted
    assert right >= 0.97 * held > 100
    left = toxicity.keep_clean(df, known)
    assert left.columns == df.columns and 600 < left.count() < 800
    assert toxicity.score_documents(df.where("false"), known).count() == 0
    assert {r.score for r in toxicity.score_documents(df, known.where("false")).collect()} == {0.5}


def redacted(text, spans):
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_pipeline(spark, small):
    """Each stage against a plain version of it, on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    clean = corpus_pipeline.written(stages["toxicity"](spark, docs, small), "a")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert set(rows(clean)) == {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect()}

    single = corpus_pipeline.written(stages["exact_dedup"](spark, clean, small), "b")
    last = {}
    for i, r in sorted(rows(clean).items()):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)] = i
    assert set(rows(single)) == set(last.values())

    apart = corpus_pipeline.written(stages["near_join"](spark, single, small), "c")
    before = rows(single)
    assert set(rows(apart)) == {c for c, _ in brute([(i, r.text) for i, r in before.items()]).values()}

    safe = corpus_pipeline.written(stages["pii"](spark, apart, small), "d")
    spans = {r.doc_id: [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in pii.scan(apart).collect()}
    before, after = rows(apart), rows(safe)
    assert any(spans.values()) and {i: r.text for i, r in after.items()} == {i: redacted(r.text, spans[i]) for i, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert clean.columns == single.columns == apart.columns == safe.columns == columns

    pieces_, ids = {}, sorted(after)
    for r in stages["packing"](spark, safe, small).collect():
        pieces_.setdefault(r.doc_id, []).append(r)
    for i, want in zip(ids, tokens.word_encoder().encode([after[i].text for i in ids]), strict=True):
        want, at = want + END, 0
        for r in sorted(pieces_[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(want) // 4


def test_documents_sql(spark, small, duck):
    from quillon.llm import queries

    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, small)
        found = duck.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))
