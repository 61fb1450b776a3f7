"""Main text of web pages: declared structure, and a host's repeated runs.

A page is cut into blocks with one of three roles: main (in an article or main
element), dropped (in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments of readers), or open (the page does not say).  A class
or id names boilerplate only as a whole, and a main element in a dropped wrapper
is main again, as an article is unless the wrapper is a margin; navigation,
footers, asides and comments of readers keep all that is in them dropped.  The
words of all blocks are a page's stream.  The streams of a host's pages are joined,
group by group of bounded size, and a suffix array over each, with the lengths of
common beginnings of neighbours, gives the longest run from every word on that
another page has too; a run counts from ``RUN`` words, and a block of fewer is a run
of its own.  The pages of a run are counted over all groups of the host: a run
belongs to the host if at least ``FEW`` + 1 pages and the share ``SHARE`` of the
host's pages have it.  Rows of one url, and pages with the same stream, are one page
there, so a story under several addresses stays.  Open blocks that the host's runs
cover by half or more are boilerplate; the others are text, in page order with the
main blocks, also in a page that declares some.  Only where all of them beside main
blocks are fewer words than a run are they left out, for runs cannot judge them.
A form is dropped unless it wraps the
page: it then holds navigation, headers, footers or asides of the page, or nothing
outside it is main or open and it has a block of ``RUN`` words; what it holds is
then judged as if the form were not there.

Main blocks are protected: an article that several pages share is text of each of
them.  A host whose pages declare the role of every block has nothing for runs to
decide, so no suffix array is made for it.

Edge cases: null html is empty; a page without main text gives an empty text;
unclosed, stray and broken tags are read as browsers do, nearly; character
references are decoded once; very long pages are read whole; repeated rows each
give a row (and are one page for counting); null urls share a host; a run that is
exactly at a threshold belongs to the host, and a block covered by exactly half is
boilerplate; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions_for, sized, written

#: Words of a run, pages of a group, and the share of a block that makes it boilerplate.
RUN, PAGES, COVERED = 12, 256, 0.5
#: So many pages may share a text that is theirs, and the share of a host's pages that makes a run the host's.
FEW, SHARE = 3, 0.2
MAIN, DROPPED, OPEN = 1, 0, 2
#: While reading, dropped too: a main element in these is main again, in SOFT an article as well.  In a form it is not known yet.
SOFT, ASIDE, FORM = 3, 4, 5

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
OPENED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
#: Elements whose content is not read as markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of a page that a form for input does not hold.
OF_PAGE = frozenset("nav header footer aside".split())
#: Elements that hold a role until they are closed; others do not change it.
HOLDERS = BLOCK - frozenset("p dt dd li tr td th option hr".split()) | frozenset("span svg object select button".split())
BOILER = frozenset("nav footer aside form head dialog menu svg object select button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Words of class and id: outside main blocks, and anywhere.
OUTSIDE = frozenset("header masthead topbar banner".split())
ANYWHERE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login comment comments commentlist reply replies disqus respond share sharing social related".split()
)
#: Names of a page's own lists and margins: an article in them is not the page's.
MARGIN = frozenset("sidebar aside related promo promotion sponsor sponsored newsletter".split())
#: Names of what has no main text in it at all.
CLOSED = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer comment comments commentlist reply replies disqus respond".split())
#: Parts that may stand beside those words in a name that still means nothing else.
FILL = frozenset("site main primary secondary global wrap wrapper container box bar widget list links link buttons icons form slot unit posts articles".split())

#: Words for readers' comments, and what more may stand beside them.
COMMENTS = frozenset("comment comments commentlist reply replies".split())
OF_READERS = frozenset("section area thread post user users reader readers block wrapper holder".split())


def attributes(raw: str) -> tuple[set[str], str]:
    """The names of class and id, and the role."""
    names: set[str] = set()
    role = ""
    for m in ATTRIBUTE.finditer(raw):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = value.strip()
        else:
            names.update(value.split())
    return names, role


def boiler_words(names: set[str]) -> set[str]:
    """The words of the names that mean boilerplate as a whole.

    ``cookie-notice`` and ``site_footer`` do; ``has-sidebar``, ``share-price``
    and ``comments-on-method`` do not.
    """
    found: set[str] = set()
    for name in names:
        parts = set(re.split("[-_]+", name)) - {""}
        words = parts & (ANYWHERE | OUTSIDE)
        if words and parts <= words | FILL | (OF_READERS if words & COMMENTS else set()):
            found |= words
    return found


def role_of(tag: str, raw: str, now: int) -> int:
    """The role inside an element that opens where the role is ``now``."""
    if now == DROPPED or tag in ("html", "body"):
        return now
    names, role = attributes(raw) if raw and "=" in raw else (set(), "")
    words = boiler_words(names)
    if tag == "main" or role == "main":
        return MAIN
    if tag == "article":
        return DROPPED if words & {"comment", "reply"} else ASIDE if now == ASIDE else MAIN
    if tag in BOILER and tag not in ("form", "head") or role in ROLES - {"form", "banner"} or words & CLOSED:
        return DROPPED
    if now == ASIDE or words & MARGIN:
        return ASIDE
    if tag == "form" and now == OPEN and not role and not words & ANYWHERE:
        return FORM
    if now == SOFT or tag in ("form", "head") or role in ROLES or words & ANYWHERE:
        return SOFT
    return SOFT if now != MAIN and (tag == "header" or words & OUTSIDE) else now


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(role, text) of the blocks that have text, in page order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    wraps: list[bool] = []  # for each form in open text: whether it wraps the page
    now, at = OPEN, 0

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((-len(wraps) if now == FORM else now if now in (MAIN, OPEN) else DROPPED, text))
            parts.clear()

    while m := TAG.search(page, at):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not ending and tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            close()
        elif tag == "br":
            parts.append("\n")
        if tag not in HOLDERS or tag in VOID:
            continue
        if not ending:
            if raw.rstrip().endswith("/") and tag == "svg":
                continue
            was = now
            into = role_of(tag, raw, now)
            if into != was:
                close()
            stack.append((tag, was))
            now = into
            if into == FORM != was:
                wraps.append(False)
            elif was == FORM and tag in OF_PAGE:
                wraps[-1] = True
        elif any(t == tag for t, _ in stack):
            while True:
                t, was = stack.pop()
                if was != now:
                    close()
                now = was
                if t == tag:
                    break
    rest = OPENED.sub("", page[at:])
    if rest:
        parts.append(html.unescape(rest))
    close()
    return settled(out, wraps) if wraps else out


def settled(blocks: list[tuple[int, str]], wraps: list[bool]) -> list[tuple[int, str]]:
    """The blocks with the roles of those in form ``n``, which have ``-n``: open if the form wraps the page."""
    if not any(r in (MAIN, OPEN) for r, _ in blocks):
        long = {-r for r, t in blocks if r < 0 and t.count(" ") + 1 >= RUN}
        wraps = [w or n in long for n, w in enumerate(wraps, 1)]
    return [(r if r >= 0 else OPEN if wraps[-r - 1] else DROPPED, t) for r, t in blocks]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, and the blocks' roles and texts of each page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = rows.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = [blocks_of(x) for x in part.column(3).to_pylist()]
                roles = pa.array([[r for r, _ in b] for b in found], pa.list_(pa.int32()))
                texts = pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], roles, texts], names=["page_id", "url", "host", "roles", "texts"])

    return rows.mapInArrow(run, "page_id long, url string, host string, roles array<int>, texts array<string>")


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and how many codes each shares with the one before it (0 for the first).

    Prefix doubling; the last code is to stand nowhere else.  What neighbours share
    is put together from the ranks of 2^k codes, largest k first.
    """
    n, step = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels = [rank.astype(np.int32)]
    while int(rank.max()) + 1 < n:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(rank.astype(np.int32))
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
        shared += np.where(levels[k][x] == levels[k][y], 1 << k, 0) * (np.maximum(a, b) + shared < n)
    return order, np.concatenate([[0], shared])


def running_least(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value since the last start, for each place."""
    number = np.cumsum(starts) - 1
    high = int(values.max()) + 1 if len(values) else 1
    return np.minimum.accumulate(values - number * high) + number * high


def shared_lengths(streams: list[list[str]], pages: list[int]) -> list[np.ndarray]:
    """For each word of each stream, the length of the longest run from there that the stream of another page has."""
    hashes: dict[str, int] = {}
    codes = np.concatenate([np.array([*[hashes.setdefault(w, xxhash.xxh64_intdigest(w) >> 1) for w in words], -1 - k], np.int64) for k, words in enumerate(streams)])
    sizes = np.array([len(x) + 1 for x in streams])
    owner = np.repeat(np.unique(np.array(pages, np.int64), return_inverse=True)[1], sizes)
    order, shared = suffix_array(codes)
    page = owner[order]
    found = np.zeros(len(codes), np.int64)
    for backwards in (False, True):
        # The nearest neighbour of another page: the least of what is shared on the way to it.
        p = page[::-1] if backwards else page
        link = np.concatenate([[0], shared[1:][::-1]]) if backwards else shared
        starts = np.concatenate([[True], p[1:] != p[:-1]])
        least = running_least(link, starts)
        place = order[::-1] if backwards else order
        found[place] = np.maximum(found[place], least)
    return np.split(found, np.cumsum(sizes)[:-1])


def maximal_runs(lengths: np.ndarray, least: int = RUN) -> list[tuple[int, int]]:
    """(first word, end) of the runs of a stream that no longer one takes in."""
    ends = np.arange(len(lengths)) + lengths
    reach = np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])
    at = np.flatnonzero((lengths >= least) & (ends > reach))
    return list(zip(at.tolist(), ends[at].tolist(), strict=True))


def runs_of(keys: list[int], pages: list[int], streams: list[list[str]], length: int = RUN) -> list[tuple[int, int, int]]:
    """(key, place, run) of the windows of ``length`` words in the maximal runs of some streams."""
    out = []
    for key, words, lengths in zip(keys, streams, shared_lengths(streams, pages), strict=True):
        codes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        for at, end in maximal_runs(lengths, length):
            places = np.arange(at, end - length + 1)
            run = np.zeros(len(places), np.uint64)
            for k in range(length):
                run = run * np.uint64(0x9E3779B97F4A7C15) + codes[places + k]
                run ^= run >> np.uint64(29)
            out += zip([key] * len(places), places.tolist(), run.astype(np.int64).tolist(), strict=True)
    return list(dict.fromkeys(out))


def short_blocks(texts: list[str]) -> list[tuple[int, int]]:
    """(place, run) of the blocks of fewer than ``RUN`` words; places are -1 - the first word's."""
    out, at = [], 0
    for t in texts:
        n = t.count(" ") + 1
        if n < RUN:
            out.append((-1 - at, (xxhash.xxh3_64_intdigest(t) ^ n) - (1 << 63)))
        at += n
    return out


def streamed(pages: DataFrame) -> DataFrame:
    """``pages`` with a hash of their streams: same."""
    return pages.withColumn("same", F.xxhash64("texts"))


def repeated(pages: DataFrame) -> DataFrame:
    """host, same and the places in that stream where a run of the host begins.

    The groups of a host hold about ``PAGES`` different streams each, and are dealt
    by host and group, so a host of any size is spread over many tasks.
    """
    open_hosts = written(pages.where(F.array_contains("roles", OPEN)).select("host").distinct(), "open-hosts")
    streams = streamed(pages.where("size(texts) > 0").join(sized(open_hosts), "host", "left_semi")).select("host", "url", "same", F.col("texts").alias("stream"))
    first = streams.where("url is not null").groupBy("host", "url").agg(F.min("same").alias("page"), F.max("same").alias("last")).where("page <> last")
    first = written(first.select("host", "url", "page"), "addresses")
    once = streams.join(sized(first), ["host", "url"], "left").groupBy("host", "same").agg(F.min(F.coalesce("page", "same")).alias("page"), F.first("stream").alias("stream"))
    once = written(once, "streams")
    sizes = sized(written(once.groupBy("host").agg(F.count_distinct("page").alias("pages"), F.ceil(F.count(F.lit(1)) / PAGES).alias("groups")), "hosts"))
    dealt = once.join(sizes.select("host", "groups"), "host").withColumn("group", F.pmod("same", "groups"))

    def run(table: pa.Table) -> pa.Table:
        host = table.column("host")[0].as_py()
        texts = dict(zip(table.column("same").to_pylist(), table.column("stream").to_pylist(), strict=True))
        page = dict(zip(texts, table.column("page").to_pylist(), strict=True))
        found = runs_of(list(texts), list(page.values()), [" ".join(t).split(" ") for t in texts.values()], RUN)
        found += [(k, *x) for k, t in texts.items() for x in short_blocks(t)]
        same, place, runs = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"host": pa.array([host] * len(found), pa.string()), "same": pa.array(same, pa.int64()), "page": pa.array([page[k] for k in same], pa.int64()), "place": pa.array(place, pa.int32()), "run": pa.array(runs, pa.int64())})

    dealt = dealt.select("host", "group", "same", "page", "stream").repartition(partitions_for(once), "host", "group")
    runs = written(dealt.groupBy("host", "group").applyInArrow(run, "host string, same long, page long, place int, run long"), "runs")
    counted = runs.select("host", "run", "page").distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW)
    everywhere = counted.join(sizes, "host").where(F.col("n") >= SHARE * F.col("pages")).select("host", "run")
    return runs.join(everywhere, ["host", "run"]).groupBy("host", "same").agg(F.collect_set("place").alias("places"))


def kept_blocks(roles: list[int], texts: list[str], places: list[int] | None) -> list[str]:
    """The blocks of the text: main ones, and the open ones that are not boilerplate."""
    starts = set(places or ())
    covered = {p + i for p in starts if p >= 0 for i in range(RUN)}
    out, at, words = [], 0, 0
    for r, t in zip(roles, texts, strict=True):
        end = at + t.count(" ") + 1
        if r == MAIN:
            out.append((r, t))
        elif r == OPEN:
            # A run that comes in from another block counts only if it takes in this one whole.
            inside = {p + i for p in range(at, end - RUN + 1) if p in starts for i in range(RUN)}
            if -1 - at not in starts and len(inside) < COVERED * (end - at) and not all(i in covered for i in range(at, end)):
                out.append((r, t))
                words += end - at
        at = end
    beside = MAIN not in roles or words >= RUN
    return [t for r, t in out if r == MAIN or beside]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    read = written(parsed(pages), "blocks")
    hits = repeated(read)
    undecided = F.array_contains("roles", OPEN)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(kept_blocks(*x)) for x in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    # Pages that declare the role of all their blocks need no runs, so their blocks are not shuffled.
    sure = read.where(~undecided).withColumn("places", F.lit(None).cast("array<int>"))
    other = streamed(read.where(undecided)).join(hits, ["host", "same"], "left")
    columns = ["page_id", "url", "roles", "texts", "places"]
    out = sure.select(columns).unionByName(other.select(columns)).mapInArrow(assemble, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
