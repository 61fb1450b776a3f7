"""Toxicity: boosted trees over dense features, with isotonic calibration.

A lexicon (words, and beginnings of words of four to six letters) is learned
from labelled rows, by four folds, so that a row's own label is never in its
features.  The features are lexicon densities, their nearness to the second
person, capitals, marks and obfuscation rates.  Trees are fitted on three folds;
the fourth calibrates their score.  At most ``SAMPLE`` labelled rows are used
for fitting, chosen by a hash of the id; all documents are scored, whole.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out and never learned from.
doc_id, lang and source are not inputs of a score.

Edge cases: null counts as empty, and empty texts get a score; very long texts are
read whole; equal texts, and so repeated rows, have equal scores; a score that is
exactly the threshold is predicted toxic; a null label is no label; of several
labels of a document the largest counts; without labels of
both kinds all scores are the base rate; an empty table gives no rows; other
columns are kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import bounded_batches, fresh, give_back, text_of

SAMPLE = 20_000
FOLDS = 4
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
#: Second-person words of the four languages of the corpus.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch ihr sie tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros su sus".split())
#: Signs that stand in for letters.
PLAIN = str.maketrans("013457@$!", "oieastasi")
ODD = re.compile(r"\b\w*[^\W\d_][0-9@$*!]+[^\W\d_]\w*", re.UNICODE)
LONG = re.compile(r"(\w)\1\1")
MARK = re.compile(r"[^\w\s]")
CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
NEAR = 3
STEMS = (4, 5, 6)
#: Of a term's labelled documents, the share that has to be toxic, and how many at least.
SHARE, LEAST = 0.5, 3
CACHE_WORDS = 60_000


def terms_of(word: str) -> list[str]:
    """The lexicon entries that a word can match: itself, and its beginnings."""
    return [word] + [f"{word[:n]}*" for n in STEMS if len(word) > n]


class Codes(dict):
    """word -> 1 if it is in the lexicon, 2 if a beginning is, 4 if it is so without obfuscation, 8 for the second person."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        first, *stems = terms_of(word)
        code = (first in self.lexicon) | (2 * any(s in self.lexicon for s in stems)) | (8 * (word in SECOND))
        if not code and not word.isalpha():
            clear = word.translate(PLAIN)
            code |= 4 * any(t in self.lexicon for t in terms_of(clear))
        self[word] = code
        return code


def features(text: str, codes: Codes) -> list[float]:
    words = WORD.findall(text.lower())
    n, chars = max(1, len(words)), max(1, len(text))
    got = np.fromiter(map(codes.__getitem__, words), dtype=np.int8, count=len(words))
    whole, stem, hidden = (got & 1) > 0, (got & 2) > 0, (got & 4) > 0
    hits = np.flatnonzero(whole | stem | hidden)
    second = np.flatnonzero(got & 8)
    near, tight = 0, 0.0
    if len(hits):
        if len(second):
            at = np.searchsorted(second, hits)
            before = np.abs(hits - second[np.maximum(at - 1, 0)])
            after = np.abs(hits - second[np.minimum(at, len(second) - 1)])
            near = int((np.minimum(before, after) <= NEAR).sum())
        tight = float((np.searchsorted(hits, hits + 20) - np.arange(len(hits))).max())
    caps = sum(map(str.isupper, text)) if text.isascii() is False else len(re.findall("[A-Z]", text))
    return [
        np.log1p(len(words)),
        whole.sum() / n,
        stem.sum() / n,
        hidden.sum() / n,
        np.log1p(whole.sum()),
        np.log1p(stem.sum()),
        float((whole & stem).sum()),
        near / n,
        float(near),
        len(second) / n,
        tight,
        caps / chars,
        len(CAPS.findall(text)) / n,
        text.count("!") / chars,
        text.count("?") / chars,
        len(MARK.findall(text)) / chars,
        len(ODD.findall(text)) / n,
        len(LONG.findall(text)) / n,
    ]


def fold_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS


@dataclass
class Model:
    lexicon: frozenset[str] = frozenset()
    trees: boost.Trees = field(default_factory=boost.Trees)
    level: boost.Isotonic = field(default_factory=boost.Isotonic)
    base: float = 0.0

    def scores(self, texts: list[str], codes: Codes) -> np.ndarray:
        if not self.trees.trees:
            return np.full(len(texts), self.base)
        return self.level(self.trees.raw(np.array([features(t, codes) for t in texts]).reshape(len(texts), -1)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chosen(counts: dict[str, tuple], without: int | None) -> frozenset[str]:
    """The lexicon from the counts, leaving one fold out."""
    out = []
    for term, c in counts.items():
        n, t = c[0], c[1]
        if without is not None:
            n, t = n - c[2 + without], t - c[2 + FOLDS + without]
        if t >= LEAST and t >= SHARE * (n + 1):
            out.append(term)
    return frozenset(out)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = [(r.doc_id, r.toxic) for r in known.collect()]
    base = (sum(t for _, t in rows) + 0.5) / (len(rows) + 1)
    if len({t for _, t in rows}) < 2:
        return Model(base=base)
    few = F.broadcast(spark.createDataFrame(rows, "doc_id long, toxic int"))  # at most ``sample`` rows
    texts = docs.select("doc_id", text_of().alias("text")).join(few, "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fold = fold_of(text)
                for term in {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}:
                    c = seen.setdefault(term, [0] * (2 + 2 * FOLDS))
                    c[0] += 1
                    c[1] += toxic
                    c[2 + fold] += 1
                    c[2 + FOLDS + fold] += toxic
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *[pa.array(x, pa.int64()) for x in zip(*seen.values(), strict=True)]], names=["term", *names])
        seen.clear()
        give_back()

    names = ["n", "t", *[f"n{i}" for i in range(FOLDS)], *[f"t{i}" for i in range(FOLDS)]]
    counted = texts.mapInArrow(count, ", ".join(["term string", *[f"{x} long" for x in names]])).groupBy("term").agg(*[F.sum(x).alias(x) for x in names])
    # A term that is chosen without some fold has this many toxic documents and this share at least.
    counts = {r[0]: tuple(r)[1:] for r in counted.where(f"t >= {LEAST} and t >= {SHARE / 2} * n").collect()}
    lexicons = [chosen(counts, f) for f in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [Codes(x) for x in lexicons]
        for batch in batches:
            found = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fold = fold_of(text)
                found.append([float(fold), float(toxic), *map(float, features(text, codes[fold]))])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], names=["row"])
        give_back()

    table = np.array([r.row for r in texts.mapInArrow(measure, "row array<double>").collect()])
    if not len(table) or len(set(table[:, 1])) < 2:
        return Model(base=base)
    fold, y, x = table[:, 0], table[:, 1], table[:, 2:]
    rest = fold == FOLDS - 1
    if rest.all() or not rest.any() or len(set(y[~rest])) < 2:
        rest = np.zeros(len(y), bool)
    trees = boost.fit(x[~rest], y[~rest])
    held = rest if rest.any() else ~rest
    return Model(chosen(counts, None), trees, boost.isotonic(trees.raw(x[held]), y[held]), base)


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = Codes(model.lexicon)
        for texts in batches:
            yield pd.Series(np.clip(model.scores(texts.tolist(), codes), 0.0, 1.0))
        codes.clear()
        give_back()

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, text_of()).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic."""
    model = fit(docs, labels)
    name = fresh(docs, "__score")
    return docs.withColumn(name, score(model, text_of())).where(F.col(name) < THRESHOLD).drop(name)
