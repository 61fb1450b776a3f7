"""Line deduplication over documents.

A text is split at line feeds.  The key of a line is the line without the white
space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case.  Keys are exploded and
hashed (128 bits), and the documents of each hash are counted, each document once.
Lines whose key is long enough and stands in enough documents go, but for those of
the document with the largest ``doc_id`` that holds it.  What stays is put together
by position.

Only hashes and positions are shuffled for the decision.  Keys are met in two ways,
so that no key is a load for one task whatever its share: those that hold at least
one in ``HEAVY`` of all counted lines (there can be no more than ``HEAVY`` of them)
are broadcast, and the rest, each of a small share, are joined by a shuffle.

Edge cases: a null or empty text is one empty line; very long texts are read whole;
each row is a document, so rows that repeat are counted one by one; a null
``doc_id`` is smaller than all others; where rows share the largest ``doc_id`` of a
key, all of them keep its lines; a document that loses all lines has an empty text;
an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, sized, text_of, written
from .exact_dedup import normalised

SPACE = " \t\n\x0b\x0c\r"
#: Least code points of a key, and least documents that hold it.
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that are broadcast: each holds at least one in so many of the counted lines, so there are no more than that.
HEAVY = 200_000


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def keys_of(text: Column) -> Column:
    """The keys of all lines, by position."""
    return F.transform(split_lines(normalised(text)), lambda line: F.btrim(line, F.lit(SPACE)))


def hashes(value: Column) -> list[Column]:
    """128 bits in two columns, of hashes with different seeds."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(7), value).alias("h2")]


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, n_docs and keep_id (the largest ``doc_id``) of the keys that are long and frequent enough."""
    own = F.array_distinct(F.filter(keys_of(text_of()), lambda key: F.length(key) >= min_chars))
    lines = docs.select("doc_id", F.explode(own).alias("key")).select("doc_id", *hashes(F.col("key")))
    counted = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_id"))
    return counted.where(F.col("n_docs") >= min_docs)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text) and the positions of the lines that go; documents that lose none have no row.

    What goes follows from id and text, so rows that agree in both share a row here.
    """
    hot = written(repeated_lines(docs, min_chars, min_docs), "lines-repeated")
    total = hot.agg(F.sum("n_docs")).first()[0] or 0
    t1, t2 = hashes(text_of())
    lines = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.posexplode(keys_of(text_of())).alias("at", "key"))
    lines = lines.where(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "at", *hashes(F.col("key")))
    heavy = F.col("n_docs") * HEAVY >= total
    met = lines.join(F.broadcast(hot.where(heavy)), ["h1", "h2"])
    rest = hot.where(~heavy)
    if rest.limit(1).count():
        met = met.unionByName(lines.join(rest, ["h1", "h2"]))
    gone = met.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("at").alias("gone"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text that stays, and n_lines and n_dropped beside it."""
    gone = written(dropped_positions(docs, min_chars, min_docs), "lines-gone")
    t1, t2, g1, g2, doc_id, at, lines = (fresh(docs, x) for x in ("__t1", "__t2", "__g1", "__g2", "__id", "__gone", "__lines"))
    gone = gone.select(F.col("doc_id").alias(doc_id), F.col("t1").alias(g1), F.col("t2").alias(g2), F.col("gone").alias(at))
    h1, h2 = hashes(text_of())
    keyed = docs.withColumns({t1: h1, t2: h2})
    same = (F.col(t1) == F.col(g1)) & (F.col(t2) == F.col(g2)) & F.col("doc_id").eqNullSafe(F.col(doc_id))
    rows = keyed.join(sized(gone), same, "left").withColumn(lines, split_lines(text_of()))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    kept = F.when(F.col(at).isNull(), text_of()).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return rows.select(*others, kept.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(F.col(at)), F.lit(0)).cast("long").alias("n_dropped"))
