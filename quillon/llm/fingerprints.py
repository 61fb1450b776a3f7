"""Document fingerprints by one-permutation MinHash, in DataFrame expressions alone.

A text's words (lower case, cut at white space) give shingles of five words; a
text of one to four words is one shingle.  Each shingle is hashed once.  The top
eight bits of a hash choose one of 256 bins and each bin keeps its least hash.
An empty bin takes the value of the first bin that is not empty in its own
random order of bins (optimal densification).  The eight low-order bits of each
bin are stored.  Two fingerprints that agree in a share ``m`` of their bins have
the likeness ``(m - 1/256) / (1 - 1/256)``, not below 0: the correction takes
away what agrees by chance.

Sorting does the binning: the hashes are sorted together with one mark at the
upper end of every bin, so the first element of each bin is its least hash, or
its mark if the bin is empty.

Edge cases: null counts as empty; texts without words have the fingerprint of
zeros, like one another and unlike others; ``doc_id`` null comes after all
others in the descending order; rows of one ``doc_id`` are ordered by length and
hash; the only document is its own next; repeated rows each give a row, with equal
fingerprints; very long texts are hashed whole (a text's array of words is in one
row); an empty table gives no rows; other columns are not read, whatever their
names.  Ids that stand on very many rows, or null ids, are one range, which one task
orders.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, text_of, written

WORDS, BITS = 5, 8
BINS = 256
LOW = (1 << 56) - 1
#: Places of the random orders that are tried before the whole order is searched.
TRIES = 16
#: Documents of a range of ids, about.
RANGE = 1024
MARKS = [(b << 56) | LOW for b in range(-128, 128)]
ORDERS = [int(x) for i in range(BINS) for x in np.random.RandomState(7919 + i).permutation(BINS)[:TRIES]]
HEX = [f"{b:02x}" for b in range(256)]


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: 256 values of -128 to 127.  One projection a step."""
    words, hashes, ordered, least, bins = (f"__{name}_{x}" for x in ("words", "hashes", "sorted", "least", "bins"))
    keep = df.columns
    w = F.col(words)
    df = df.select(*keep, F.array_remove(F.split(F.lower(text), r"\s+"), "").alias(words))
    many = F.transform(F.slice(w, 1, F.size(w) - (WORDS - 1)), lambda x, i: F.xxhash64(x, *[w[i + k] for k in range(1, WORDS)]))
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, F.when(F.size(w) >= WORDS, many).otherwise(few).alias(hashes))
    df = df.select(*keep, F.sort_array(F.concat(hashes, F.lit(MARKS).cast("array<bigint>"))).alias(ordered))
    s = F.col(ordered)
    df = df.select(*keep, F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(s[F.greatest(i - 1, F.lit(0))], 56))).alias(least))
    empty = lambda x: x.bitwiseAND(LOW) == LOW
    value = lambda x: (x.bitwiseAND(255) - 128).cast("tinyint")
    df = df.select(*keep, F.filter(least, lambda x: ~empty(x)).alias(least), F.transform(least, lambda x: F.when(~empty(x), value(x))).alias(bins))
    order, b = F.lit(ORDERS), F.col(bins)
    # The bin that comes first in bin i's order: the least hash of (i, bin) stands for it where the tries found none.
    search = lambda i: F.array_min(F.transform(least, lambda x: F.struct(F.xxhash64(i, F.shiftright(x, 56)).alias("rank"), value(x).alias("value"))))["value"]
    dense = F.transform(b, lambda v, i: F.coalesce(v, *[b[order[i * TRIES + t]] for t in range(TRIES)], search(i), F.lit(-128).cast("tinyint")))
    return df.select(*keep, dense.alias(name))


def packed(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda v: F.lit(HEX)[v.cast("int") + 128]), "")


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.filter(a, lambda v, i: v == b[i])) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def range_number(low: Column, width: Column) -> Column:
    wide = "decimal(20,0)"
    return F.floor((F.col("doc_id").cast(wide) - low.cast(wide)) / width.cast("double")).cast("long")


def in_ranges(rows: DataFrame, ids: DataFrame, each: int = RANGE) -> DataFrame:
    """``rows`` with a range number, ranges of about ``each`` ids, and copies of the
    first row of each range as the guest of the range before it (descending).

    Two levels of equal widths: the second divides what the first left crowded.
    """
    n, low, high = ids.select(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) // max(1, -(-n // each))))
    coarse = range_number(F.lit(low), F.lit(float(width)))
    stats = ids.groupBy(coarse.alias("stat")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    wide = "decimal(20,0)"
    stats = stats.select("stat", "low", F.greatest(F.lit(1.0), F.ceil((F.col("high").cast(wide) - F.col("low").cast(wide) + 1).cast("double") / F.ceil(F.col("n") / each))).alias("width"))
    stats = written(stats, "ranges")

    def ranged(df: DataFrame) -> DataFrame:
        found = df.withColumn("coarse", coarse).join(sized(stats), F.col("coarse").eqNullSafe(F.col("stat")), "left").drop("stat")
        return found.withColumn("fine", range_number(F.col("low"), F.col("width"))).drop("low", "width")

    down = Window.orderBy(F.col("coarse").desc_nulls_last(), F.col("fine").desc_nulls_last())
    heads = ranged(ids).groupBy("coarse", "fine").agg(F.max("doc_id").alias("head"))
    # One row a range: the order of the ranges is all that a single task sees.
    heads = heads.select("head", F.lag("coarse").over(down).alias("c"), F.lag("fine").over(down).alias("f"), F.lag(F.lit(1)).over(down).alias("has"))
    heads = written(heads, "heads")
    last = ranged(ids).select("coarse", "fine").orderBy(F.col("coarse").asc_nulls_first(), F.col("fine").asc_nulls_first()).limit(1).collect()
    c, f = (last[0].coarse, last[0].fine) if last else (None, None)
    heads = heads.select(
        F.col("head"),
        F.struct(F.when(F.col("has") == 1, F.col("c")).otherwise(F.lit(c)).cast("long").alias("coarse"), F.when(F.col("has") == 1, F.col("f")).otherwise(F.lit(f)).cast("long").alias("fine"), F.lit(True).alias("guest")).alias("to"),
    )
    placed = ranged(rows).join(sized(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct("coarse", "fine", F.lit(False).alias("guest"))
    return placed.withColumn("at", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.col("to"))))).drop("to", "head", "coarse", "fine").select("*", "at.*").drop("at")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, and the text and fingerprint of the next document in descending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = with_fingerprint(rows, "text", "fp")
    placed = in_ranges(rows, docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    order = Window.partitionBy("coarse", "fine").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.length("text").desc(), F.xxhash64("text"))
    return placed.select("doc_id", "text", "fp", "guest", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).where("not guest").drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
