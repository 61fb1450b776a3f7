"""Personal data: candidates, boosted trees, calibrated thresholds, in SQL expressions alone.

Base kinds (email, ip, card, phone) are patterns with a check, and their spans
always stay.  Besides them, generators of high recall propose overlapping spans
of other forms; a boosted-tree model scores each candidate by its format and by
the words before it, and a span is selected where the score reaches the
threshold of its kind, calibrated for a precision of 0.98.

There are no labels for personal data, so examples are made (8,000 by default, a
parameter), never taken from the documents: results do not depend on the data
around a document.  What an example is follows from how it was made (numbers that
are assigned or not, valid or broken check digits, random keys against names and
build numbers), not from its context; the words around it only lean one way, and
now and then the wrong one.  The examples of the fit, of the calibration and of
the quality that ``quality`` reports come from makers with different words.

Positions are code points; a match's place is the total length of what
``split`` leaves before it and of the matches before it.  Patterns begin only
where a run of their characters begins, or where the last match ended, which
keeps them linear on long runs and finds the same matches.

Edge cases: null and empty texts have no spans; white space and marks of any
script are kept as they are; work grows with the length of a text and the number
of its matches, not with their square; overlapping spans are all listed, and
redacted as one, under the name of the first; spans that begin together go by
kind; repeated rows give the same; an empty table gives no rows; other columns are
kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import text_of

#: Base kinds in their order: pattern, check of the match m, and what a text needs to have one.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "contains(t, '@')"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"m rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'", r"t rlike '[0-9]\\.[0-9]'"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "{luhn}", r"t rlike '[0-9]([\\x20-]?[0-9]){11}'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15", "contains(t, '+')"),
}
LUHN = (
    "length(regexp_replace(m, '[^0-9]', '')) between 12 and 19 and aggregate(transform(sequence(1, length(regexp_replace(m, '[^0-9]', ''))),"
    " i -> cast(substr(regexp_replace(m, '[^0-9]', ''), -i, 1) as int) * (2 - i % 2)), 0, (a, v) -> a + v div 10 + v % 10, a -> a % 10 = 0)"
).replace("a + v div 10 + v % 10", "cast(a + v div 10 + v % 10 as int)")
#: Generators of further candidates: pattern, and what a text needs to have one.
MORE = {
    "local_phone": (r"(?:\G|(?<![0-9]))\(?[0-9]{3}\)?[\x20./-]?[0-9]{3}[\x20./-][0-9]{4}(?![0-9])", r"t rlike '[0-9]{3}[\\x20./-][0-9]{4}'"),
    "national_id": (r"(?:\G|(?<![0-9-]))[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'"),
    "iban": (r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"t rlike '[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}'"),
    "secret": (r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{20,}+", r"t rlike '[A-Za-z0-9_-]{20}'"),
    "mac": (r"(?:\G|(?<![0-9A-Fa-f:]))(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", r"t rlike '([0-9A-Fa-f]{2}:){5}'"),
    "spelled_email": (r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++", r"t rlike '[(\\[]at[)\\]]'"),
}
KINDS = [*BASE, *MORE]
#: Words before a span that speak for or against it.
CONTEXT = {
    "call": r"(phone|tel|call|fax|mobile|whatsapp|dial)",
    "key": r"(token|secret|api[_ -]?key|passw|pwd|credential|bearer)",
    "identity": r"(ssn|social|national id|passport|tax id)",
    "bank": r"(iban|bank|account|transfer|bic)",
    "reach": r"(mail|contact|write|reach)",
    "device": r"(mac|device|wifi|ethernet)",
    "count": r"(order|invoice|price|version|isbn|part|lot|item|commit|sha|checksum)",
}
LOOK_BACK = 24
EXAMPLES = 8_000
PRECISION = 0.98
#: What the form of a match m of each kind says by itself: SQL, and the same for one example.
CHECKS = {
    "local_phone": "regexp_replace(m, '[^0-9]', '') rlike '^[2-9]'",
    "national_id": "not (m rlike '^(000|666|9)' or m rlike '-00-' or m rlike '-0000$')",
    "iban": (
        "aggregate(split(concat(substr(replace(m, ' ', ''), 5), substr(replace(m, ' ', ''), 1, 4)), ''), 0, (a, h) ->"
        " cast(case when h = '' then a when h between '0' and '9' then (a * 10 + ascii(h) - 48) % 97 else (a * 100 + ascii(upper(h)) - 55) % 97 end as int)) = 1"
    ),
    "secret": "m rlike '[0-9]' and m rlike '[A-Za-z]'",
    "mac": "m rlike '[A-Fa-f]' and m rlike '[0-9]'",
    "spelled_email": "lower(m) rlike '[^a-z](com|org|net|edu|io|de|fr|es|uk|info)$'",
}
FEATURES = [*[f"k_{k}" for k in MORE], "length", "digits", "letters", "upper", "marks", "check", "distinct", "turns", *CONTEXT]
EMPTY_SPANS = "cast(array() as array<struct<s:int,k:int,e:int,m:string>>)"
#: Matches that are placed one after the other; more are placed in runs of so many.
RUN = 64


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(pattern: str, needs: str, kind: int) -> str:
    """SQL for the spans (start, kind, end, match) of a pattern in t.

    Gaps and matches are placed in runs: the length of each run first, then each
    run from where it begins, so no long array is copied for every match.
    """
    p = quoted(pattern)
    cut = f"zip_with(slice(split(t, {p}, -1), 1, 1000000000), regexp_extract_all(t, {p}, 0), (g, m) -> struct(length(g) as g, m as m))"
    run = f"slice(z, cast(r * {RUN} + 1 as int), {RUN})"
    sums = f"transform(sequence(0, cast((size(z) - 1) div {RUN} as int)), r -> aggregate({run}, 0, (a, x) -> a + x.g + coalesce(length(x.m), 0)))"
    bases = f"aggregate({sums}, struct(0 as at, cast(array() as array<int>) as out), (a, n) -> struct(a.at + n as at, concat(a.out, array(a.at)) as out), a -> a.out)"
    walk = (
        f"aggregate({run}, struct(b as at, {EMPTY_SPANS} as out),"
        f" (a, x) -> if(x.m is null, a, struct(a.at + x.g + length(x.m) as at, concat(a.out, array(struct(a.at + x.g as s, {kind} as k, a.at + x.g + length(x.m) as e, x.m as m))) as out)),"
        " a -> a.out)"
    )
    return f"if({needs}, flatten(transform(array({cut}), z -> flatten(transform({bases}, (b, r) -> {walk})))), {EMPTY_SPANS})"


def base_spans(kind: str) -> str:
    pattern, check, needs = BASE[kind]
    check = check.replace("{luhn}", LUHN).replace("m rlike", "x.m rlike").replace("(m,", "(x.m,")
    spans = found(pattern, needs, KINDS.index(kind))
    return spans if check == "true" else f"filter({spans}, x -> {check})"


def features_sql() -> list[str]:
    """The features of a candidate x in t, in the order of FEATURES."""
    before = f"lower(substr(t, greatest(x.s - {LOOK_BACK}, 0) + 1, least(x.s, {LOOK_BACK})))"
    shape = [f"if(x.k = {KINDS.index(k)}, 1D, 0D)" for k in MORE]
    shape += ["cast(length(x.m) as double)", *[f"cast(length(regexp_replace(x.m, '{c}', '')) as double) / length(x.m)" for c in ("[^0-9]", "[^A-Za-z]", "[^A-Z]", "[A-Za-z0-9]")]]
    check = " ".join(f"when {KINDS.index(k)} then {re.sub(r'(?<![a-zA-Z_.])m(?![a-zA-Z_(])', 'x.m', c)}" for k, c in CHECKS.items())
    shape += [f"if(case x.k {check} else false end, 1D, 0D)", "cast(size(array_distinct(split(x.m, ''))) as double) / length(x.m)"]
    shape += ["cast(length(regexp_replace(regexp_replace(x.m, '[0-9]+', '0'), '[^0-9]+', 'a')) as double) / length(x.m)"]
    return shape + [f"if({before} rlike {quoted(p)}, 1D, 0D)" for p in CONTEXT.values()]


def iban_rest(match: str) -> int:
    plain = match.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def checked(kind: str, match: str) -> bool:
    """``CHECKS`` of one example."""
    if kind == "iban":
        return iban_rest(match) == 1
    digits = re.sub("[^0-9]", "", match)
    return {
        "local_phone": digits[:1] not in "01",
        "national_id": not re.search("^(000|666|9)|-00-|-0000$", match),
        "secret": bool(digits) and bool(re.search("[A-Za-z]", match)),
        "mac": bool(digits) and bool(re.search("[A-Fa-f]", match)),
        "spelled_email": bool(re.search("[^a-z](com|org|net|edu|io|de|fr|es|uk|info)$", match.lower())),
    }[kind]


def features_of(kind: str, match: str, before: str) -> list[float]:
    """The same features of one example."""
    n, before = len(match), before[-LOOK_BACK:].lower()
    count = lambda p: len(re.findall(p, match)) / n
    turns = len(re.sub("[^0-9]+", "a", re.sub("[0-9]+", "0", match))) / n
    shape = [float(n), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[^A-Za-z0-9]"), float(checked(kind, match)), len(set(match)) / n, turns]
    return [float(kind == k) for k in MORE] + shape + [float(bool(re.search(p, before))) for p in CONTEXT.values()]


#: Words before a candidate, for the fit and for the calibration: those of its kind, of other numbers, and of neither.
LEAN = {
    "local_phone": (["phone: ", "call me at ", "tel "], ["fax ", "mobile ", "dial "]),
    "national_id": (["ssn ", "tax id "], ["social security ", "national id "]),
    "iban": (["iban ", "bank account "], ["transfer to ", "bic, then "]),
    "secret": (['token = "', 'api_key: "', "secret "], ["password ", 'bearer "', 'credential="']),
    "mac": (["mac ", "device "], ["wifi card ", "ethernet "]),
    "spelled_email": (["mail ", "contact "], ["write to ", "reach me: "]),
}
AGAINST = ["order no. ", "invoice ", "version ", "commit "], ["item ", "lot ", "part ", "checksum "]
NEITHER = ["and then the ", "it was near ", "of this and ", "; "], ["we saw that ", "under a ", "", "see: "]


def iban_of(rng: random.Random, valid: bool) -> str:
    rest = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 14, 16, 18])))
    land = rng.choice(["DE", "FR", "ES", "GB", "NL", "AT"])
    check = 98 - iban_rest(f"{land}00{rest}") if valid else rng.randint(2, 98)
    return f"{land}{check:02d}{rest}"


def made(rng: random.Random, kind: str, label: bool) -> str:
    """A match of a kind: a real one, or one that only has the form."""
    digits = lambda k, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(k - 1))
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    if kind == "local_phone":
        area = digits(3, "23456789" if label else "01")
        return f"({area}) {digits(3)}-{digits(4)}" if rng.random() < 0.5 else f"{area}{rng.choice('-. ')}{digits(3)}{rng.choice('-.')}{digits(4)}"
    if kind == "national_id":
        area = f"{rng.choice([x for x in range(1, 900) if x != 666]):03d}" if label else rng.choice(["000", "666", digits(3, "9")])
        return f"{area}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    if kind == "iban":
        return iban_of(rng, label)
    if kind == "secret":
        if label:
            return some(hexa, rng.choice([32, 40, 64])) if rng.random() < 0.6 else some(low + low.upper() + "0123456789", rng.randint(20, 48))
        form = rng.random()
        if form < 0.5:
            return some(low, rng.randint(20, 40))
        if form < 0.8:
            return "_".join(some(low, rng.randint(3, 8)) for _ in range(5)) + rng.choice(["", "_v2", "-2024"])
        return digits(rng.randint(20, 30)) if form < 0.9 else some(hexa, rng.choice([32, 40]))  # a build's number looks like a key
    if kind == "mac":
        return ":".join(some(hexa, 2) for _ in range(6)) if label else ":".join(f"{rng.randint(0, 59):02d}" for _ in range(6))
    name = some(low, rng.randint(4, 9))
    end = rng.choice(["com", "org", "net", "de", "io"]) if label else some(low, rng.randint(4, 8))
    return f"{name} (at) {some(low, 6)}{rng.choice([' (dot) ', '.']) if label else '.'}{end}"


def examples(n: int = EXAMPLES, seed: int = 5, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of n made candidates, with the words of the fit (0) or of the calibration (1)."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(n):
        kind, label, lean = rng.choice(list(MORE)), rng.random() < 0.5, rng.random()
        match = made(rng, kind, label)
        # A number that looks like a key is known by its context alone.
        same = kind == "secret" and not label and re.fullmatch("[0-9a-f]{32}|[0-9a-f]{40}", match) and not match.isdigit()
        pool = LEAN[kind] if lean < (0.6 if label else 0.0 if same else 0.15) else AGAINST if lean > (0.97 if label else 0.3 if same else 0.6) else NEITHER
        x.append(features_of(kind, match, rng.choice(NEITHER[words]) + rng.choice(pool[words])))
        y.append(float(label))
    return np.array(x), np.array(y)


@functools.lru_cache(maxsize=4)
def model(n: int = EXAMPLES, precision: float = PRECISION) -> tuple[boost.Trees, dict[str, float]]:
    """Trees, and each kind's least raw score from which on the precision holds for examples of the other words."""
    trees = boost.fit(*examples(n), rounds=30)
    x, label = examples(n, seed=6, words=1)
    raw, limits = trees.raw(x), {}
    for k, kind in enumerate(MORE):
        mine = x[:, k] == 1
        r, y = raw[mine], label[mine]
        limits[kind] = next((float(t) for t in np.unique(r) if y[r >= t].mean() >= precision), float("inf"))
    return trees, limits


def quality(n: int = EXAMPLES, seed: int = 7) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind on examples that neither fit nor calibration has seen, of both sets of words."""
    trees, limits = model()
    both = [examples(n // 2, seed + w, w) for w in (0, 1)]
    x, y = np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both]) == 1
    raw, out = trees.raw(x), {}
    for k, kind in enumerate(MORE):
        mine = x[:, k] == 1
        chosen = raw[mine] >= limits[kind]
        out[kind] = (float(y[mine][chosen].mean()) if chosen.any() else 1.0, float(chosen[y[mine]].mean()))
    return out


def more_spans() -> str:
    """SQL for the selected candidates of the other kinds."""
    trees, limits = model()
    score = trees.sql([f"f[{i}]" for i in range(len(FEATURES))])
    limit = "case x.k " + " ".join(f"when {KINDS.index(k)} then {v!r}D" for k, v in limits.items() if v != float("inf")) + " else double('infinity') end"
    proposed = "concat(" + ", ".join(found(p, needs, KINDS.index(k)) for k, (p, needs) in MORE.items()) + ")"
    chosen = f"aggregate(array(array({', '.join(features_sql())})), 0D, (a, f) -> {score}) >= {limit}"
    return f"filter({proposed}, x -> {chosen})"


def with_spans(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with __base and __spans: arrays of (start, kind number, end, match), sorted."""
    keep = df.columns
    df = df.select("*", text.alias("t"))
    df = df.select(*keep, "t", *[F.expr(base_spans(k)).alias(f"__{k}") for k in BASE], F.expr(more_spans()).alias("__more"))
    base = [f"__{k}" for k in BASE]
    return df.select(*keep, "t", *base, F.array_sort(F.concat(*base)).alias("__base"), F.array_sort(F.concat(*base, "__more")).alias("__spans"))


def listed(spans: Column) -> Column:
    kinds = F.lit(KINDS)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    rows = with_spans(docs.select("doc_id"), F.lit("")) if "text" not in docs.columns else with_spans(docs.select("doc_id", "text"), text_of())
    return rows.select("doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by [KIND] of its first."""
    keep = docs.columns
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    rows = with_spans(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]), text_of(f"c{keep.index(column)}"))
    walk = (
        "array_join(aggregate(__spans, struct(cast(array() as array<string>) as done, 0 as at), (a, x) -> if(x.s < a.at, struct(a.done as done, greatest(a.at, x.e) as at),"
        f" struct(concat(a.done, array(substr(t, a.at + 1, x.s - a.at), array({names})[x.k])) as done, x.e as at)), a -> concat(a.done, array(substr(t, a.at + 1)))), '')"
    )
    clean = F.when(F.size("__spans") > 0, F.expr(walk)).otherwise(F.col(f"c{keep.index(column)}"))
    return rows.select(*[(clean if c == column else F.col(f"c{i}")).alias(c) for i, c in enumerate(keep)])
