"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, fingerprints, html_text, line_dedup, merkle, near_join, packing, pieces, pii, sharding, token_files, toxicity
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_maglev_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document, 512 shards."""
    names = [f"shard-{i:04d}" for i in range(sharding.SHARDS)]
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], sharding.lookup_table(names))
    return placed.select("doc_id", "slot", "shard")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with merge-dropout, and the hash of what they decode to."""
    rows = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, for every source."""
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_maglev_placement, op3_html_text, op4_exact_dedup, op5_near_join, op6_pieces, op7_token_files, op8_toxicity, op9_packing, op10_fingerprints, op11_filter_audit, op12_merkle_manifest, op13_line_dedup)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def merkle_sql(levels: int = 5, tops: int = 4) -> str:
    """SQL of the manifest for sources of at most 16**levels rows, and 16**tops sources: a pair of tables for each level."""
    leaf = lambda text: "sha256(concat(" + ", ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + "))"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [f"""d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS probe FROM documents),
    n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, leaf AS h FROM d),
    b0 AS (SELECT doc_id, g, leaf, probe AS f, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i FROM d)"""]
    keep, subroot = "doc_id, b.g, leaf", ""
    for k in range(levels + tops):
        if k == levels:  # from here on the subroots are the leaves of one tree
            parts.append(f"s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM n{k})")
            parts.append(f"n{k}_ AS (SELECT '' AS g, j AS i, subroot AS h FROM s)")
            parts.append(f"b{k}_ AS (SELECT doc_id, '' AS g, leaf, subroot, f, proof, j AS i FROM b{k} JOIN s USING (g))")
            keep, subroot = "doc_id, b.g, leaf, subroot", "_"
        n, b = (f"{x}{k}{subroot if k == levels else ''}" for x in "nb")
        parts.append(f"r{k} AS (SELECT g, i // 16 AS p, list(h ORDER BY i) AS run, (SELECT count(*) FROM {n} c WHERE c.g = a.g) > 1 AS more FROM {n} a GROUP BY g, p)")
        parts.append(f"n{k + 1} AS (SELECT g, p AS i, CASE WHEN more THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM r{k})")
        parts.append(f"""b{k + 1} AS (SELECT {keep}, CASE WHEN more THEN sha256(array_to_string(list_transform(run, lambda x, i: CASE WHEN i = b.i % 16 + 1 THEN f ELSE x END), '')) ELSE f END AS f,
            proof || array_to_string(list_filter(run, lambda x, i: i <> b.i % 16 + 1), '') AS proof, b.i // 16 AS i FROM {b} b JOIN r{k} r ON r.g = b.g AND r.p = b.i // 16)""")
    last = levels + tops
    return "WITH " + ",\n    ".join(parts) + f"""
    SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = n.h AS verified FROM b{last}, n{last} n"""


ORACLES = {
    "op4_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_filter_audit": """
        WITH w AS (SELECT doc_id, coalesce(source, '') AS part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least
            FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
        m AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
                + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
            FROM w LEFT JOIN labels USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, k.range::INT AS step, 1 << (ascii(filter_order[k.range]) - 65) AS bit,
                coalesce(list_sum(list_transform(range(1, k.range), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0)::INT AS earlier FROM p, range(1, 6) k),
        r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM c, s GROUP BY ALL)
        SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r""",
    "op12_merkle_manifest": merkle_sql(),
    "op13_line_dedup": f"""
        WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM d),
        r AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < keep_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep_id IS NULL OR doc_id = keep_id), '')) AS kept_sha256
        FROM k LEFT JOIN r USING (key) GROUP BY doc_id""",
}
