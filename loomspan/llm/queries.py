"""The registered queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, hmm_lm, licenses, packing, quality, secrets, simhash, token_counts, toxicity
from .common import read


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.language_model_scores(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    _, findings = secrets.update_ledger(docs)  # from an empty ledger: each blob is scanned once
    return secrets.by_path(docs, findings).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_rows(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_hmm_lm, op2_secret_scan, op3_decontaminate, op4_token_counts, op5_license_scan, op6_quality, op7_toxicity, op8_simhash, op9_packing, op10_ann, pipeline)}

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(name: str, order: int, pattern: str, good: str) -> str:
    return f"""
    SELECT row_no, {order} AS kind_no, '{name}' AS kind, end_at - length(m) AS start_at, end_at, {good} AS good FROM (
        SELECT row_no, m, sum(length(g) + length(m)) OVER (PARTITION BY row_no ORDER BY nth) AS end_at FROM (
            SELECT row_no, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest((string_split_regex(text, '{pattern}'))[1:-2]) AS g, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS nth FROM d))"""


SQL = {
    "op2_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_kind("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
UNION ALL {_kind("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
UNION ALL {_kind("hex", 2, "[0-9a-f]+", "length(m) >= 24")}
UNION ALL {_kind("pem", 3, "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:(?:-{0,4}[^-])*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?", "true")}),
by_row AS (
    SELECT row_no, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
        string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind_no) FILTER (kind_no < 3) AS base,
        string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind_no) AS spans
    FROM found WHERE good GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_row USING (row_no)""",
    "op3_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT DISTINCT item, least(10, len(words)) AS width, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS gram
    FROM (SELECT item, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS i FROM b WHERE len(words) > 0)),
widths AS (SELECT DISTINCT width FROM w),
places AS (SELECT row_no, width, i, array_to_string(words[i:i + width - 1], ' ') AS gram
    FROM (SELECT row_no, words, width, unnest(generate_series(1, len(words) - width + 1)) AS i FROM d, widths)),
hits AS (SELECT row_no, i, places.width, item FROM places JOIN w USING (width, gram)),
hit_words AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(generate_series(i, i + width - 1)) AS place FROM hits) GROUP BY row_no),
items AS (SELECT row_no, count(DISTINCT item) AS n_items, sha256(coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '')) AS digest FROM hits GROUP BY row_no)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (row_no) LEFT JOIN items USING (row_no)""",
}
