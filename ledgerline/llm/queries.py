"""Registered queries of the text operators: name to (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import conversations, decontaminate, jaccard, lexical, licenses, lines, lm, packing, pii, quality, search_sql, secrets, sharding, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of the registered query; a deployment brings its own.
PII_KEY = "registered query"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.fit_line_field(docs, _table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(packing.pack_documents(_table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hit_ranges")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantise(_table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_pseudonyms, op2_secret_scan, op3_quality_rules, op4_line_dedup, op5_lm_scores, op6_jaccard_join, op7_packing, op8_decontamination, op9_license_scan, op10_sharding, op11_exact_top_k, op12_lexical_search, op13_conversation_repair)
}
_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD}, '[0-9a-z\\x{{{{80}}}}-\\x{{{{10FFFF}}}}]+')"
_D = f"d AS (SELECT row_number() OVER () AS r, doc_id, text, {_WORDS.format('text')} AS w FROM documents)"
_OP8 = f"""
WITH {_D},
 items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format('text')} AS w FROM benchmark),
 sized AS (SELECT item, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
 patterns AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM sized, unnest(range(1, len(w) - m + 2)) AS t(i)),
 places AS (SELECT r, i, k.m, array_to_string(w[i:i + k.m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM patterns) k, unnest(range(1, len(w) - k.m + 2)) AS t(i)),
 hits AS (SELECT r, i, m, item FROM places JOIN patterns USING (m, g)),
 covered AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + m)) AS x FROM hits) GROUP BY r),
 found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r)
"""
_PHRASES = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES)
_TEMPLATES = ", ".join(f"('{label}', {licenses.template_words(t)})" for label, t in licenses.TEMPLATES)
_OP9 = f"""
WITH {_D},
 phrases AS (SELECT * FROM (VALUES {_PHRASES}) AS t(p, label)),
 templates AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(label, tw)),
 hits AS (SELECT r, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS place FROM d, phrases),
 base AS (SELECT r, count(*) AS n, min(place) AS f, max(place) AS l, list(DISTINCT label) AS labels FROM hits GROUP BY r),
 blocks AS (SELECT r, {_WORDS.format('line')} AS s FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
 shares AS (SELECT r, label, len(list_intersect(list_distinct(s), tw)) / len(tw) AS c FROM blocks, templates),
 found AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS score FROM shares WHERE c >= {licenses.THRESHOLD} - 1e-9 GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(x.labels, [])))), ',') AS labels, CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN found x USING (r)
"""
ORACLE_SQL: dict[str, str] = {"op8_decontamination": _OP8, "op9_license_scan": _OP9, "op11_exact_top_k": search_sql.TOP_K, "op12_lexical_search": search_sql.LEXICAL, "op13_conversation_repair": search_sql.REPAIR}
