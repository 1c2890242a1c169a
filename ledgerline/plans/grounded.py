"""Grounding of entities and signals in texts on claims, by each of the checks and by none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import grounding as G
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import CLAIMS_CTE, claims

_TEXT = "concat('Report on ', claimant_name, ' of ', state, ': file no. ', substring(claim_id, 5, 7), CASE CAST(rec % 4 AS INT) WHEN 0 THEN ', an attorney called twice' WHEN 1 THEN ', pre hearing talk' WHEN 2 THEN ', Water; came! in-side' ELSE '' END)"
#: Name and value, by place.
_ENTITIES = (
    ("Claimant", "claimant_name"), ("State", "concat(state, ' zzz')"), ("File", "concat('#', substring(claim_id, 5, 3), '-', substring(claim_id, 8, 4))"), ("Severity of it", "'made up'"), ("Peril", "'water came upstairs'"), ("Office", "'nowhere at all'"),
    ("Short", "'q'"), ("Amount", "total_paid"), ("None", "CAST(NULL AS STRING)"),
)
#: Type, keyword, description and snippet, by place.
_SIGNALS = (
    ("tone", "''", "''", "concat('report on ', claimant_name)"), ("tone", "'pre-hearing'", "''", "''"), ("tone", "'twice over'", "''", "'so'"), ("tone", "''", "'signal detected: attorney mentioned'", "''"), ("Legal_Escalation", "''", "'nothing'", "''"),
    ("tone", "'x'", "''", "'report zzz yyy xxx'"), ("tone", "'zzzz'", "'reported words found elsewhere'", "'qqq www eee'"), ("coverage_issue", "''", "CAST(NULL AS STRING)", "state"),
)
_DOCS = f"SELECT rec AS doc_id, CASE WHEN rec % 10 = 0 THEN 'txt' ELSE 'pdf' END AS source, CASE WHEN rec % 13 = 5 THEN '' ELSE {_TEXT} END AS text, claim_id, claimant_name, state, total_paid, rec FROM claims"
_E = " UNION ALL ".join(f"SELECT rec AS doc_id, {i} AS pos, '{n}' AS name, {v} AS value, 0.9 AS confidence FROM claims" for i, (n, v) in enumerate(_ENTITIES))
_S = " UNION ALL ".join(f"SELECT rec AS doc_id, {i} AS pos, '{t}' AS type, {k} AS keyword, {d} AS description, {s} AS snippet, 0.8 AS confidence FROM claims" for i, (t, k, d, s) in enumerate(_SIGNALS))
_duck = lambda sql: sql.replace("AS STRING", "AS VARCHAR")
_W = lambda x, n: f"list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: len(w) >= {n}))"
_BARE = lambda x: f"regexp_replace({x}, '[^\\pL\\pN_\\s]', ' ', 'g')"
_PART = lambda a, b, least: f"(len({a}) > 0 AND len(list_intersect({a}, {b})) >= {least} * len({a}))"
_HINTS = " OR ".join(f"lower(type) = '{t}' AND regexp_matches(low, '{'|'.join(words)}')" for t, words in G.TYPE_WORDS.items())


def _spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM claims", "FROM {c}"), c=claims(spark, sf_dir))


@query(
    f"WITH {CLAIMS_CTE}, d AS ({_duck(_DOCS)}), e AS ({_duck(_E)}), j AS (SELECT e.*, source, lower(text) AS low, lower(trim(coalesce(value, ''))) AS v FROM e JOIN d USING (doc_id)),"
    f" k AS (SELECT *, source = 'txt' OR regexp_matches(lower(name), '{'|'.join(G.EXEMPT_NAMES)}') OR len(v) < 2 OR contains(low, v) OR {_PART(_W(_BARE('v'), 3), _W(_BARE('low'), 1), 0.5)} OR (len(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 AND contains(regexp_replace(low, '[^0-9]', '', 'g'), regexp_replace(v, '[^0-9]', '', 'g'))) AS ok FROM j)"
    " SELECT doc_id, pos, name, value, CAST(CASE WHEN ok THEN 0.9 ELSE 0.45 END AS DOUBLE) AS confidence, ok AS verified FROM k"
)
def j17_verified_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _spark(spark, sf_dir, _E).withColumn("confidence", F.col("confidence").cast("double"))
    return G.verified_entities(e, _spark(spark, sf_dir, _DOCS))


@query(
    f"WITH {CLAIMS_CTE}, d AS ({_duck(_DOCS)}), s AS ({_duck(_S)}), j AS (SELECT s.*, lower(text) AS low, lower(trim(coalesce(snippet, ''))) AS sn, lower(trim(keyword)) AS tr, lower(trim(coalesce(description, ''))) AS de FROM s JOIN d USING (doc_id)),"
    f" k AS (SELECT *, low = '' OR (len(sn) >= 3 AND (contains(low, sn) OR {_PART(_W('sn', 3), _W('low', 1), 0.25)})) OR (tr <> '' AND (contains(low, tr) OR contains(low, replace(tr, '-', ' ')) OR list_has_any({_W('tr', 4)}, {_W('low', 1)})))"
    f" OR {_PART(f'list_filter({_W('de', 5)}, lambda w: w NOT IN {G.PLAIN_WORDS})', _W('low', 1), 0.3)} OR {_HINTS} AS ok FROM j)"
    " SELECT doc_id, pos, type, keyword, description, snippet, CAST(CASE WHEN ok THEN 0.8 ELSE 0.45 END AS DOUBLE) AS confidence, ok AS verified FROM k"
)
def j18_verified_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spark(spark, sf_dir, _S).withColumn("confidence", F.col("confidence").cast("double"))
    return G.verified_signals(s, _spark(spark, sf_dir, _DOCS))
