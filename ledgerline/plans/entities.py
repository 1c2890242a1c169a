"""Queries of the signal and entity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import lineage, records
from ledgerline.operators import signals as G
from ledgerline.plans.registry import query
from ledgerline.plans.texts import _SIGNALS, DICTIONARY, _signals
from ledgerline.sources.fixtures import CLAIMS_CTE, FIELDS_CTE, claims, fields, table

_TYPES = "CASE event_type WHEN 'signup' THEN 'legal_escalation' WHEN 'error' THEN 'severity' WHEN 'click' THEN 'coverage_note' WHEN 'view' THEN 'brand appetite' ELSE 'other' END"


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "signup", "legal_escalation").when(e == "error", "severity").when(e == "click", "coverage_note").when(e == "view", "brand appetite").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", "event_type", kind.alias("kind"))


@query(f"WITH {CLAIMS_CTE} SELECT rec, trim(regexp_replace(regexp_replace(regexp_replace(replace('C  ' || status || chr(9) || ' ' || state || ' .-', chr(160), ' '), '[ \\t]+', ' ', 'g'), '^[ :.\\n\\t-]+|[ :.\\n\\t-]+$', '', 'g'), '^[CBDOX]\\s+', '')) AS text FROM claims")
def p22_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("C  "), "status", F.lit("\t "), "state", F.lit(" .-"))
    return claims(spark, sf_dir).select("rec", G.clean_text(raw).alias("text"))


@query(f"SELECT event_id, CASE {_TYPES} WHEN 'legal_escalation' THEN 'Litigation Risk' WHEN 'coverage_note' THEN 'Coverage Risk' WHEN 'brand appetite' THEN 'Reputation Risk' ELSE 'Exposure Risk' END AS category FROM events")
def p23_risk_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(spark, sf_dir).select("event_id", G.risk_category(F.col("kind")).alias("category"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Moderate' WHEN {_TYPES} IN ('legal_escalation', 'severity') THEN 'High' ELSE 'Low' END AS severity FROM events")
def p24_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_id") % 3 == 0, " moderate ").otherwise("??")
    return _types(spark, sf_dir).select("event_id", G.severity(level, F.col("kind")).alias("severity"))


@query(
    f"WITH {_SIGNALS}, b AS (SELECT *, least(0.82, 0.40 + 0.12 * ln(1 + len(string_split(keyword, ' '))) + 0.002 * least(length(keyword), 20)) * CASE severity WHEN 'Highly Severe' THEN 1.06 WHEN 'High' THEN 1.02 WHEN 'Moderate' THEN 1.0 ELSE 0.94 END + 0.05 / len(string_split(keyword, ' ')) * CASE WHEN contains(keyword, 'the') THEN 1 ELSE 0 END AS c FROM signals)"
    " SELECT doc_id, keyword, CAST(round_even(least(0.97, greatest(0.30, c)), 2) AS DOUBLE) AS confidence FROM b"
)
def p25_keyword_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("doc_id", "keyword", G.keyword_confidence(F.col("keyword"), F.col("severity"), F.lit("it is the one")).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount WHEN l_quantity > 25 THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence FROM lineitem")
def p33_effective_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.effective_confidence(F.col("l_discount"), F.col("l_quantity") > 25).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * (l_tax * 100 + 1) / 1000.0 > 0.05 AS large FROM lineitem")
def p29_polygon_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = F.array(point(F.lit(1), F.lit(0)), point(F.col("l_quantity") + 1, F.lit(0)), point(F.lit(1), F.col("l_tax") * 100 + 1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.covers_too_much(box, F.lit(100.0), F.lit(10.0), 0.05).alias("large"))


@query(f"WITH {FIELDS_CTE} SELECT DISTINCT CASE field WHEN 'State' THEN 'Home_Address' ELSE field END AS field FROM fields WHERE field <> 'State'")
def f06_included_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = F.when(F.col("field") == "State", "Home_Address").otherwise(F.col("field"))
    return fields(spark, sf_dir).select(renamed.alias("field")).distinct().filter(~G.is_excluded(F.col("field")))


@query("SELECT l_orderkey, l_linenumber, l_discount AS confidence FROM lineitem WHERE l_discount < 0.03")
def f12_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.low_confidence(table(spark, sf_dir, "lineitem").withColumnRenamed("l_discount", "confidence"), 0.03).select("l_orderkey", "l_linenumber", "confidence")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'missing: analysis' END AS problem FROM events")
def f15_output_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("doc_type"), F.lit("x"))).otherwise(F.create_map(F.lit("doc_type"), F.lit("x"), F.lit("analysis"), F.lit("y")))
    return table(spark, sf_dir, "events").select("event_id", G.has_keys(result, ("doc_type", "analysis")).alias("problem"))


@query("SELECT doc_id, field, value, 0.92::DOUBLE AS confidence FROM (SELECT doc_id, 'Email' AS field, regexp_replace(regexp_extract(text, '(?:^|[^a-zA-Z0-9_])([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})', 1), '[.,;]+$', '') AS value FROM documents) WHERE length(value) >= 2")
def x16_typed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = {"Email": "(?:^|[^a-zA-Z0-9_])([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})"}
    return G.typed_patterns(table(spark, sf_dir, "documents"), mail)


@query("WITH e AS (SELECT user_id AS doc_id, event_type AS field, round(value / 100) AS confidence, event_id AS pos FROM events) SELECT doc_id, field, confidence, pos FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, pos) = 1")
def a11_ocr_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"), F.round(F.col("value") / 100).alias("confidence"), F.lit(1).alias("page"), F.col("event_id").alias("pos"))
    return G.ocr_index(e).select("doc_id", "field", "confidence", "pos")


@query("SELECT l_suppkey AS doc_id, count(*) AS fields, count(*) FILTER (l_tax > 0.04) AS matched, count(*) FILTER (l_quantity > 25) AS boxed, count(*) FILTER (l_returnflag = 'R') AS edited FROM lineitem GROUP BY ALL")
def a15_extraction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_tax") > 0.04).alias("matched"), (F.col("l_quantity") > 25).alias("boxed"), (F.col("l_returnflag") == "R").alias("edited"))
    return G.coverage(each)


_SHARES = "s AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{t}' AS label, list_filter({list(w)}, lambda x: contains(lower(text), x)) AS found, {len(w)} AS n FROM documents" for i, (t, w) in enumerate(DICTIONARY.items())) + ")"


@query(f"WITH {_SHARES} SELECT doc_id, CASE WHEN len(found) > 0 THEN label ELSE 'General' END AS label, round(len(found) / n, 4) AS share, array_to_string(found, ',') AS found FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(found) / n DESC, ord) = 1")
def a17_label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_rules(table(spark, sf_dir, "documents"), DICTIONARY)


@query("SELECT p_brand AS doc_type, p_type AS kind, count(*) AS n FROM part GROUP BY ALL")
def a18_dictionary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dictionary_summary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_type"), F.col("p_type").alias("kind")))


@query(f"WITH {FIELDS_CTE} SELECT rec, field, value FROM fields WHERE lower(trim(value)) NOT IN ('', 'yes', 'no', 'n/a', 'pending')")
def a22_flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.without_placeholders(fields(spark, sf_dir), ("", "yes", "no", "n/a", "pending")).select("rec", "field", "value")


@query("SELECT l_suppkey, sum(l_extendedprice * l_discount)::DECIMAL(18,2)::DOUBLE AS cost FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_extendedprice * l_discount) DESC, l_suppkey LIMIT 8")
def o01_cost_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("c"))
    return lineage.listing(by, "c", "l_suppkey", 8).select("l_suppkey", F.col("c").cast("decimal(18,2)").cast("double").alias("cost"))


@query("SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def o02_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return records.key_union(e.filter("event_type = 'error'").select("user_id"), e.filter("event_type = 'signup'").select("user_id"))


_LISTS = "a AS (SELECT p_type AS name, min(p_partkey) AS ord FROM part WHERE p_size < 20 GROUP BY 1), b AS (SELECT p_type AS name, min(p_partkey) AS ord FROM part WHERE p_size >= 10 GROUP BY 1)"


@query(f"WITH {_LISTS} SELECT name, 0 AS part, ord FROM a UNION ALL SELECT name, 1, ord FROM b WHERE name NOT IN (SELECT name FROM a)")
def o05_expected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda cond: table(spark, sf_dir, "part").filter(cond).groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return G.field_list(some("p_size < 20"), some("p_size >= 10"))


@query("SELECT user_id AS doc_id, event_type AS name, 'strong' AS value FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0) UNION ALL SELECT user_id, event_type, 'weak' FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1) o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.user_id AND e.event_type = o.event_type AND e.event_id % 2 = 0)")
def j25_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda k, word: table(spark, sf_dir, "events").filter(F.col("event_id") % 2 == k).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("name")).distinct().withColumn("value", F.lit(word))
    return G.merge_sources(half(0, "strong"), half(1, "weak"))


@query(f"WITH {CLAIMS_CTE} SELECT concat('s', CAST(rec % 4 AS STRING)) AS sheet, rec, CASE WHEN rec % 3 <> 0 THEN claim_id WHEN length(policy_number) >= 6 THEN policy_number ELSE CAST(rec + 1 AS VARCHAR) END AS claim_id, CASE WHEN rec % 3 <> 0 THEN 1 WHEN length(policy_number) >= 6 THEN 2 ELSE 3 END AS stage FROM claims")
def j23_claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir).filter("NOT (rec % 3 = 0 AND field = 'Claim Number')").select("sheet", "rec", "pos", "field", "value")
    return G.claim_ids(f)


@query(f"WITH {FIELDS_CTE} SELECT DISTINCT ON (sheet, rec) sheet, rec, field, value FROM fields WHERE field IN ('Total Paid', 'Status') AND value <> '' ORDER BY sheet, rec, field = 'Status'")
def j22_lookup_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lookup_value(fields(spark, sf_dir).select("sheet", "rec", "pos", "field", "value"), ("paid", "status"))


@query("SELECT doc_id, 'damages' AS keyword, 'x hit me' AS snippet, CASE WHEN doc_id % 2 = 0 THEN 'recovery_subrogation' ELSE 'severity' END AS type, CASE WHEN doc_id % 2 = 0 THEN 'High' ELSE 'Low' END AS severity, doc_id % 2 = 0 AS reclassified FROM documents")
def j19_reclassified_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "legal_escalation").otherwise("severity")
    return G.reclassify(docs.select("doc_id", F.lit("damages").alias("keyword"), F.lit("x hit me").alias("snippet"), kind.alias("type"), F.lit("Low").alias("severity")), docs)


#: Signals of a user's events: layers, types in either case, triggers that hold each other's beginnings, and empty ones.
_LAYERED = """SELECT user_id AS doc_id, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'model' WHEN 1 THEN 'enriched' ELSE 'keyword' END AS layer, event_id AS ord, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Tone' WHEN 1 THEN 'tone' ELSE 'Legal' END AS type,
 CASE CAST(event_id % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('the ', event_type, ' of page ', CAST(event_id % 13 AS STRING), ' in a long line of words') WHEN 2 THEN concat(event_type, ' of page ', CAST(event_id % 11 AS STRING)) WHEN 3 THEN substring(event_type, 2, 3) WHEN 4 THEN concat('Of Page ', CAST(event_id % 5 AS STRING)) ELSE event_type END AS keyword"""


@query(
    f"WITH RECURSIVE s AS ({_LAYERED.replace('STRING', 'VARCHAR')} FROM events), k AS (SELECT *, lower(type) AS t, lower(type) || ':' || lower(keyword)[1:30] AS k, lower(keyword)[1:10] AS p, row_number() OVER (PARTITION BY doc_id ORDER BY layer = 'keyword', layer <> 'model', ord) AS i FROM s),"
    " w AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS keys, false AS took FROM k UNION ALL SELECT doc_id, i, CASE WHEN took THEN list_append(keys, k) ELSE keys END, took FROM (SELECT w.doc_id, k.i, w.keys, k.k,"
    " NOT list_contains(w.keys, k.k) AND NOT (k.layer = 'keyword' AND k.p <> '' AND len(list_filter(w.keys, lambda x: split_part(x, ':', 1) = k.t AND contains(x, k.p))) > 0) AS took FROM w JOIN k ON k.doc_id = w.doc_id AND k.i = w.i + 1))"
    " SELECT doc_id, layer, ord, type, keyword FROM k JOIN w USING (doc_id, i) WHERE took"
)
def w03_layered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_layers(spark.sql(_LAYERED + " FROM {events}", events=table(spark, sf_dir, "events")))


@query(
    f"WITH {CLAIMS_CTE}, d AS (SELECT rec, CAST(try_strptime(loss_date, ['%Y-%m-%d','%m/%d/%Y','%m-%d-%Y','%d/%m/%Y']) AS DATE) AS d FROM claims) SELECT rec AS doc_id, 'Loss Date in future' AS signal, 'High' AS severity, CAST(d AS VARCHAR) AS evidence FROM d WHERE d > DATE '1995-01-01' UNION ALL SELECT rec, 'few fields', 'Moderate', '1' FROM claims UNION ALL SELECT rec, 'few words', 'Low', '3' FROM claims"
)
def r01_rule_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = claims(spark, sf_dir).select(F.col("rec").alias("doc_id"), F.lit("only three words").alias("text"), F.create_map(F.lit("Loss Date"), F.col("loss_date")).alias("fields"))
    return G.rule_signals(docs, F.lit("1995-01-01").cast("date"))
