"""Queries of parsed texts, places on pages, cost listings, flat exports and checks of records, in all their branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import lineage, places, records, stores, texts
from ledgerline.plans.registry import query
from ledgerline.plans.standardise import PRICES
from ledgerline.plans.tables import _COSTED, _log
from ledgerline.sources.fixtures import CLAIMS_CTE, FIELDS_CTE, claims, cost_log, fields, table

_C, _F = f"WITH {CLAIMS_CTE}", f"WITH {FIELDS_CTE}"
_Q = lambda p: "'" + p.replace("'", "''") + "'"


@query(
    f"{_C}, d AS (SELECT rec, claim_id, status, state, claimant_name FROM claims) SELECT rec, CASE CAST(rec % 6 AS INT) WHEN 0 THEN claim_id WHEN 1 THEN status WHEN 2 THEN state || ' t' WHEN 3 THEN '[PAGE 7]' || chr(10) || claim_id || chr(10) || chr(10) || '[PAGE 2]' || chr(10) || status || chr(10) || chr(10) || '[PAGE 3]' || chr(10) || 'c' WHEN 4 THEN '' ELSE '[PAGE 5]' || chr(10) || 'tr ' || state END AS full_text FROM d"
)
def s04_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text that is not empty, else the pages by their first text that is not, numbered where they have no number."""
    none = F.lit(None).cast("string")
    page = lambda num, no, raw, text, content, script: F.struct(F.lit(num).cast("int").alias("page_num"), F.lit(no).cast("int").alias("page"), raw.alias("raw_text"), text.alias("text"), content.alias("content"), script.alias("transcript"))
    c, r = claims(spark, sf_dir), F.col("rec") % 6
    one = F.array(page(7, 1, F.col("claim_id"), F.lit("no"), none, none), page(None, None, F.lit(""), F.lit(" "), none, none), page(None, None, none, F.col("status"), F.lit("no"), none), page(None, None, F.lit(""), none, F.lit(" c\n"), none))
    other = F.array(page(None, 5, none, none, none, F.concat(F.lit("tr "), "state")))
    pages = F.when(r == 3, one).when(r == 5, other)
    full = texts.full_text(F.when(r == 0, F.concat(F.lit(" "), "claim_id", F.lit("\n"))).otherwise(""), F.when(r == 1, F.col("status")), F.when(r == 2, F.concat("state", F.lit(" t"))), none, pages)
    return c.select("rec", full.alias("full_text"))


_TEXT = (
    "concat('Report of the day', {n}, 'Claim ID: ', claim_id, {n}, CASE WHEN rec % 2 = 0 THEN concat('claim-id: other', {n}) ELSE '' END, CASE WHEN rec % 3 = 0 THEN concat('Notes:', {n}, 'below the ', state, {n}) ELSE '' END, '  Status = ', status, {n}, 'This is long: no', {n},"
    " 'Total Paid    ', total_incurred, {n}, 'Office: MAIN DESK', {n}, 'Unit: A1 DESK', {n}, 'Status: ', CASE WHEN rec % 4 = 0 THEN '' ELSE 'again' END, {n}, 'one two three four five six seven eight: x', {n}, 'A: b', {n}, 'Peril:fire', {n}, 'Loss O''Neil & Co. (x)/y: ', CASE WHEN rec % 5 = 0 THEN repeat('long ', 401) ELSE 'short' END)"
)


@query(
    f"{_C}, d AS (SELECT rec AS doc_id, {_TEXT.replace('{n}', 'chr(10)')} AS text FROM claims), f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {k} AS pass, unnest(range(1000)) AS i, trim(unnest(regexp_extract_all(text, {_Q(p)}, 1)), ' ' || chr(9) || chr(10)) AS label, trim(unnest(regexp_extract_all(text, {_Q(p)}, 2)), ' ' || chr(9) || chr(10)) AS value, {c} AS confidence FROM d" for k, (c, p) in enumerate(texts.LABELLED))
    + f"), g AS (SELECT * FROM f WHERE label IS NOT NULL AND len(label) <= 55 AND len(regexp_extract_all(label, '\\S+')) <= 7 AND NOT regexp_matches(label, {_Q('(?i)' + texts.VERBS)}) AND value <> '' AND len(value) <= 2000 AND NOT (value = upper(value) AND len(regexp_extract_all(value, '\\S+')) <= 4 AND NOT regexp_matches(value, '[0-9]')))"
    f" SELECT doc_id, label, value, CAST(confidence AS DOUBLE) AS confidence FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(label), '[\\\\s_-]+', '_', 'g') ORDER BY pass, i) = 1"
)
def x14_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.text_fields(claims(spark, sf_dir).select(F.col("rec").alias("doc_id"), F.expr(_TEXT.replace("{n}", "'\n'")).alias("text")))


_TOLD = (
    "SELECT concat('s ', CASE CAST(rec % 3 AS INT) WHEN 0 THEN 'Fleet' ELSE 'book' END) AS sheet, rec, pos, field, value, modified, standard FROM (SELECT rec, 1 AS pos, 'Loss Description' AS field, CASE WHEN rec % 5 = 0 THEN '1/2/2024' ELSE concat('hail fell on ', claimant_name) END AS value, CASE WHEN rec % 7 = 0 THEN 'a strain of the back' END AS modified, CAST(NULL AS STRING) AS standard FROM claims"
    " UNION ALL SELECT rec, 2, 'Remarks', concat('told in ', state), '', CASE WHEN rec % 2 = 0 THEN 'Cause of Loss' END FROM claims UNION ALL SELECT rec, 3, 'Cause of Loss', CASE CAST(rec % 4 AS INT) WHEN 0 THEN 'Fire' WHEN 1 THEN '' WHEN 2 THEN 'Burnt. And wet.' ELSE NULL END, NULL, NULL FROM claims UNION ALL SELECT rec, 4, 'Claimant', claimant_name, NULL, NULL FROM claims UNION ALL SELECT rec, 5, 'Note', 'short', NULL, NULL FROM claims) AS u"
)
_CALLED = " ".join(f"WHEN regexp_matches(lower(sheet || ' ' || t), {_Q('|'.join(words))}) THEN '{name}'" for name, (words, _) in texts.TAXONOMIES.items() if words)


@query(
    f"{_C}, f AS ({_TOLD.replace('AS STRING', 'AS VARCHAR')}), s AS (SELECT *, trim(coalesce(nullif(modified, ''), nullif(value, ''), '')) AS v FROM f),"
    f" r AS (SELECT sheet, rec, string_agg(v, ' | ' ORDER BY pos) FILTER (len(v) > 6 AND NOT regexp_matches(v, {_Q(texts.SHORT_DATE)}) AND (regexp_matches(field, {_Q('(?i)' + texts.DESCRIPTIONS)}) AND NOT regexp_matches(field, {_Q('(?i)' + texts.NO_DESCRIPTIONS)}) OR coalesce(regexp_matches(standard, '(?i){texts.STANDARD_DESCRIPTIONS}'), false))) AS t,"
    f" bool_or(field = 'Cause of Loss' AND len(v) BETWEEN 4 AND 59 AND NOT contains(v, '.')) AS known FROM s GROUP BY sheet, rec) SELECT sheet, rec, t AS text, CASE {_CALLED} ELSE 'general' END AS taxonomy FROM r WHERE t <> '' AND NOT known"
)
def j20_cause_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.cause_candidates(spark.sql(_TOLD.replace("FROM claims", "FROM {claims}"), claims=claims(spark, sf_dir)))



@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(CASE l_linenumber % 4 WHEN 0 THEN least(l_quantity, 20) WHEN 1 THEN l_quantity ELSE 20 END AS DOUBLE) END AS x0, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(CASE l_linenumber % 4 WHEN 0 THEN greatest(l_quantity + 1, 30) WHEN 1 THEN l_quantity + 1 ELSE 30 END AS DOUBLE) END AS x1,"
    " CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(CASE l_linenumber % 4 WHEN 0 THEN greatest(l_tax * 100, 5) WHEN 1 THEN l_tax * 100 ELSE 5 END AS DOUBLE) END AS y1, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE 4 END AS corners FROM lineitem"
)
def p29_merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around two polygons, one or neither of which may be missing."""
    point, k = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), F.col("l_linenumber") % 4
    a = F.when(k.isin(0, 1), F.array(point(F.col("l_quantity") + 1, F.lit(0)), point(F.col("l_quantity"), F.col("l_tax") * 100)))
    b = F.when(k.isin(0, 2), F.array(point(F.lit(20), F.lit(5)), point(F.lit(30), F.lit(0))))
    box = places.merged_box(a, b)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box[0]["x"].alias("x0"), box[1]["x"].alias("x1"), box[2]["y"].alias("y1"), F.nullif(F.size(box), F.lit(-1)).alias("corners"))


@query(
    f"{_C}, t AS (SELECT rec, 1 AS pos, 'Claim Status' AS name, status AS value, 0.5 AS c, false AS p FROM claims UNION ALL SELECT rec, 2, 'Status', 'text', 0.5, rec % 2 = 0 FROM claims UNION ALL SELECT rec, 3, 'State', state, 0.5, false FROM claims WHERE rec % 3 = 0)"
    " SELECT rec AS doc_id, CAST(row_number() OVER (PARTITION BY rec ORDER BY k, pos) - 1 AS INT) AS ord, name, value, CAST(CASE WHEN k = 0 AND name = 'Claim Status' THEN 0.9 WHEN k = 0 AND name = 'State' THEN 0.5 ELSE c END AS DOUBLE) AS confidence, CASE WHEN k = 0 AND name IN ('Claim Status', 'State') THEN true ELSE p END AS placed, CASE k WHEN 0 THEN 'text' ELSE 'ocr' END AS source"
    " FROM (SELECT 0 AS k, * FROM t UNION ALL SELECT 1, rec, 2, 'state', 'ocr', 0.0, true FROM claims WHERE rec % 3 <> 0 UNION ALL SELECT 1, rec, 3, 'Paid', 'ocr', 0.8, false FROM claims) AS u"
)
def j24_enriched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR fields that lift a text field (the first whose name holds theirs), that come twice, and that are new."""
    c = claims(spark, sf_dir)
    polygon = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    row = lambda pos, name, value, sure, poly: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), value.alias("value"), F.lit(sure).alias("confidence"), poly.alias("polygon"))
    each = lambda *rows: c.select(F.col("rec").alias("doc_id"), F.lit(1).alias("page"), "rec", F.explode(F.array(*rows)).alias("f")).select("doc_id", "page", "rec", "f.*")
    text = each(row(1, "Claim Status", F.col("status"), 0.5, none), row(2, "Status", F.lit("text"), 0.5, F.when(F.col("rec") % 2 == 0, polygon)), row(3, "State", F.col("state"), 0.5, none)).filter("pos < 3 OR rec % 3 = 0")
    ocr = each(row(1, "STATUS", F.lit("ocr"), 0.9, polygon), row(2, "state", F.lit("ocr"), 0.0, polygon), row(3, "Paid", F.lit("ocr"), 0.8, none))
    got = places.enriched_fields(text.drop("rec"), ocr.drop("rec"))
    return got.select("doc_id", "ord", "name", "value", "confidence", F.col("polygon").isNotNull().alias("placed"), "source")


@query(
    f"{_COSTED}, b AS (SELECT doc_name, task, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(cost) AS cost, array_to_string(list_sort(list(DISTINCT model))[1:2], ', ') AS models FROM c GROUP BY GROUPING SETS ((doc_name, task), (task)))"
    " SELECT doc_name, CAST(row_number() OVER (PARTITION BY doc_name ORDER BY cost DESC, task) AS INT) AS place, task, models, calls, prompt_tokens, completion_tokens, round(cost, 6) AS cost, round(cost / sum(cost) OVER (PARTITION BY doc_name) * 100, 4) AS percent FROM b"
)
def a07_task_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.task_listing(lineage.token_cost(cost_log(spark, sf_dir), PRICES))


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def a16_full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.event_counts(_log(spark, sf_dir))


@query(_C + ", v AS (SELECT policy_number AS sheet, unnest([claim_id, claimant_name, status, state, loss_date, total_incurred, total_paid, '']) AS v FROM claims) SELECT sheet, sha256(string_agg(trim(v) || chr(1), '' ORDER BY trim(v))) AS sheet_hash FROM v WHERE trim(v) <> '' GROUP BY sheet")
def p20_policy_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the sheets, one for each policy, whatever their order."""
    cells = F.explode(F.array("claim_id", "claimant_name", "status", "state", "loss_date", "total_incurred", "total_paid", F.lit(""))).alias("v")
    return stores.sheet_hash(claims(spark, sf_dir).select(F.col("policy_number").alias("sheet"), cells), "sheet", "v", "\x01")


@query(
    _F + ", m AS (SELECT rec, field, value, ((rec * 7 + pos * 13) % 100) / 100.0 AS c FROM fields WHERE NOT (rec % 4 = 0 AND field = 'Status')), q AS (SELECT unnest(['Status', 'Total Paid', 'Adjuster']) AS field)"
    " SELECT rec, field, 'low confidence' AS reason FROM m WHERE c < 0.3 UNION ALL SELECT r.rec, q.field, 'missing' FROM (SELECT DISTINCT rec FROM m) r, q WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rec = r.rec AND m.field = q.field AND trim(m.value) <> '')"
)
def f12_incomplete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fields(spark, sf_dir).filter("NOT (rec % 4 = 0 AND field = 'Status')").withColumn("confidence", ((F.col("rec") * 7 + F.col("pos") * 13) % 100) / 100.0)
    return records.incomplete(m.select("rec", "field", "value", "confidence"), spark.createDataFrame([("Status",), ("Total Paid",), ("Adjuster",)], "field string"), 0.3)


_SHOWN = "CASE WHEN rec % 5 = 0 AND field = 'Status' THEN 'by hand' WHEN field = 'State' AND rec % 3 = 0 THEN 'N/A' WHEN field = 'Loss Date' AND rec % 4 = 0 THEN ' Yes' WHEN field = 'Claimant Name' AND rec % 6 = 0 THEN 'call 555-123.4567 after noon' WHEN field = 'Policy Number' AND rec % 6 = 0 THEN '555 123 4567' ELSE value END"


@query(
    f"{_F}, s AS (SELECT rec AS doc_id, pos, field, {_SHOWN} AS v FROM fields) SELECT doc_id, '{{' || string_agg('\"' || field || '\":\"' || v || '\"', ',' ORDER BY pos) || '}}' AS document FROM s WHERE lower(trim(v)) NOT IN {(*records.EXPORT_PLACEHOLDERS, 'yes', 'no', 'true', 'false')} AND NOT (regexp_matches(v, {_Q(records.PHONE)}) AND len(v) > 20) GROUP BY doc_id"
)
def a22_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir).withColumn("modified", F.expr(_SHOWN.replace("WHEN rec % 5 = 0 AND field = 'Status' THEN 'by hand' ", "")))
    edits = f.filter("rec % 5 = 0 AND field = 'Status'").select(F.col("rec").alias("doc_id"), F.col("field").alias("name"), F.lit("by hand").alias("new_value"))
    return records.flat_export(f.select(F.col("rec").alias("doc_id"), "pos", F.col("field").alias("name"), "value", "modified"), edits)


@query("SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier")
def o02_keys_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda name, column: table(spark, sf_dir, name).select(F.col(column).cast("long").alias("user_id"))
    return records.key_union(table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id"), key("customer", "c_custkey"), key("supplier", "s_suppkey"))
