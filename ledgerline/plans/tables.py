"""Queries of the keyed tables, the audit log and the costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import standardize as S
from ledgerline.operators import lineage, records, snapshots, stores
from ledgerline.plans.registry import query
from ledgerline.plans.standardise import COST_SQL, PRICES
from ledgerline.sources.fixtures import CLAIMS_CTE, COST_CTE, FIELDS_CTE, claims, claims_again, cost_log, fields, table

_F = f"WITH {FIELDS_CTE}"
_AGAIN = ", again AS (SELECT claim_id, rec, claimant_name, policy_number, CASE WHEN rec % 10 = 0 THEN 'closed' ELSE status END AS status, state, loss_date, date_reported, total_incurred, CASE WHEN rec % 7 = 0 THEN '' ELSE total_paid END AS total_paid FROM claims WHERE rec % 2 = 0)"
_NAMED = (("Claimant Name", "claimant_name"), ("Loss Date", "loss_date"), ("Status", "status"), ("Total Paid", "total_paid"))
_LOG = "log AS (SELECT event_id, event_type AS event, ts AS event_time, CAST(user_id AS VARCHAR) AS filename, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS parser_ms FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an audit log with JSON details."""
    e = table(spark, sf_dir, "events")
    details = F.to_json(F.struct(F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").cast("double").alias("parser_ms")))
    return e.select("event_id", F.col("event_type").alias("event"), F.col("ts").alias("event_time"), F.col("user_id").cast("string").alias("filename"), details.alias("details"))


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.expand_audit(_log(spark, sf_dir), (("duration_ms", "double"), ("parser_ms", "double")))


def _some_fields(df: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in _NAMED)))
    return df.select("claim_id", "rec", pairs.alias("p")).select("claim_id", "rec", "p.*")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def s05_filtered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("below", -F.col("o_totalprice"))
    return stores.filtered(orders, "o_orderstatus = 'F'", ["below", "o_orderkey"], 100).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def s06_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.count_where(table(spark, sf_dir, "orders"), "o_orderstatus = 'F'")


@query(f"WITH {CLAIMS_CTE}{_AGAIN} SELECT claim_id, status, total_paid FROM again UNION ALL SELECT claim_id, status, total_paid FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM again)")
def s08_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = ("claim_id", "status", "total_paid")
    return stores.upsert(claims(spark, sf_dir).select(*pick), claims_again(spark, sf_dir).select(*pick), ["claim_id"], [F.col("status")])


@query(f"WITH {CLAIMS_CTE} SELECT claim_id, status FROM claims WHERE policy_number IN (SELECT concat('POL-', CAST(c_custkey AS STRING)) FROM customer WHERE c_nationkey = 3)")
def s09_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("POL-"), F.col("c_custkey").cast("string")).alias("policy_number"))
    return stores.lookup(claims(spark, sf_dir), keys, ["policy_number"]).select("claim_id", "status")


@query(f"WITH {CLAIMS_CTE} SELECT claim_id, status FROM claims WHERE policy_number NOT IN (SELECT concat('POL-', CAST(c_custkey AS STRING)) FROM customer WHERE c_nationkey = 3)")
def s10_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("POL-"), F.col("c_custkey").cast("string")).alias("policy_number"))
    return stores.delete_keys(claims(spark, sf_dir), keys, ["policy_number"]).select("claim_id", "status")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def s11_latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT sha256(concat(lang, '|', text)) AS result_key, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def s12_validation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("result_key"), "doc_id")
    return stores.latest(docs, ["result_key"], [F.col("doc_id")])


@query("SELECT 'orders' AS store, count(*) AS rows FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def s13_store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.statistics({n: table(spark, sf_dir, n) for n in ("orders", "events", "documents")})


@query("SELECT concat(CAST(user_id AS VARCHAR), '|', event_type, '|json') AS dup_key, max(ts) AS export_time, count(*) AS exports FROM events GROUP BY ALL")
def s15_export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.lit("json")).alias("dup_key"), "ts", "event_id")
    newest = stores.latest(keyed, ["dup_key"], [F.desc("ts"), F.desc("event_id")]).select("dup_key", F.col("ts").alias("export_time"))
    return newest.join(keyed.groupBy("dup_key").agg(F.count(F.lit(1)).alias("exports")), "dup_key")


@query("WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents), old AS (SELECT h, source AS first_name, doc_id AS first_seen FROM d WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1) SELECT d.doc_id, o.h IS NOT NULL AS duplicate, o.first_name, o.first_seen FROM d LEFT JOIN old o ON o.h = d.h WHERE d.doc_id % 2 = 1")
def j01_seen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), F.sha2("text", 256).alias("file_hash"))
    store = stores.latest(d.filter("doc_id % 2 = 0"), ["file_hash"], [F.col("doc_id")]).withColumnRenamed("doc_id", "first_seen")
    return stores.seen_files(d.filter("doc_id % 2 = 1").drop("filename"), store).select("doc_id", "duplicate", "first_name", "first_seen")


@query("WITH d AS (SELECT doc_id, source AS file, sha256(text) AS h FROM documents), s AS (SELECT h, file, max(doc_id) AS seen FROM d GROUP BY ALL) SELECT d.file, d.doc_id AS sheet, (SELECT s.file FROM s WHERE s.h = d.h AND s.file <> d.file ORDER BY seen DESC, s.file LIMIT 1) AS other FROM d WHERE EXISTS (SELECT 1 FROM s WHERE s.h = d.h AND s.file <> d.file)")
def j02_sheet_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("sheet"), F.sha2("text", 256).alias("sheet_hash"), F.col("doc_id").alias("first_seen"))
    return stores.sheet_duplicates(d).select("file", "sheet", "other")


_MEMORY = "memory AS (SELECT concat('guide|', lower(p_type)) AS mapping_key, min(p_name) AS resolved_field, 'fuzzy' AS method, CAST(80 AS DOUBLE) AS confidence, CAST(count(*) AS INT) AS hit_count, min(p_size) > 3 AS user_corrected FROM part GROUP BY ALL)"


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("guide|"), F.lower("p_type")).alias("mapping_key"))
    return grouped.agg(F.min("p_name").alias("resolved_field"), F.lit("fuzzy").alias("method"), F.lit(80.0).alias("confidence"), F.count(F.lit(1)).cast("int").alias("hit_count"), (F.min("p_size") > 3).alias("user_corrected"))


@query(f"WITH {_MEMORY} SELECT DISTINCT p_type AS source_column, resolved_field, hit_count, user_corrected FROM part LEFT JOIN memory ON mapping_key = concat('guide|', lower(p_type))")
def j05_mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "part").select(F.col("p_type").alias("source_column")).distinct()
    return snapshots.lookup_mappings(columns, _memory(spark, sf_dir), "guide").select("source_column", "resolved_field", "hit_count", "user_corrected")


@query(f"WITH {_MEMORY}, entries AS (SELECT DISTINCT p_type, concat('guide|', lower(p_type)) AS mapping_key FROM part WHERE p_size > 25) SELECT m.mapping_key, CASE WHEN e.mapping_key IS NOT NULL AND NOT user_corrected THEN 'new' ELSE resolved_field END AS resolved_field, CASE WHEN e.mapping_key IS NOT NULL AND NOT user_corrected THEN hit_count + 1 ELSE hit_count END AS hit_count, user_corrected FROM memory m LEFT JOIN entries e ON e.mapping_key = m.mapping_key")
def j06_mapping_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = _memory(spark, sf_dir)
    entries = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_type").alias("source_column"), F.lit("new").alias("resolved_field"), F.lit("fuzzy").alias("method"), F.lit(90.0).alias("confidence")).distinct()
    return snapshots.remember_mappings(memory, entries, "guide").select("mapping_key", "resolved_field", "hit_count", "user_corrected")


_DIFF = " UNION ALL ".join(f"SELECT c.claim_id, '{f}' AS field, trim(c.{x}) AS before, trim(a.{x}) AS after FROM claims c JOIN again a USING (claim_id) WHERE trim(c.{x}) <> trim(a.{x})" for f, x in _NAMED)


@query(f"WITH {CLAIMS_CTE}{_AGAIN}, d AS ({_DIFF}), n AS (SELECT claim_id, {' + '.join(f'CAST(trim({x}) <> {chr(39)}{chr(39)} AS INT)' for _, x in _NAMED)} AS filled FROM again) SELECT n.claim_id, c.rec % 3 <> 0 AS duplicate, CASE WHEN c.rec % 3 <> 0 THEN 'first.csv' END AS prev_filename, CASE WHEN c.rec % 3 <> 0 THEN (SELECT count(*) FROM d WHERE d.claim_id = n.claim_id) END AS changed, CASE WHEN c.rec % 3 <> 0 THEN greatest(0, filled - (SELECT count(*) FROM d WHERE d.claim_id = n.claim_id)) END AS unchanged FROM n JOIN claims c USING (claim_id)")
def j09_reingest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = snapshots.snapshots(_some_fields(claims(spark, sf_dir).filter("rec % 3 <> 0")), F.col("rec")).withColumn("filename", F.lit("first.csv"))
    new = snapshots.snapshots(_some_fields(claims_again(spark, sf_dir)), F.col("rec"))
    return snapshots.check_reingest(new, old).select("claim_id", "duplicate", "prev_filename", F.col("changed").cast("long"), F.col("unchanged").cast("long"))


@query(f"WITH {CLAIMS_CTE}{_AGAIN} {_DIFF}")
def j10_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff_long(_some_fields(claims(spark, sf_dir)), _some_fields(claims_again(spark, sf_dir)))


@query(_F + " SELECT field, lower(trim(value)) AS value, count(DISTINCT claim_id) AS claims, min(claim_id) AS first_claim, max(claim_id) AS last_claim, CAST(CASE WHEN count(DISTINCT claim_id) <= 1 THEN 0 ELSE least(100, 60 + 10 * count(DISTINCT claim_id)) END AS INT) AS confidence FROM fields WHERE trim(value) <> '' GROUP BY ALL")
def a03_value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.value_index(fields(spark, sf_dir))


@query(f"WITH {CLAIMS_CTE} SELECT c.rec, 'Claimant Name' AS field, c.claimant_name AS value, CAST(CASE WHEN n <= 1 THEN 0 ELSE least(100, 60 + 10 * n) END AS INT) AS confidence FROM claims c JOIN (SELECT lower(trim(claimant_name)) AS v, count(DISTINCT claim_id) AS n FROM claims GROUP BY 1) i ON i.v = lower(trim(claimant_name))")
def a04_repeat_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir).filter("field = 'Claimant Name'")
    index = records.value_index(f).select("field", F.col("value").alias("key"), "confidence")
    return f.withColumn("key", F.lower(F.trim("value"))).join(index, ["field", "key"]).select("rec", "field", "value", "confidence")


_KNOWN = f"WITH {_LOG}, k AS (SELECT event, duration_ms, parser_ms, parser_ms / 2 AS api_ms, greatest(0.0, duration_ms - parser_ms - parser_ms / 2) AS orchestration_ms FROM log WHERE duration_ms IS NOT NULL AND parser_ms IS NOT NULL)"


@query(_KNOWN + " SELECT event, grouping(event) = 1 AS overall, count(*) AS calls, round(sum(duration_ms), 1) AS total_ms, round(sum(parser_ms), 1) AS parser_ms, round(sum(api_ms), 1) AS api_ms, round(sum(orchestration_ms), 1) AS orchestration_ms, round(sum(parser_ms) / sum(duration_ms) * 100, 1) AS parser_pct, round(sum(api_ms) / sum(duration_ms) * 100, 1) AS api_pct, round(sum(orchestration_ms) / sum(duration_ms) * 100, 1) AS orchestration_pct FROM k GROUP BY ROLLUP (event)")
def a05_cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _expanded(spark, sf_dir).withColumn("api_ms", F.col("parser_ms") / 2)
    return lineage.cost_breakdown(e.withColumn("orchestration_ms", lineage.orchestration_ms(F.col("duration_ms"), F.col("parser_ms"), F.col("api_ms"))))


@query(f"WITH {_LOG} SELECT event_id, round(greatest(0.0, duration_ms - parser_ms - parser_ms / 2), 6) AS orchestration_ms FROM log")
def a06_orchestration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = lineage.orchestration_ms(F.col("duration_ms"), F.col("parser_ms"), F.col("parser_ms") / 2)
    return _expanded(spark, sf_dir).select("event_id", F.round(rest, 6).alias("orchestration_ms"))


_COSTED = f"WITH {COST_CTE}, c AS (SELECT *, {COST_SQL} AS cost FROM cost_log)"
_TASK = "count(*) AS calls, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, sum(cost) AS cost, min(model) AS model, count(DISTINCT model) AS models"


@query(_COSTED + f", b AS (SELECT doc_name, task, {_TASK} FROM c GROUP BY doc_name, task UNION ALL SELECT NULL, task, {_TASK} FROM c GROUP BY task) SELECT doc_name, task, calls, tokens, round(cost, 6) AS cost, model, models, round(cost / sum(cost) OVER (PARTITION BY doc_name) * 100, 4) AS percent FROM b")
def a07_cost_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.cost_by_task(lineage.token_cost(cost_log(spark, sf_dir), PRICES))


@query(_COSTED + " SELECT doc_name, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum(cost), 6) AS total_cost, string_agg(DISTINCT model, ',' ORDER BY model) AS models_used FROM c GROUP BY doc_name")
def a08_cost_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.cost_by_document(lineage.token_cost(cost_log(spark, sf_dir), PRICES))


@query("SELECT doc_name, count(*) AS calls, sum(pages)::BIGINT AS pages, round(sum(pages * 0.01), 4) AS cost, grouping(doc_name) = 1 AS overall FROM (SELECT concat('doc-', CAST(l_suppkey AS VARCHAR)) AS doc_name, CAST(l_quantity AS INT) AS pages FROM lineitem) GROUP BY ROLLUP (doc_name)")
def a09_page_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("doc-"), F.col("l_suppkey").cast("string")).alias("doc_name"), F.col("l_quantity").cast("int").alias("pages"))
    return lineage.page_cost(calls.withColumn("cost", F.col("pages") * 0.01))


@query("SELECT event_type AS event, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL")
def a16_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.event_counts(_log(spark, sf_dir), F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query(_COSTED + " SELECT count(*) AS calls, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM c")
def a21_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    costed = lineage.token_cost(cost_log(spark, sf_dir), PRICES)
    return lineage.usage_totals(costed)


@query(_F + " SELECT sheet, field, sum(CAST(regexp_replace(trim(value), '[,$%]', '', 'g') AS DECIMAL(18,2))) AS total FROM fields WHERE field IN ('Total Incurred', 'Total Paid') AND regexp_full_match(trim(regexp_replace(value, '[,$%]', '', 'g')), '[+-]?[0-9]+\\.?[0-9]*') GROUP BY ALL HAVING bool_or(CAST(regexp_replace(trim(value), '[,$%]', '', 'g') AS DECIMAL(18,2)) <> 0)")
def a01_column_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.column_totals(fields(spark, sf_dir))


@query(_F + ", t AS (SELECT sheet, field, sum(CAST(value AS DECIMAL(18,2))) AS total FROM fields WHERE field = 'Total Paid' AND value <> '' GROUP BY ALL) SELECT 's1' AS sheet, 'Total Paid' AS field, CAST(1 AS DECIMAL(28,2)) AS total, 'row' AS source UNION ALL SELECT sheet, field, total, 'computed' FROM t WHERE sheet <> 's1'")
def a02_totals_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    computed = records.column_totals(fields(spark, sf_dir).filter("field = 'Total Paid'"))
    explicit = computed.filter("sheet = 's1'").withColumn("total", F.lit(1).cast("decimal(28,2)"))
    return records.totals_with_fallback(explicit, computed)


@query("SELECT user_id AS document_id, event_type AS status, ts AS at, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, min(ts) OVER (PARTITION BY user_id) AS created_at, max(ts) OVER (PARTITION BY user_id) AS updated_at FROM events")
def w05_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), "event_id")
    return lineage.lifecycle(e)


_EDITS = "edits AS (SELECT 's' AS sheet, CAST(user_id AS VARCHAR) AS claim_id, 'f' AS field, event_type AS new_value, ts AS edited_at, event_id AS edit_id FROM events)"
_HISTORY = f"WITH {_EDITS}, h AS (SELECT *, lag(new_value) OVER (PARTITION BY sheet, claim_id, field ORDER BY edited_at, edit_id) AS old_value FROM edits)"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("s").alias("sheet"), F.col("user_id").cast("string").alias("claim_id"), F.lit("f").alias("field"), F.col("event_type").alias("new_value"), F.col("ts").alias("edited_at"), F.col("event_id").alias("edit_id"))


@query(_HISTORY + " SELECT * FROM h WHERE old_value IS NULL OR old_value <> new_value")
def w06_edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edit_history(_edits(spark, sf_dir))


@query(_HISTORY + " SELECT claim_id, field, arg_min_null(old_value, (edited_at, edit_id)) AS first_value, arg_max_null(new_value, (edited_at, edit_id)) AS last_value, count(*) AS edits FROM h WHERE old_value IS NULL OR old_value <> new_value GROUP BY ALL")
def a23_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.change_summary(lineage.edit_history(_edits(spark, sf_dir)))


@query("SELECT user_id AS claim_id, event_type AS event, ts AS event_time, event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' THEN 'session' ELSE 'history' END AS part FROM events QUALIFY event_type <> 'signup' OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def w07_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("event"), F.col("ts").alias("event_time"), "event_id")
    return lineage.timeline(e, ["signup"], F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("SELECT event_id, event_type AS event, ts AS event_time, concat('{\"claimant_name\":\"', CASE WHEN length(event_type) <= 2 THEN repeat('*', length(event_type)) ELSE repeat('*', length(event_type) - 2) || right(event_type, 2) END, '\",\"kind\":\"', event_type, '\"}') AS details FROM events")
def r02_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), F.col("ts").alias("event_time"), F.col("event_type").alias("claimant_name"), F.col("event_type").alias("kind"))
    return lineage.audit_rows(e, ("event_id", "event", "event_time"))


@query(f"WITH {_LOG} SELECT event_id, event, event_time, filename, duration_ms, parser_ms FROM log")
def r03_expanded_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir)


_ORDER3 = "try_strptime({0}, ['%m/%d/%Y','%d/%m/%Y','%Y-%m-%d'])"


@query(f"WITH {CLAIMS_CTE}, d AS (SELECT rec, CAST({_ORDER3.format('loss_date')} AS DATE) AS loss, CAST({_ORDER3.format('date_reported')} AS DATE) AS reported FROM claims) SELECT rec, CAST(CASE WHEN reported < loss THEN greatest(10, rec % 100 - 30) ELSE rec % 100 END AS INT) AS loss_confidence, CAST(CASE WHEN reported < loss THEN 60 ELSE 90 END AS INT) AS reported_confidence FROM d")
def f13_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    mapped = c.select(
        "rec", S.parse_order_date(F.col("loss_date")).alias("loss"), S.parse_order_date(F.col("date_reported")).alias("reported"), F.lit(None).cast("date").alias("closed"),
        (F.col("rec") % 100).cast("int").alias("loss_confidence"), F.lit(90).alias("reported_confidence"), F.lit(90).alias("closed_confidence"),
    )
    return records.date_order_conflicts(mapped).select("rec", "loss_confidence", "reported_confidence")


@query(f"WITH {CLAIMS_CTE}, p AS (SELECT rec, concat('s', CAST(rec % 4 AS STRING)) AS sheet, concat('CLM-', lpad(CAST(rec + 4 * (rec % 3) AS STRING), 7, '0')) AS new_id FROM claims) SELECT DISTINCT p.sheet, p.rec, p.new_id FROM p JOIN claims c ON c.claim_id = p.new_id AND c.rec % 4 = p.rec % 4 AND c.rec <> p.rec")
def f18_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = F.concat(F.lit("s"), (F.col("rec") % 4).cast("string"))
    c = claims(spark, sf_dir).select("rec", "claim_id", sheet.alias("sheet"))
    proposed = c.select("sheet", "rec", F.concat(F.lit("CLM-"), F.lpad((F.col("rec") + 4 * (F.col("rec") % 3)).cast("string"), 7, "0")).alias("new_id"))
    return records.duplicate_ids(proposed, c)


@query(_F + ", required AS (SELECT unnest(['Total Paid', 'Adjuster Name']) AS field) SELECT DISTINCT f.rec, r.field FROM fields f, required r WHERE NOT EXISTS (SELECT 1 FROM fields x WHERE x.rec = f.rec AND x.field = r.field AND trim(x.value) <> '')")
def j21_missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    return records.missing_required(f, f, spark.createDataFrame([("Total Paid",), ("Adjuster Name",)], "field string"))


@query(_F + " SELECT rec, field, CASE WHEN rec % 5 = 0 AND field = 'Status' THEN 'edited' ELSE value END AS value FROM fields WHERE NOT (rec % 7 = 0 AND field = 'State') UNION ALL SELECT DISTINCT rec, 'Note', 'added' FROM fields WHERE rec % 9 = 0")
def j26_edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    at = lambda n: F.lit(n).alias("edited_at")
    status = f.filter("rec % 5 = 0 AND field = 'Status'")
    edits = (
        status.select("rec", "field", F.lit("edit").alias("kind"), F.lit("first try").alias("new_value"), at(1))
        .union(status.select("rec", "field", F.lit("edit"), F.lit("edited"), at(2)))
        .union(f.filter("rec % 7 = 0 AND field = 'State'").select("rec", "field", F.lit("delete"), F.lit(None).cast("string"), at(1)))
        .union(f.filter("rec % 9 = 0").select("rec").distinct().select("rec", F.lit("Note"), F.lit("add"), F.lit("added"), at(1)))
    )
    return records.overlay_edits(f, edits)
