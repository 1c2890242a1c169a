"""Queries that write keyed tables in several commits and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators import lineage, mapping, stores
from ledgerline.operators.keyed_store import KeyedTable, shared_folder
from ledgerline.plans.registry import query
from ledgerline.plans.tables import _AGAIN
from ledgerline.sources.fixtures import CLAIMS_CTE, claims, claims_again, table


def _table(spark: SparkSession, schema: str, key: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, shared_folder(spark), StructType.fromDDL(schema), [key], buckets)


@query(f"WITH {CLAIMS_CTE}{_AGAIN}, u AS (SELECT claim_id, status, total_paid, rec FROM again UNION ALL SELECT claim_id, status, total_paid, rec FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM again)) SELECT claim_id, status, total_paid FROM u WHERE rec % 11 <> 3")
def s08_partitioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load, an upsert, the same upsert again, and a delete."""
    store, order = _table(spark, "claim_id string, status string, total_paid string", "claim_id"), [F.col("status")]
    store.upsert(claims(spark, sf_dir), order, "load")
    for _ in range(2):
        store.upsert(claims_again(spark, sf_dir), order, "again")
    store.delete(claims(spark, sf_dir).filter("rec % 11 = 3"))
    store.expire(1)
    return store.read()


@query(
    "WITH d AS (SELECT sha256(text) AS sheet_hash, source AS sheet_name, doc_id AS saved_at, text, doc_id % 2 AS batch FROM documents), saved AS (SELECT * FROM d WHERE saved_at % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY sheet_hash ORDER BY batch DESC, saved_at DESC) = 1)"
    " SELECT DISTINCT d.sheet_hash, s.sheet_name, s.saved_at, translate(s.text, chr(8211) || chr(8212) || chr(8217), '--''') AS data, s.sheet_hash IS NOT NULL AS hit FROM d LEFT JOIN saved s USING (sheet_hash)"
)
def s11_parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saves under content hashes, then a load of all hashes, seen or not."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sheet_hash"), F.col("source").alias("sheet_name"), F.col("doc_id").alias("saved_at"), F.col("text").alias("data"))
    store = _table(spark, "sheet_hash string, sheet_name string, saved_at long, data string", "sheet_hash")
    for half in (0, 1):
        stores.save_parsed(store, d.filter(f"saved_at % 3 <> 0 AND saved_at % 2 = {half}"))
    return stores.load_parsed(store, d.select("sheet_hash").distinct())


_RECORD = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN concat('{\"filename\":\"f', CAST(user_id AS STRING), '\",\"timestamp\":\"t', CAST(event_id AS STRING), '\",\"cost_metadata\":{\"total_cost_usd\":0.5}}') WHEN 1 THEN '{\"record_count\":7,\"type\":\"other\"}' WHEN 2 THEN 'broken {' ELSE NULL END"


@query(
    f"WITH e AS (SELECT *, {_RECORD.replace('STRING', 'VARCHAR')} AS record FROM events), x AS (SELECT *, concat_ws('|', CAST(user_id AS VARCHAR), 's', event_type) AS dup_key FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) = 1),"
    " j AS (SELECT *, CASE WHEN json_valid(record) THEN record ELSE '{}' END AS r FROM x)"
    " SELECT dup_key, coalesce(r ->> '$.filename', CAST(user_id AS VARCHAR)) AS filename, 's' AS sheet, coalesce(r ->> '$.type', event_type) AS type, coalesce(r ->> '$.record_count', CASE WHEN event_id % 5 = 0 THEN '0' ELSE CAST(event_id % 100 AS VARCHAR) END) AS record_count,"
    " coalesce(r ->> '$.timestamp', CAST(event_id AS VARCHAR)) AS timestamp, r ->> '$.cost_metadata.total_cost_usd' AS cost FROM j"
)
def s15_export_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports in two commits, read back with the columns where a record lacks a value."""
    count = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100)
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("filename"), F.lit("s").alias("sheet"), F.col("event_type").alias("export_type"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("export_time"), count.alias("record_count"), F.expr(_RECORD).alias("record_json"))
    store = _table(spark, stores.EXPORTS, "dup_key")
    for half in (0, 1):
        stores.append_exports(store, e.filter(f"event_id % 2 = {half}"))
    return stores.read_exports(store).withColumn("timestamp", F.regexp_replace("timestamp", "^0+(?=[0-9])", ""))


@query(
    "WITH u AS (SELECT vec_id, 'col ' || vec_id AS header, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),"
    " p AS (SELECT h.vec_id, h.header, max(list_dot_product(h.u, c.u)) AS score, arg_max(c.vec_id, (round(list_dot_product(h.u, c.u), 12), -c.vec_id)) AS c FROM u h, u c WHERE c.vec_id < 20 AND h.vec_id >= 20 GROUP BY ALL),"
    " a AS (SELECT vec_id, header, vec_id % 5 = 0 AS old, vec_id % 2 = 0 AS first, CASE WHEN vec_id % 5 = 0 THEN 'm' WHEN score >= 0.3 THEN 'f' || c WHEN vec_id % 3 = 0 THEN 'out' END AS field,"
    " CASE WHEN vec_id % 5 = 0 THEN 80.0 WHEN score >= 0.3 THEN round(round(score, 3) * 100, 1) WHEN vec_id % 3 = 0 THEN 75.0 END AS confidence, CASE WHEN vec_id % 5 = 0 THEN 'fuzzy' WHEN score >= 0.3 THEN 'semantic' WHEN vec_id % 3 = 0 THEN 'external' END AS method FROM p)"
    " SELECT header, field, confidence::DOUBLE AS confidence, CASE WHEN old OR first THEN 'memory' ELSE method END AS method, method AS remembered_as, CASE WHEN old THEN 2 ELSE 1 END::INT AS hit_count, old AND vec_id % 35 = 0 AS user_corrected FROM a WHERE field IS NOT NULL"
)
def j08_resolved_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the columns, the same run again, then all of them: what the first run found the last one remembers."""
    e = table(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("col "), F.col("vec_id").cast("string"))
    columns = e.filter("vec_id >= 20").select("vec_id", name.alias("header"), F.col("embedding").alias("vector"))
    candidates = e.filter("vec_id < 20").select(F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("candidate"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    outside = columns.filter("vec_id % 3 = 0").select("header", F.lit("out").alias("field"))
    memory = _table(spark, mapping.MEMORY, "mapping_key", 8)
    old = columns.filter("vec_id % 5 = 0").select(F.concat(F.lit("guide|"), "header").alias("mapping_key"), F.lit("guide").alias("schema_name"), F.col("header").alias("source_column_raw"), F.col("header").alias("source_column_normalized"), F.lit("m").alias("resolved_field"), F.lit("fuzzy").alias("method"), F.lit(80.0).alias("confidence"), F.lit(2).alias("hit_count"), (F.col("vec_id") % 35 == 0).alias("user_corrected"))
    memory.upsert(old, [F.col("mapping_key")], "load")
    for run, some in (("1", "vec_id % 2 = 0"), ("1", "vec_id % 2 = 0"), ("2", "true")):
        found = mapping.resolve_columns(memory, columns.filter(some).drop("vec_id"), "guide", candidates, outside, run, 0.3)
    kept = memory.read().select(F.col("source_column_raw").alias("header"), F.col("method").alias("remembered_as"), "hit_count", "user_corrected")
    return found.join(kept, "header")


@query(
    "WITH e AS (SELECT *, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN [event_type] WHEN 1 THEN ['t' || (event_id % 5), event_type] ELSE [] END AS tags FROM events WHERE event_id % 10 < 9),"
    " g AS (SELECT user_id AS document_id, string_agg(event_type || ':' || event_id || '/' || (event_id % 2), ' > ' ORDER BY ts, event_id) AS history, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, CAST(count(*) AS INT) AS version, arg_max(event_type, (ts, event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at, max({'t': ts, 'i': event_id}).i AS last FROM e GROUP BY user_id)"
    " SELECT document_id, status, version, history, tags, CASE WHEN last % 6 = 0 THEN 'unknown' ELSE 'u' || (last % 6) END AS user_name, 'f' || last AS filename, created_at, updated_at FROM g"
)
def w05_lifecycle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of events, late ones after early ones and some twice, merged into the documents' records."""
    e = table(spark, sf_dir, "events").filter("event_id % 10 < 9")
    tags = F.when(F.col("event_id") % 3 == 0, F.array("event_type")).when(F.col("event_id") % 3 == 1, F.array(F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")), "event_type"))
    user = F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("u"), (F.col("event_id") % 6).cast("string")))
    log = e.select(F.col("user_id").alias("document_id"), "event_id", F.col("ts").alias("at"), F.col("event_type").alias("status"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"), F.lit("/"), (F.col("event_id") % 2).cast("string")).alias("parser_used"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("filename"), F.lit(0.5).alias("confidence_score"), user.alias("user"), tags.alias("tags"))
    states = lineage.lifecycle_states(log)
    store = KeyedTable(spark, shared_folder(spark), states.schema, ["document_id"], 16)
    for some in ("event_id % 10 >= 5", "event_id % 10 < 4", "event_id % 10 BETWEEN 3 AND 6"):
        store.merge(lineage.lifecycle_states(log.filter(some)), lineage.merged_states)
    r = lineage.lifecycle_records(store.read())
    history = F.array_join(F.transform("status_history", lambda x: x["parser_used"]), " > ")
    return r.select("document_id", "status", "version", history.alias("history"), F.array_join("tags", ",").alias("tags"), F.col("user").alias("user_name"), "filename", "created_at", "updated_at")
