"""Queries of the layout and grounding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import grid as grids
from ledgerline.operators import layout as L
from ledgerline.plans.grids import _G, _grid
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import CLAIMS_CTE, claims, table


@query(f"WITH {CLAIMS_CTE}, c AS (SELECT policy_number AS sheet, rec AS row_no, unnest([0, 1, 2, 3, 4]) AS pos, unnest([concat(rec, ' Main road'), 'Springfield, IL 62701', 'Water damage', 'Jane Doe', 'Tropical Storm']) AS value, unnest(['Address', 'City State Zip', 'Cause of Loss', 'Claimant Name', 'Cause of Loss_2']) AS field FROM claims) SELECT * FROM c")
def x07_subrow_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.concat(F.col("rec").cast("string"), F.lit(" Main road")), F.lit("Springfield, IL 62701"), F.lit("Water damage"), F.lit("Jane Doe"), F.lit("Tropical Storm"))
    return L.subrow_fields(claims(spark, sf_dir).select(F.col("policy_number").alias("sheet"), F.col("rec").alias("row_no"), cells.alias("cells")))


@query("SELECT CASE WHEN l_linenumber <= 3 AND l_quantity >= 30 THEN 'TITLE' WHEN l_quantity >= 20 AND l_tax < 0.04 THEN 'HEADER' ELSE 'DATA' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL")
def x11_region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols, rows = F.floor(F.col("l_quantity") / 10), F.when(F.col("l_tax") < 0.04, 1).otherwise(2)
    kind = L.region_kind(F.col("l_linenumber"), cols, rows)
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(_G + " SELECT sheet, 'Paid' AS field, CAST(1 AS DECIMAL(28,2)) AS total FROM s")
def x12_explicit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir)
    wide = grid.withColumn("cells", F.when(F.col("cells")[0] == "Subtotal open", F.array(F.lit("Subtotal open"), *(F.lit("") for _ in range(5)), F.lit("$1"))).otherwise(F.col("cells")))
    return L.explicit_totals(wide, grids.header_rows(grid))


@query(f"WITH {CLAIMS_CTE} SELECT rec AS doc_id, 1 AS block, 'Claim No' AS label, claim_id AS value FROM claims UNION ALL SELECT rec, 2, 'Insured', claimant_name || ' second line' FROM claims UNION ALL SELECT rec, 3, 'State', state FROM claims")
def x15_label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array(F.lit("a heading"), F.concat(F.lit("Claim No: "), "claim_id"), F.lit("Insured:"), F.col("claimant_name"), F.lit("second line"), F.lit(""), F.concat(F.lit("State: "), "state"))
    return L.label_blocks(claims(spark, sf_dir).select(F.col("rec").alias("doc_id"), F.posexplode(text).alias("no", "line")))


@query(f"WITH {CLAIMS_CTE} SELECT rec AS doc_id, 'Loss Date' AS name, loss_date || CASE WHEN rec % 2 = 0 THEN ' 10:30 am' ELSE '' END AS value FROM claims WHERE rec % 5 <> 0 UNION ALL SELECT rec, 'Status', 'anything' FROM claims")
def f16_verbatim_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    docs = c.select(F.col("rec").alias("doc_id"), F.when(F.col("rec") % 5 == 0, "nothing here").otherwise(F.concat(F.lit("On "), "loss_date", F.lit("."))).alias("text"))
    dated = c.select(F.col("rec").alias("doc_id"), F.lit("Loss Date").alias("name"), F.concat("loss_date", F.when(F.col("rec") % 2 == 0, " 10:30 am").otherwise("")).alias("value"))
    return L.verbatim_dates(dated.union(c.select("rec", F.lit("Status"), F.lit("anything"))), docs)


@query("SELECT doc_id, 'tone' AS type, 'zzqq' AS keyword, CASE WHEN contains(lower(text), 'the') THEN 0.9 ELSE 0.45 END::DOUBLE AS confidence, contains(lower(text), 'the') AS verified FROM documents")
def j18_grounded_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    signals = docs.select("doc_id", F.lit("tone").alias("type"), F.lit("zzqq").alias("keyword"), F.lit("").alias("description"), F.lit("").alias("snippet"), F.lit(0.9).alias("confidence"))
    return L.grounded_signals(signals, docs, {"tone": ("the",)})


@query("SELECT user_id AS doc_id, 1 AS page, event_type AS name, 'text' AS value, CASE WHEN max(event_id % 2) = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM events WHERE event_type <> 'view' GROUP BY ALL UNION ALL SELECT user_id, 1, 'View:', 'ocr', 0.7 FROM events WHERE event_type = 'view' AND event_id % 2 = 1 GROUP BY ALL")
def j24_ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.col("event_type").alias("name"), "event_id")
    text = e.filter("name <> 'view'").select("doc_id", "page", "name").distinct().select("*", F.lit("text").alias("value"), F.lit(0.5).alias("confidence"))
    ocr = e.filter("event_id % 2 = 1").select("doc_id", "page", F.concat(F.initcap("name"), F.lit(":")).alias("name")).distinct().select("*", F.lit("ocr").alias("value"), F.lit(0.7).alias("confidence"))
    return L.merge_ocr(text, ocr)


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'credential' WHEN contains(lower(text), 'und ') THEN 'german' ELSE 'general' END AS kind FROM documents")
def j20_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.taxonomy(F.col("text"), (("credential", ("token",)), ("german", ("und ",))), "general").alias("kind"))
