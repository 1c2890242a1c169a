"""Queries of the grid and export operators, over a sheet for each customer's claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import export, grid, records
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import CLAIMS_CTE, FIELDS_CTE, claims, fields

_HEAD = ("Claim No", "Claimant", "Policy", "Status", "Loss Date", "Incurred", "Paid")
_COLS = ("claim_id", "claimant_name", "policy_number", "status", "loss_date", "total_incurred", "total_paid")
_G = (
    f"WITH {CLAIMS_CTE}, n AS (SELECT policy_number AS sheet, row_number() OVER (PARTITION BY policy_number ORDER BY rec) AS r, count(*) OVER (PARTITION BY policy_number) AS k, [{', '.join(_COLS)}] AS cells FROM claims),"
    f" s AS (SELECT DISTINCT sheet, k FROM n), grid AS (SELECT sheet, 1 AS row_no, ['Report date 2024-01-01'] AS cells FROM s UNION ALL SELECT sheet, 2, {list(_HEAD)} FROM s UNION ALL SELECT sheet, r + 2, cells FROM n UNION ALL SELECT sheet, k + 3, ['Subtotal open', '', '1'] FROM s UNION ALL SELECT sheet, k + 4, ['', ' Total ', '9'] FROM s UNION ALL SELECT sheet, k + 5, ['after', 'the', 'end'] FROM s)"
)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("policy_number")
    n = claims(spark, sf_dir).select(F.col("policy_number").alias("sheet"), F.row_number().over(own.orderBy("rec")).alias("r"), F.count(F.lit(1)).over(own).alias("k"), F.array(*_COLS).alias("cells"))
    lit = lambda *c: F.array(*(F.lit(x) for x in c))
    s = n.groupBy("sheet").agg(F.max("k").alias("k"))
    row = lambda at, cells: F.struct(at.cast("long").alias("row_no"), cells.alias("cells"))
    k = F.col("k")
    around = (row(F.lit(1), lit("Report date 2024-01-01")), row(F.lit(2), lit(*_HEAD)), row(k + 3, lit("Subtotal open", "", "1")), row(k + 4, lit("", " Total ", "9")), row(k + 5, lit("after", "the", "end")))
    rows = F.explode(F.array(*around)).alias("x")
    return n.select("sheet", (F.col("r") + 2).cast("long").alias("row_no"), "cells").union(s.select("sheet", rows).select("sheet", "x.row_no", "x.cells"))


@query(_G + " SELECT sheet, 'LOSS_RUN' AS kind, 0.70::DOUBLE AS confidence FROM s")
def x01_sheet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.classify_sheets(_grid(spark, sf_dir))


@query(_G + " SELECT sheet, 2 AS header_row FROM s")
def x02_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.header_rows(_grid(spark, sf_dir))


@query("SELECT DISTINCT c_mktsegment, ['LOSS', 'Loss Paid', 'Paid', 'Paid_2', c_mktsegment] AS headers FROM customer")
def x04_merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.sources.fixtures import table

    one = F.array(F.lit("Loss"), F.lit("Loss"), F.lit(""), F.lit("Paid"), F.lit(""))
    two = F.array(F.lit("LOSS"), F.lit("Paid"), F.lit("Paid"), F.lit("Paid"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_mktsegment").distinct().select("c_mktsegment", grid.merged_headers(one, two).alias("headers"))


@query(_G + ", h AS (SELECT unnest(range(1, 8)) AS pos, unnest(" + str(list(_HEAD)) + ") AS field) SELECT n.sheet, n.r + 2 AS row_no, h.pos, h.field, trim(n.cells[h.pos]) AS value FROM n, h")
def x05_grid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_records(_grid(spark, sf_dir))


@query(_G + ' SELECT sheet, count(*) AS "rows", max(len(cells)) AS "columns" FROM grid GROUP BY sheet')
def x13_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dimensions(_grid(spark, sf_dir))


@query(_G + " SELECT sheet, r + 2 AS row_no FROM n")
def f04_stop_at_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.body_rows(_grid(spark, sf_dir)).select("sheet", "row_no")


@query(_G + " SELECT sheet, row_no FROM grid WHERE row_no = 1 OR cells[1] = 'Subtotal open' OR regexp_matches(lower(cells[1]), '^report')")
def f03_aggregate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).filter(grid.is_aggregate(F.col("cells")) & (F.col("cells")[0] != "")).select("sheet", "row_no")


_SUB = f"WITH {CLAIMS_CTE}, m AS (SELECT policy_number AS sheet, rec AS row_no, CASE rec % 4 WHEN 0 THEN 'main' WHEN 3 THEN 'close' ELSE 'sub' END AS kind FROM claims), o AS (SELECT *, last_value(CASE kind WHEN 'main' THEN row_no WHEN 'close' THEN 0 END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS owner FROM m)"


@query(_SUB + " SELECT sheet, row_no, kind, owner FROM o WHERE kind <> 'close' AND owner > 0")
def x06_subrow_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rec") % 4
    kind = F.when(r == 0, "main").when(r == 3, "close").otherwise("sub")
    return grid.attach_subrows(claims(spark, sf_dir).select(F.col("policy_number").alias("sheet"), F.col("rec").alias("row_no"), kind.alias("kind")))


@query(f"WITH {FIELDS_CTE} SELECT sheet, rec AS row_no, field, CASE WHEN field = 'Total Paid' AND value = '' THEN 'sub' ELSE value END AS value FROM fields WHERE field IN ('Total Paid', 'Status') UNION ALL SELECT DISTINCT sheet, rec, 'Peril', 'fire' FROM fields")
def x08_fill_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir).withColumnRenamed("rec", "row_no").filter("field IN ('Total Paid', 'Status')").select("sheet", "row_no", "field", "value")
    each = f.select("sheet", "row_no").distinct()
    sub = each.select("sheet", "row_no", F.lit("Total Paid").alias("field"), F.lit("sub").alias("value")).union(each.select("sheet", "row_no", F.lit("Peril"), F.lit("fire")))
    return grid.fill_if_empty(f, sub)


def _object(condition: str = "true") -> str:
    """SQL for the JSON object of a record's fields in column order."""
    return """'{' || coalesce(string_agg('"' || field || '":"' || value || '"', ',' ORDER BY pos) FILTER (""" + condition + """), '') || '}'"""


_FILLED = f"WITH {FIELDS_CTE} SELECT sheet, rec, " + """'{"claim_id":"' || claim_id || '","fields":' || """
_BY_RECORD = " AS document FROM fields WHERE trim(value) <> '' GROUP BY sheet, rec, claim_id"


@query(_FILLED + _object() + " || '}'" + _BY_RECORD)
def a19_standard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.standard_documents(fields(spark, sf_dir))


@query(_FILLED + _object("field NOT LIKE 'Total%'") + """ || ',"financials":' || """ + _object("field LIKE 'Total%'") + """ || ',"currency":"USD"}'""" + _BY_RECORD)
def a19_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.split_documents(fields(spark, sf_dir), ("Total Incurred", "Total Paid"))


_EDITED = "(field = 'Status' AND rec % 5 = 0)"


@query(
    f"WITH {FIELDS_CTE}, e AS (SELECT sheet, rec, pos, field, CASE WHEN {_EDITED} THEN 'closed' ELSE value END AS value, CASE WHEN {_EDITED} THEN value END AS original FROM fields) SELECT sheet, rec, "
    + """'{"transactionType":"UPDATE","claim":{' || string_agg('"' || field || '":{"value":"' || value || '","edited":' || CASE WHEN original IS NULL THEN 'false' ELSE 'true,"originalValue":"' || original || '"' END || '}', ',' ORDER BY pos) || '}}'"""
    + " AS document FROM e WHERE trim(value) <> '' GROUP BY sheet, rec"
)
def a19_transaction_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = (F.col("field") == "Status") & (F.col("rec") % 5 == 0)
    f = fields(spark, sf_dir).withColumns({"original": F.when(edited, F.col("value")), "value": F.when(edited, "closed").otherwise(F.col("value"))})
    return export.transaction_documents(f)


@query(f"WITH {FIELDS_CTE}, t AS (SELECT sheet, sum(CAST(value AS DECIMAL(18,2))) AS total FROM fields WHERE field = 'Total Paid' AND value <> '' GROUP BY sheet) SELECT f.sheet, count(DISTINCT rec) AS record_count, " + """'{"Total Paid":"' || max(total) || '"}'""" + " AS totals FROM fields f JOIN t USING (sheet) GROUP BY f.sheet")
def a19_sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    return export.sheet_summary(f, records.column_totals(f.filter("field = 'Total Paid'")))


@query(f"WITH {CLAIMS_CTE} SELECT rec, to_json(map_from_entries(list_filter([('Insured', claimant_name), ('Paid', total_paid)], lambda e: trim(e[2]) <> '') || [('Policy', policy_number)])) AS metadata FROM claims")
def a20_sheet_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = F.create_map(F.lit("Insured"), F.lit("other"), F.lit("Policy"), F.col("policy_number"))
    return claims(spark, sf_dir).select("rec", F.to_json(export.sheet_metadata({"Insured": F.col("claimant_name"), "Paid": F.col("total_paid")}, regions)).alias("metadata"))
