"""Claims derived from the star schema, by SQL that other engines read as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMS_SQL = """
SELECT concat('CLM-', lpad(CAST(o.o_orderkey AS STRING), 7, '0')) AS claim_id, o.o_orderkey AS rec,
 c.c_name AS claimant_name, concat('POL-', CAST(c.c_custkey AS STRING)) AS policy_number,
 CASE o.o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'Completed' ELSE 'on hold' END AS status,
 CASE CAST(c.c_custkey % 4 AS INT) WHEN 0 THEN 'california' WHEN 1 THEN 'TX' WHEN 2 THEN 'ny' ELSE 'Ontario' END AS state,
 CASE CAST(o.o_orderkey % 3 AS INT)
  WHEN 0 THEN concat(CAST(year(o.o_orderdate) AS STRING),'-',lpad(CAST(month(o.o_orderdate) AS STRING),2,'0'),'-',lpad(CAST(day(o.o_orderdate) AS STRING),2,'0'))
  WHEN 1 THEN concat(CAST(month(o.o_orderdate) AS STRING),'/',CAST(day(o.o_orderdate) AS STRING),'/',CAST(year(o.o_orderdate) AS STRING))
  ELSE 'pending' END AS loss_date,
 CAST(CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 20 - 3 AS INT) AS STRING) AS date_reported,
 CASE WHEN o.o_orderkey % 17 = 0 THEN concat('($', CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS STRING), ')')
      ELSE concat('$', CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS STRING)) END AS total_incurred,
 coalesce(CAST(p.paid AS STRING), '') AS total_paid
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS paid
           FROM {lineitem} GROUP BY l_orderkey) p ON p.l_orderkey = o.o_orderkey
"""
#: Field name, column of the claims, position of the column in its sheet.
FIELDS = (
    ("Claim Number", "claim_id", 1), ("Claimant Name", "claimant_name", 2), ("Policy Number", "policy_number", 3), ("Status", "status", 4), ("State", "state", 5),
    ("Loss Date", "loss_date", 6), ("Date Reported", "date_reported", 7), ("Total Incurred", "total_incurred", 8), ("Total Paid", "total_paid", 9),
)
COST_LOG_SQL = """
SELECT concat('doc-', CAST(l_suppkey AS STRING)) AS doc_name,
 CASE l_returnflag WHEN 'A' THEN 'entities' WHEN 'N' THEN 'signals' ELSE 'summary_judge' END AS task,
 CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-5.4-mini' ELSE 'local-x' END AS model,
 CAST(l_quantity * 100 AS INT) AS prompt_tokens, CAST(l_quantity AS INT) AS completion_tokens
FROM {lineitem}
"""
NAMES = {n: n for n in ("orders", "customer", "lineitem")}
#: The same as common table expressions.
CLAIMS_CTE = f"claims AS ({CLAIMS_SQL.format(**NAMES)})"
FIELDS_CTE = CLAIMS_CTE + ", fields AS (" + " UNION ALL ".join(f"SELECT concat('s', CAST(rec % 4 AS STRING)) AS sheet, rec, claim_id, {p} AS pos, '{f}' AS field, {c} AS value FROM claims" for f, c, p in FIELDS) + ")"
COST_CTE = f"cost_log AS ({COST_LOG_SQL.format(**NAMES)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in NAMES if f"{{{n}}}" in sql})


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CLAIMS_SQL)


def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, COST_LOG_SQL)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: a row for each field of each claim, in four sheets."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(f).alias("field"), F.col(c).alias("value")) for f, c, p in FIELDS))).alias("f")
    sheet = F.concat(F.lit("s"), (F.col("rec") % 4).cast("string")).alias("sheet")
    return claims(spark, sf_dir).select(sheet, "rec", "claim_id", each).select("sheet", "rec", "claim_id", "f.*")


def claims_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later load of every other claim with some values changed."""
    closed, blanked = F.when(F.col("rec") % 10 == 0, "closed").otherwise(F.col("status")), F.when(F.col("rec") % 7 == 0, "").otherwise(F.col("total_paid"))
    return claims(spark, sf_dir).filter("rec % 2 = 0").withColumns({"status": closed, "total_paid": blanked})
