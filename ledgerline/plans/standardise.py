"""Queries of the field standardisers, over the claims in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import standardize as S
from ledgerline.operators import records
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import CLAIMS_CTE, COST_CTE, FIELDS_CTE, claims, cost_log, fields, table

STATUSES = ("open", "closed", "pending", "reopened", "denied", "submitted", "draft")
_C, _F = f"WITH {CLAIMS_CTE} ", f"WITH {FIELDS_CTE} "
_PUNCT = "translate({0}, '" + S.PUNCTUATION_FROM + "', '" + S.PUNCTUATION_TO.replace("'", "''") + "')"
_FORMATS = "['%Y-%m-%d','%m/%d/%Y','%m-%d-%Y','%d/%m/%Y','%d-%m-%Y','%m/%d/%y','%m-%d-%y','%d/%m/%y','%Y/%m/%d','%B %d, %Y','%b %d, %Y','%B %d %Y','%b %d %Y','%d %B %Y','%d %b %Y']"
_ORDER = "['%m/%d/%Y','%d/%m/%Y','%Y-%m-%d','%d-%m-%Y','%m-%d-%Y','%d.%m.%Y','%Y/%m/%d','%B %d, %Y','%b %d, %Y']"
_BARE = "trim(regexp_replace(trim({0}), '[$,()]', '', 'g'))"
_AMOUNT = f"coalesce(CAST(CASE WHEN regexp_full_match({_BARE}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CASE WHEN trim({{0}}) LIKE '(%)' THEN -abs(CAST({_BARE} AS DECIMAL(18,2))) ELSE CAST({_BARE} AS DECIMAL(18,2)) END END AS STRING), {{0}})"
_STATUS = "CASE lower(trim({0})) WHEN 'active' THEN 'open' WHEN 'completed' THEN 'closed' WHEN 'on hold' THEN 'pending' ELSE {0} END"
_STATE = "CASE WHEN length(trim({0})) = 2 THEN upper(trim({0})) WHEN lower(trim({0})) = 'california' THEN 'CA' ELSE trim({0}) END"
_NAME = "CASE WHEN trim({0}) = '' THEN {0} ELSE array_to_string(list_transform(regexp_split_to_array(trim({0}), '\\s+'), lambda w: CASE WHEN lower(w) IN ('llc','inc','lp','llp','na','n/a','dba','usa','us','uk','ltd','corp','co') THEN upper(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') END"
_DATE = "coalesce(strftime(try_strptime({0}, " + _FORMATS + "), '%Y-%m-%d'), {0})"
_STANDARD = (
    "CASE WHEN trim(value) = '' THEN value WHEN field IN ('Loss Date', 'Date Reported') THEN " + _DATE.format("value") + " WHEN field IN ('Total Incurred', 'Total Paid') THEN " + _AMOUNT.format("value")
    + " WHEN field = 'Status' THEN " + _STATUS.format("value") + " WHEN field = 'Claimant Name' THEN " + _NAME.format("value") + " WHEN field = 'State' THEN " + _STATE.format("value") + " ELSE trim(value) END"
)


@query(_C + "SELECT claim_id, " + _PUNCT.format("concat('“', claimant_name, '” – it’s')") + " AS folded FROM claims")
def p01_fold_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", S.fold_punctuation(F.concat(F.lit("“"), "claimant_name", F.lit("” – it’s"))).alias("folded"))


@query(_C + f"SELECT claim_id, CAST(try_strptime(loss_date, {_FORMATS}) AS DATE) AS loss, CAST(try_strptime(date_reported, {_FORMATS}) AS DATE) AS reported FROM claims")
def p02_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", S.parse_date(F.col("loss_date")).alias("loss"), S.parse_date(F.col("date_reported")).alias("reported"))


@query(_C + f"SELECT claim_id, CAST(try_strptime(loss_date, {_ORDER}) AS DATE) AS loss FROM claims")
def p03_parse_order_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", S.parse_order_date(F.col("loss_date")).alias("loss"))


@query(_C + f"SELECT claim_id, coalesce(strftime(try_strptime(loss_date, {_FORMATS}), '%Y-%m-%d'), loss_date) AS iso, coalesce(strftime(try_strptime(loss_date, {_FORMATS}), '%m/%d/%Y'), loss_date) AS us FROM claims")
def p04_schema_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", S.schema_date(F.col("loss_date")).alias("iso"), S.schema_date(F.col("loss_date"), S.SCHEMA_DATE_PATTERNS["MM/DD/YYYY"]).alias("us"))


@query(_C + "SELECT claim_id, " + _AMOUNT.format("total_incurred") + " AS incurred, " + _AMOUNT.format("total_paid") + " AS paid FROM claims")
def p05_schema_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", S.schema_amount(F.col("total_incurred")).alias("incurred"), S.schema_amount(F.col("total_paid")).alias("paid"))


@query(_C + "SELECT claim_id, " + _STATUS.format("status") + " AS status FROM claims")
def p06_schema_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", S.schema_status(F.col("status"), STATUSES).alias("status"))


@query(_C + "SELECT claim_id, " + _NAME.format("concat(claimant_name, '  llc mcDONALD')") + " AS name FROM claims")
def p07_schema_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", S.schema_name(F.concat("claimant_name", F.lit("  llc mcDONALD"))).alias("name"))


@query(_C + "SELECT claim_id, " + _STATE.format("state") + " AS state FROM claims")
def p08_schema_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", S.schema_state(F.col("state")).alias("state"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'false' ELSE l_returnflag END AS flag FROM lineitem")
def p09_schema_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.schema_boolean(F.col("l_returnflag")).alias("flag"))


@query(_F + f"SELECT sheet, rec, field, {_STANDARD} AS value FROM fields")
def p10_standard_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("sheet", "rec", "field", S.standard_value(F.col("field"), F.col("value"), STATUSES).alias("value"))


@query(_F + f", std AS (SELECT *, {_STANDARD} AS new_value FROM fields) SELECT sheet, rec, field, value, new_value FROM std s WHERE new_value <> value AND value <> '' AND NOT EXISTS (SELECT 1 FROM fields e WHERE e.rec = s.rec AND e.field = s.field AND e.rec % 11 = 0 AND e.field = 'Status')")
def p11_standard_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    edits = f.filter("rec % 11 = 0 AND field = 'Status'").select("rec", "field")
    return records.standard_changes(f, edits, STATUSES).select("sheet", "rec", "field", "value", "new_value")


@query(_F + "SELECT DISTINCT field, regexp_replace(regexp_replace(lower(trim(concat('  ', replace(field, ' ', '__-'), ' Amt'))), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g') AS header FROM fields")
def p14_normal_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.replace("field", F.lit(" "), F.lit("__-")), F.lit(" Amt"))
    return fields(spark, sf_dir).select("field").distinct().select("field", S.normal_header(raw).alias("header"))


@query(_F + "SELECT rec, field, coalesce(nullif(CASE WHEN rec % 5 = 0 THEN concat(value, '*') WHEN rec % 5 = 1 THEN '' END, ''), value) AS value FROM fields")
def p18_effective_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    modified = F.when(F.col("rec") % 5 == 0, F.concat("value", F.lit("*"))).when(F.col("rec") % 5 == 1, "")
    return fields(spark, sf_dir).select("rec", "field", S.effective(modified, F.col("value")).alias("value"))


@query(_F + "SELECT rec, field, CASE WHEN field = 'Claimant Name' THEN CASE WHEN length(value) <= 2 THEN repeat('*', length(value)) ELSE concat(repeat('*', length(value) - 2), right(value, 2)) END ELSE value END AS value FROM fields")
def p19_redacted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("rec", "field", S.redacted(F.col("field"), F.col("value")).alias("value"))


@query(_F + "SELECT sheet, sha256(string_agg(trim(value) || chr(1), '' ORDER BY trim(value))) AS sheet_hash FROM (SELECT DISTINCT sheet, value FROM fields WHERE trim(value) <> '' AND field = 'State') GROUP BY sheet")
def p20_sheet_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.stores import sheet_hash

    values = fields(spark, sf_dir).filter("trim(value) <> '' AND field = 'State'").select("sheet", "value").distinct()
    return sheet_hash(values, "sheet", "value", "\x01")


@query("SELECT doc_id, left(sha256(concat(trim(text), '|', lang)), 16) AS text_key, sha256(text) AS content_hash FROM documents")
def p21_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.text_key(F.col("text"), F.col("lang")).alias("text_key"), F.sha2("text", 256).alias("content_hash"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 'auto_process' ELSE 'manual_review' END AS route FROM lineitem")
def p26_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.route(F.col("l_discount"), 0.05).alias("route"))


_QUALITY = (
    "CASE WHEN trim(value) = '' THEN 0.0 WHEN field LIKE '%Date%' THEN CASE WHEN regexp_full_match(trim(value), '[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}') THEN 1.0 ELSE 0.4 END"
    " WHEN field IN ('Total Incurred', 'Total Paid') THEN CASE WHEN regexp_full_match(replace(regexp_replace(trim(value), '[,$)]', '', 'g'), '(', '-'), '[+-]?[0-9]+\\.?[0-9]*') THEN 1.0 ELSE 0.3 END"
    " WHEN field IN ('Claim Number', 'Policy Number') THEN 0.9 WHEN field = 'Status' THEN 0.7 ELSE 0.85 END"
)


@query(_F + f"SELECT rec, field, CAST({_QUALITY} AS DOUBLE) AS quality FROM fields")
def p27_value_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("rec", "field", S.value_quality(F.col("value"), F.col("field")).cast("double").alias("quality"))


#: Price a thousand tokens of models by the first pattern that their name holds, in this order; the last is the default.
PRICES = (("gpt-5.4", 0.0025, 0.01), ("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4o", 0.0025, 0.01), ("", 0.00015, 0.0006))
_PRICE = lambda k: "CASE " + " ".join(f"WHEN contains(model, '{p[0]}') THEN {p[k]}" for p in PRICES[:-1]) + f" ELSE {PRICES[-1][k]} END"
COST_SQL = f"round(CAST(prompt_tokens / 1000.0 * ({_PRICE(1)}) + completion_tokens / 1000.0 * ({_PRICE(2)}) AS DOUBLE), 9)"


@query(f"WITH {COST_CTE} SELECT doc_name, task, model, prompt_tokens, completion_tokens, {COST_SQL} AS cost FROM cost_log")
def p28_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.lineage import token_cost

    return token_cost(cost_log(spark, sf_dir), PRICES)


@query(_F + "SELECT DISTINCT field, field IN ('Total Incurred', 'Total Paid') AS financial FROM fields")
def f05_financial_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("field").distinct().select("field", S.is_financial(F.col("field")).alias("financial"))


@query(_F + "SELECT DISTINCT sheet, rec FROM fields WHERE contains(lower(value), 'pol-12')")
def f07_record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.records import search_records

    f = fields(spark, sf_dir)
    return search_records(f, "POL-12").select("sheet", "rec").distinct()


@query(_F + "SELECT sheet, field FROM fields GROUP BY sheet, field HAVING bool_and(trim(CASE WHEN sheet = 's1' THEN '' ELSE value END) = '')")
def f08_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.records import empty_columns

    return empty_columns(fields(spark, sf_dir).withColumn("value", F.when(F.col("sheet") == "s1", "").otherwise(F.col("value"))))


@query(_C + f"SELECT claim_id, coalesce(year(try_strptime(loss_date, {_ORDER})) BETWEEN 1900 AND 2100, false) AS valid FROM claims")
def f09_valid_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", F.coalesce(F.year(S.parse_order_date(F.col("loss_date"))).between(1900, 2100), F.lit(False)).alias("valid"))


@query(_F + "SELECT rec, field, value FROM fields WHERE lower(trim(value)) NOT IN ('', 'not found', 'n/a', 'na', 'none', 'null', 'unknown', 'pending', '-', '—')")
def f11_no_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.records import PLACEHOLDERS, without_placeholders

    return without_placeholders(fields(spark, sf_dir), (*PLACEHOLDERS, "pending")).select("rec", "field", "value")
