"""Queries of the header mapping operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import standardize as S
from ledgerline.operators import mapping as M
from ledgerline.plans.registry import query
from ledgerline.plans.standardise import _QUALITY
from ledgerline.sources.fixtures import FIELDS_CTE, claims, fields, table

#: Target fields with a few aliases each; a deployment brings its own dictionary of them.
ALIASES = (
    ("Claim Number", "claim id"), ("Claim Number", "claim no"), ("Claimant Name", "claimant"), ("Loss Date", "date of loss"), ("Date Reported", "report date"), ("Total Incurred", "incurred"), ("Total Incurred", "gross incurred"),
    ("Total Paid", "amount paid"), ("Total Paid", "paid amount"), ("Status", "claim status"), ("Policy Number", "policy no"), ("Policy Number", "policy id"), ("State", "jurisdiction"),
)
ACCEPTED = tuple(dict.fromkeys(f for f, _ in ALIASES))
PHRASES = (("loss date", "Loss Date"), ("date of loss", "Loss Date"), ("claim", "Claim Number"), ("claim number", "Claim Number"), ("paid", "Total Paid"), ("standard", "Standard Kind"), ("brass", "Brass Part"), ("polished brass", "Brass Part"), ("economy", "Economy Kind"))


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "field string, alias string")


def _header() -> Column:
    """The claims' columns under other names, by sheet."""
    return F.when(F.col("sheet") == "s1", F.upper(F.replace("field", F.lit(" "), F.lit("_")))).when(F.col("sheet") == "s2", F.concat("field", F.lit(" Amt"))).otherwise(F.col("field"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, header, pos)"""
    return fields(spark, sf_dir).select("sheet", "field", "pos").distinct().select("sheet", _header().alias("header"), "pos")


_HEADER = "CASE sheet WHEN 's1' THEN upper(replace(field, ' ', '_')) WHEN 's2' THEN field || ' Amt' ELSE field END"
_COLUMNS = f"{FIELDS_CTE}, columns AS (SELECT DISTINCT sheet, {_HEADER} AS header, pos FROM fields)"
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower({0}), '[_/#+]', ' ', 'g')), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ('of', 'the', 'a', 'an', 'and', 'or', 'to', 'in', 'for')))"
_ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join(str(a) for a in ALIASES) + ") AS t(field, alias))"
_SCORED = (
    f"WITH {_COLUMNS}, {_ALIASES}, names AS (SELECT field, alias FROM aliases UNION SELECT field, lower(field) FROM aliases), h AS (SELECT DISTINCT header, trim(replace(lower(header), '_', ' ')) AS norm FROM columns),"
    f" p AS (SELECT header, norm, field, alias, {_TOKENS.format('norm')} AS a, {_TOKENS.format('alias')} AS b FROM h, names), s AS (SELECT header, field, max(CASE WHEN norm = alias AND (field, alias) IN (SELECT (field, alias) FROM aliases) THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END)::DOUBLE AS score FROM p GROUP BY ALL)"
)


@query(_SCORED + " SELECT header, field, score FROM s WHERE score > 0")
def j03_header_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.header_scores(_columns(spark, sf_dir).select("header").distinct(), _aliases(spark))


def _mapped(spark: SparkSession, sf_dir: str, outside: DataFrame | None = None) -> DataFrame:
    columns = _columns(spark, sf_dir)
    scores = M.header_scores(columns.select("header").distinct(), _aliases(spark))
    return M.greedy_mapping(columns.withColumnRenamed("sheet", "colset"), scores, ACCEPTED, outside=outside)


#: What a model named, say: a column that no header rule reaches, and one that is taken already.
OUTSIDE = (("State Amt", "State"), ("Total Paid", "Policy Number"))
_OUTSIDE_CAND = " UNION ALL SELECT c.sheet, a.i, c.header, c.pos, 0, 0.75::DOUBLE FROM columns c JOIN outside o ON o.header = c.header JOIN acc a ON a.field = o.field"
_GREEDY = (
    _SCORED.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", acc AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(ACCEPTED, 1)) + ") AS t(i, field)), outside AS (SELECT * FROM (VALUES " + ", ".join(str(o) for o in OUTSIDE) + ") AS t(header, field)),"
    " cand AS (SELECT c.sheet, a.i, c.header, c.pos, 1 AS own, s.score FROM columns c JOIN s ON s.header = c.header JOIN acc a ON a.field = s.field WHERE s.score >= 0.65" + _OUTSIDE_CAND + "),"
    " g AS (SELECT sheet, 0 AS i, []::VARCHAR[] AS used, NULL::VARCHAR AS header, NULL::DOUBLE AS score, NULL::INT AS own FROM (SELECT DISTINCT sheet FROM columns) UNION ALL"
    " SELECT sheet, i + 1, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.header) END, b.header, b.score, b.own FROM (SELECT g.sheet, g.i, g.used, max({'own': c.own, 'score': c.score, 'at': -c.pos, 'header': c.header}) FILTER (WHERE c.header IS NOT NULL) AS b"
    f" FROM g LEFT JOIN cand c ON c.sheet = g.sheet AND c.i = g.i + 1 AND (c.own = 0 OR NOT list_contains(g.used, c.header)) WHERE g.i < {len(ACCEPTED)} GROUP BY g.sheet, g.i, g.used)),"
    " m AS (SELECT g.sheet, a.field, g.header, g.score, CASE g.own WHEN 1 THEN 'header' ELSE 'outside' END AS source FROM g JOIN acc a ON a.i = g.i WHERE g.header IS NOT NULL)"
)


@query(_GREEDY + " SELECT sheet AS colset, field, header, score, source FROM m")
def j04_schema_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, spark.createDataFrame(OUTSIDE, "header string, field string"))


@query(
    _GREEDY + f", v AS (SELECT sheet, rec, {_HEADER} AS header, value FROM fields), t AS (SELECT sheet, min(value) AS value FROM fields WHERE field = 'Policy Number' GROUP BY sheet),"
    " r AS (SELECT v.sheet, v.rec, m.field, v.header, v.value, m.score, m.source FROM v JOIN m ON m.sheet = v.sheet AND m.header = v.header"
    " UNION ALL SELECT v.sheet, v.rec, f.field, '[title row 1]', t.value, 1.0, 'title' FROM (SELECT DISTINCT sheet, rec FROM v) v JOIN t ON t.sheet = v.sheet, (VALUES ('Status'), ('State')) AS f(field) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sheet = v.sheet AND m.field = f.field)),"
    f" q AS (SELECT *, CAST({_QUALITY} AS DOUBLE) AS quality FROM r)"
    " SELECT sheet, rec, field, header, value, CAST(round_even(score * 100, 0) AS INT) AS header_score, CAST(round_even(quality * 100, 0) AS INT) AS value_score, CAST(least(CASE source WHEN 'title' THEN 95 ELSE 100 END, round_even(score * 40 + quality * 60, 0)) AS INT) AS confidence, source FROM q"
)
def j04_mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells under their target fields; what no column gives comes from the sheet's title."""
    f = fields(spark, sf_dir)
    named = F.explode(F.array(F.lit("Status"), F.lit("State"), F.lit("Nothing"))).alias("field")
    titles = f.filter("field = 'Policy Number'").groupBy("sheet").agg(F.min("value").alias("value")).select("sheet", "value", F.lit(1).alias("row_no"), named)
    mapped = _mapped(spark, sf_dir, spark.createDataFrame(OUTSIDE, "header string, field string"))
    return M.mapped_records(f.select("sheet", "rec", _header().alias("header"), "value"), mapped, titles, ACCEPTED)


_CONFIDENCE = "CAST(round_even(score * 40 + quality * 60, 0) AS INT)"


@query(
    _GREEDY.replace(_OUTSIDE_CAND, "")
    + f", r AS (SELECT f.sheet, f.rec, m.field, f.value, m.score FROM (SELECT sheet, rec, {_HEADER} AS header, value FROM fields) f JOIN m ON m.sheet = f.sheet AND m.header = f.header), q AS (SELECT *, CAST({_QUALITY} AS DOUBLE) AS quality FROM r)"
    f" SELECT rec, CAST(round_even(sum({_CONFIDENCE}) / {len(ACCEPTED)}, 0) AS INT) AS confidence, count(*) AS mapped FROM q GROUP BY rec"
)
def a12_mapping_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average confidence of the mapped fields of each record, missing ones as 0."""
    named = _columns(spark, sf_dir).select("sheet", "header", "pos")
    values = fields(spark, sf_dir).join(named, ["sheet", "pos"]).select("sheet", "rec", "header", "value")
    mapped = _mapped(spark, sf_dir).select(F.col("colset").alias("sheet"), F.col("field").alias("target"), "header", "score")
    each = values.join(mapped, ["sheet", "header"])
    confidence = M.mapping_confidence(F.col("score"), S.value_quality(F.col("value"), F.col("target")))
    return each.groupBy("rec").agg(F.bround(F.sum(confidence) / len(ACCEPTED), 0).cast("int").alias("confidence"), F.count(F.lit(1)).alias("mapped"))


@query(_SCORED + " SELECT sheet, bool_or(best IS NULL OR best < 0.65) AS unknown FROM columns c LEFT JOIN (SELECT header, max(score) AS best FROM s GROUP BY ALL) b ON b.header = c.header GROUP BY sheet")
def f14_unknown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _columns(spark, sf_dir)
    best = M.header_scores(columns.select("header").distinct(), _aliases(spark)).groupBy("header").agg(F.max("score").alias("best"))
    return columns.join(best, "header", "left").groupBy("sheet").agg(F.bool_or(F.coalesce(F.col("best") < M.MIN_MATCH, F.lit(True))).alias("unknown"))


@query(
    "WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings), p AS (SELECT h.vec_id AS header, c.vec_id AS candidate, list_dot_product(h.u, c.u) AS score FROM u h, u c WHERE c.vec_id < 20 AND h.vec_id >= 20)"
    " SELECT header, CASE WHEN max(score) >= 0.75 THEN 'f' || arg_max(candidate, (score, -candidate)) END AS candidate, round(max(score), 3) AS score FROM p GROUP BY header"
)
def j07_embedding_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    candidates = e.filter("vec_id < 20").select(F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("candidate"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return M.embedding_match(e.filter("vec_id >= 20").select(F.col("vec_id").alias("header"), F.col("embedding").alias("vector")), candidates)


@query(_SCORED + ", one AS (SELECT DISTINCT p_type AS header FROM part), a AS (SELECT header, 'x' AS field, 100.0 AS confidence, 'memory' AS method FROM one WHERE header LIKE 'STANDARD%' UNION ALL SELECT header, 'y', 75.0, 'external' FROM one WHERE header LIKE '%BRASS' AND header NOT LIKE 'STANDARD%') SELECT header, field, confidence::DOUBLE AS confidence, method FROM a")
def j08_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "part").select(F.col("p_type").alias("header")).distinct()
    memory = columns.filter("header LIKE 'STANDARD%'").select("header", F.lit("x").alias("field"), F.lit(100.0).alias("confidence"))
    outside = columns.filter("header LIKE '%BRASS'").select("header", F.lit("y").alias("field"), F.lit(75.0).alias("confidence"))
    return M.cascade(columns, [("memory", memory), ("external", outside)])


_NAMED_HEADERS = "(SELECT p_type AS header FROM part UNION SELECT header FROM columns)"
_CAMEL = "regexp_replace(regexp_replace(header, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
_STANDARD = (
    f"WITH {_COLUMNS}, phrases AS (SELECT * FROM (VALUES " + ", ".join(str(p) for p in PHRASES) + f") AS t(phrase, standard)), w AS (SELECT header, list_filter(string_split(lower(regexp_replace({_CAMEL}, '[^a-zA-Z]+', ' ', 'g')), ' '), lambda w: len(w) > 1) AS w FROM {{headers}}),"
    " runs AS (SELECT header, n, i, array_to_string(w[i + 1:i + n], ' ') AS phrase FROM w, range(1, 5) AS a(n), range(0, 30) AS b(i) WHERE i + n <= len(w)),"
    " best AS (SELECT header, standard, max(10 * n - i) AS score, min(i + 100 * n) AS at_place FROM runs JOIN phrases USING (phrase) GROUP BY ALL),"
    " std AS (SELECT header, standard, CAST(score AS INT) AS score FROM best QUALIFY row_number() OVER (PARTITION BY header ORDER BY score DESC, at_place) = 1)"
)


@query(_STANDARD.format(headers=_NAMED_HEADERS) + " SELECT * FROM std WHERE score >= 8")
def p12_standard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = table(spark, sf_dir, "part").select(F.col("p_type").alias("header")).union(_columns(spark, sf_dir).select("header")).distinct()
    return M.standard_names(headers, spark.createDataFrame(PHRASES, "phrase string, standard string"))


@query(
    _STANDARD.format(headers="(SELECT DISTINCT header FROM columns)")
    + ", f AS (SELECT c.sheet, c.header, s.standard AS name FROM columns c JOIN std s ON s.header = c.header WHERE s.score >= 8 QUALIFY row_number() OVER (PARTITION BY c.sheet, s.standard ORDER BY pos) = 1)"
    " SELECT * FROM f UNION ALL SELECT sheet, header, 'State Code' FROM columns c WHERE header IN ('State', 'STATE') AND NOT EXISTS (SELECT 1 FROM f WHERE f.sheet = c.sheet AND (f.header = c.header OR f.name = 'State Code')) QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY pos) = 1"
)
def p13_renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _columns(spark, sf_dir)
    standards = M.standard_names(columns.select("header").distinct(), spark.createDataFrame(PHRASES, "phrase string, standard string"))
    return M.rename_columns(columns, standards, spark.createDataFrame([("State", "State Code"), ("STATE", "State Code")], "header string, field string"))


@query(f"WITH {FIELDS_CTE} SELECT DISTINCT status, upper(status) AS label, CAST(NULL AS VARCHAR) AS error FROM claims")
def u02_model_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local stand-in for a model on the distinct statuses."""
    rows = claims(spark, sf_dir).select("status")
    return M.call_model(rows, "status", lambda b: b.assign(label=b.status.str.upper()), "label string")
