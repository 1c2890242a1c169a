"""Queries of the review, legacy layout, banner, table and typed-signal operators.

Rows are made from the claims so that every branch of a rule is met; the SQL states what each kind of row must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import documents, grid, layout, review, snapshots
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import CLAIMS_CTE, FIELDS_CTE, claims, claims_again, fields, table

_C, _F = f"WITH {CLAIMS_CTE} ", f"WITH {FIELDS_CTE} "


def _picked(rows: tuple[tuple, ...], n: int) -> Column:
    """The first ``n`` columns of one of the literal rows by the claim's number."""
    at = (F.col("rec") % len(rows)).cast("int")
    return F.get(F.array(*(F.struct(*(F.lit(x).cast("string").alias(f"c{k}") for k, x in enumerate(r[:n]))) for r in rows)), at)


def _values(rows: tuple[tuple, ...], names: str) -> str:
    lit = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    return f"(VALUES {', '.join(f'({i}, ' + ', '.join(map(lit, r)) + ')' for i, r in enumerate(rows))}) AS t(i, {names})"


@query(
    _F + "SELECT rec, field, value, CASE WHEN rec % 5 = 0 THEN 'edited' ELSE value END AS modified, CASE WHEN rec % 3 = 2 THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN rec % 2 = 0 THEN 'excel' ELSE 'pdf' END AS source_type,"
    " CAST(pos AS VARCHAR) AS ref_pos, CASE WHEN rec % 2 = 1 THEN 'pdf' END AS ref_source FROM fields"
)
def p17_canonical_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fields(spark, sf_dir).withColumns({"modified": F.when(F.col("rec") % 5 == 0, "edited"), "confidence": F.when(F.col("rec") % 3 == 1, "high").when(F.col("rec") % 3 == 2, "0.75"), "source_type": F.when(F.col("rec") % 2 == 1, "pdf")})
    out = review.canonical_fields(raw, "excel")
    return out.select("rec", "field", *review.CANONICAL, F.try_element_at("source_ref", F.lit("pos")).alias("ref_pos"), F.try_element_at("source_ref", F.lit("source_type")).alias("ref_source"))


_BIT = "(rec // {0}) % 2 = 1"
_LABEL = (
    f"CASE WHEN rec % 11 = 0 THEN 'manual' WHEN rec % 13 = 0 THEN 'text' WHEN {_BIT.format(1)} AND NOT {_BIT.format(2)} THEN CASE WHEN {_BIT.format(4)} AND rec % 3 = 0 THEN 'ocr confidence and place' WHEN {_BIT.format(4)} THEN 'ocr place'"
    f" WHEN {_BIT.format(8)} THEN 'text layer place' ELSE 'model' END WHEN {_BIT.format(1)} THEN 'model fallback' WHEN {_BIT.format(4)} THEN 'ocr' ELSE 'ocr raw' END"
)


@query(_C + f"SELECT rec, {_LABEL} AS label FROM claims")
def p30_source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("rec")
    bit = lambda k: F.floor(c / k) % 2 == 1
    return claims(spark, sf_dir).select("rec", review.source_label(c % 11 == 0, c % 13 == 0, bit(1), bit(2), bit(4), F.when(c % 3 == 0, 0.9), bit(8)).alias("label"))


#: severity, description, evidence, the level.
_SEVERITIES = (
    ("high", "", "", "High"), ("HIGHLY SEVERE", "minor", "", "Highly Severe"), ("severely high", "", "", "Highly Severe"), ("Severely_High", "risk", "", "Highly Severe"), ("odd", "a fatality on site", "", "Highly Severe"), (None, "", "Class Action filed", "Highly Severe"),
    ("", "lawsuit is near", "", "High"), ("?", "date MISSING", None, "Moderate"), (" low ", "fatal", "", "Low"), ("none", "all in order", "nothing", "Low"), ("moderate", "death", "", "Moderate"),
)


@query(_C + f"SELECT rec, level AS severity FROM claims JOIN {_values(_SEVERITIES, 's, d, e, level')} ON i = rec % {len(_SEVERITIES)}")
def p31_rule_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).withColumn("x", _picked(_SEVERITIES, 3))
    return c.select("rec", review.rule_severity(F.col("x.c0"), F.col("x.c1"), F.col("x.c2")).alias("severity"))


_METHOD = "CASE WHEN rec % 7 = 0 THEN 'title row' WHEN rec % 11 = 0 THEN 'embedding' WHEN rec % 13 = 0 THEN 'memory' WHEN rec % 17 = 0 THEN 'external' WHEN rec % 101 >= 90 THEN 'exact' WHEN rec % 101 >= 65 THEN 'fuzzy' WHEN rec % 101 > 4 THEN 'partial' WHEN rec % 2 = 0 THEN 'sub-row' ELSE {0} END"


@query(
    _F + f"SELECT rec, field, {_METHOD.format(chr(39) + 'direct' + chr(39))} AS method, CASE WHEN rec % 101 >= 80 THEN 'high' WHEN rec % 101 >= 50 THEN 'medium' ELSE 'low' END AS band,"
    f" {_METHOD.format('CASE WHEN rec % 3 = 0 THEN ' + chr(39) + 'external' + chr(39) + ' ELSE ' + chr(39) + 'direct' + chr(39) + ' END')} AS cause_method FROM fields"
)
def p32_mapping_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("rec")
    method = review.mapping_method(c % 7 == 0, c % 11 == 0, c % 13 == 0, c % 17 == 0, F.when(c % 101 > 4, c % 101), c % 2 == 0)
    cause = review.inferred_cause(F.col("method"), F.lit("Cause of Loss"), F.lit(None).cast("string"), F.when(c % 3 == 0, " Other").otherwise("hail"))
    return fields(spark, sf_dir).select("rec", "field", method.alias("method"), review.confidence_band(c % 101).alias("band")).select("rec", "field", "method", "band", cause.alias("cause_method"))


#: Field, value, the rule that it breaks.
_FAULTS = (
    ("Status", " ", "empty"), ("CR", "this is fine by me", "short name, talk"), ("Policy Number", "AB\nCD", "lines"), ("Description", "left\n3\nright", "digit line"), ("Loss Date", "due on $5", "date"), ("Claimant", "Balance 5", "name"),
    ("Remark", "$1.00 on 01/02/03 Balance", "billing"), ("Remark", "x" * 301, "long"), ("Years in Business", "1999", "duration"), ("Circuit", "12", "court"), ("Division", "North Circuit", "court"), ("Docket", "A 3 0", "court"), ("Category", "Jan 5 and Feb 6", "several"),
    ("Remark", "q", "one letter"), ("Remark", "Why not", "question"), ("Remark", "ready?", "question"), ("Remark", "sounds good", "dialogue"), ("Tag", "one two three four", "short name"), ("Remark", "water came down and caused it", "prose"), ("Item", "one two three four five", "short name, long value"),
    ("Description of Loss", "water came down and caused it", None), ("Adjuster", "Jane Doe", None), ("Loss Date", "2024-01-02", None), ("Circuit", "1st Circuit", None), ("Total Paid", "$12.00", None),
)


@query(_C + f"SELECT rec, field, fault FROM claims JOIN {_values(_FAULTS, 'field, value, fault')} ON i = rec % {len(_FAULTS)}")
def f10_value_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).withColumn("x", _picked(_FAULTS, 2))
    return c.select("rec", F.col("x.c0").alias("field"), review.value_fault(F.col("x.c0"), F.col("x.c1")).alias("fault"))


_ALLOWED = {"Loss": ("claim number", "total paid", "date"), "Legal": ("status", "filing state code")}
_NAME = "trim(regexp_replace(lower(field), '[\\s\\-_:./]+', ' ', 'g'))"


@query(
    _F + f", a AS (SELECT * FROM (VALUES {', '.join(str((t, w)) for t, ws in _ALLOWED.items() for w in ws)}) AS t(doc_type, w)), d AS (SELECT *, CASE rec % 3 WHEN 0 THEN 'Loss' WHEN 1 THEN 'Legal' ELSE 'Other' END AS doc_type FROM fields)"
    f" SELECT rec, field FROM d WHERE doc_type = 'Other' OR EXISTS (SELECT 1 FROM a WHERE a.doc_type = d.doc_type AND (contains({_NAME}, w) OR contains(w, {_NAME})))"
)
def f17_allowed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("rec") % 3 == 0, "Loss").when(F.col("rec") % 3 == 1, "Legal").otherwise("Other")
    return review.allowed_names(fields(spark, sf_dir).withColumns({"doc_type": kind, "name": F.col("field")}), _ALLOWED).select("rec", "field")


def _legacy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each policy, every third without the marks of a print layout; a main row, a sub row and a closing row for each claim."""
    own = Window.partitionBy("policy_number")
    n = claims(spark, sf_dir).withColumn("r", F.row_number().over(own.orderBy("rec")))
    n = n.withColumn("plain", F.regexp_extract("policy_number", "([0-9]+)$", 1).cast("long") % 3 == 0)
    none, lit = F.lit(None).cast("string"), lambda *c: F.array(*(F.lit(x).cast("string") for x in c))
    closing = F.when(F.col("rec") % 3 == 0, lit("", " ", None)).when(F.col("rec") % 3 == 1, lit("Total for file", "1", None)).otherwise(F.when(F.col("plain"), lit("")).otherwise(lit("----------", None, "----------")))
    body = F.array(F.array("claim_id", "loss_date", "status", "total_paid", "total_incurred"), F.array(none, "claimant_name", none, F.lit("12 MAIN ST"), none), closing)
    rows = n.select(F.col("policy_number").alias("sheet"), "r", F.posexplode(body).alias("k", "cells")).select("sheet", (3 * F.col("r") + F.col("k") + 1).cast("long").alias("row_no"), "cells")
    head = F.when(F.col("plain"), F.array(lit("Report"), lit("File", "Date", "State", "Paid", "Incurred"), lit("no", "no", "no"))).otherwise(F.array(lit("Report"), lit("Claim", None, "Dates"), lit("File No", "Loss Date", "Status", "Paid", "Incurred")))
    heads = n.select(F.col("policy_number").alias("sheet"), "plain").distinct().select("sheet", F.posexplode(head).alias("k", "cells")).select("sheet", (F.col("k") + 1).cast("long").alias("row_no"), "cells")
    return heads.unionByName(rows)


_PLAIN = "CAST(regexp_extract(policy_number, '([0-9]+)$', 1) AS BIGINT) % 3 = 0"


@query(_C + f", s AS (SELECT policy_number AS sheet, bool_or({_PLAIN}) AS plain, FROM claims GROUP BY 1) SELECT sheet, NOT plain AS legacy, CASE WHEN plain THEN 2 ELSE 2 END AS first_row, CASE WHEN plain THEN 2 ELSE 3 END AS second_row FROM s")
def x03_legacy_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _legacy_grid(spark, sf_dir)
    return grid.legacy_sheets(g).join(grid.legacy_header_rows(g), "sheet", "left")


@query(
    _C + ", n AS (SELECT policy_number AS sheet, row_number() OVER (PARTITION BY policy_number ORDER BY rec) AS r FROM claims) SELECT sheet, 3 * r + k + 1 AS row_no, ['main', 'sub', 'close'][k + 1] AS kind FROM n, (VALUES (0), (1), (2)) AS t(k)"
)
def f02_row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.row_kinds(_legacy_grid(spark, sf_dir).filter("row_no > 3")).select("sheet", "row_no", "kind")


@query(_C + ", n AS (SELECT policy_number AS sheet, row_number() OVER (PARTITION BY policy_number ORDER BY rec) AS r FROM claims) SELECT sheet, 3 * r + k + 1 AS row_no, 3 * r + 1 AS owner FROM n, (VALUES (0), (1)) AS t(k)")
def x06_legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.attach_subrows(grid.row_kinds(_legacy_grid(spark, sf_dir).filter("row_no > 3"))).select("sheet", "row_no", "owner")


@query(
    _C + ", s AS (SELECT policy_number AS sheet, min_by(claimant_name, rec) AS name, min_by(state, rec) AS state FROM claims GROUP BY 1) SELECT sheet, unnest(['Policy Number', 'Insured Name', 'State', 'Jurisdiction', 'State Code', 'Policy Period Start', 'Policy Period End', 'Line of Business', 'Prepared By', 'Header [R6C1]', 'Prepared By [R8C1]', 'Policy No']) AS field,"
    " unnest([sheet, name, state, state, state, '1/2/2024', '31 Dec 2024', 'Workers Compensation', 'the desk', 'All claims', 'the office', 'X-1']) AS value FROM s"
)
def x10_merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = claims(spark, sf_dir).groupBy(F.col("policy_number").alias("sheet")).agg(F.min_by("claimant_name", "rec").alias("name"), F.min_by("state", "rec").alias("state"))
    texts = (F.concat(F.lit("Policy No: "), "sheet"), F.concat(F.lit("Insured: "), "name", F.lit(" | State: "), "state"), F.lit("Period: 1/2/2024 to 31 Dec 2024"), F.lit("Loss run for workers' compensation"), F.lit("Prepared by: the desk"), F.lit("All claims"), F.lit("of no interest"), F.lit("Prepared by: the office"), F.lit("Policy No: X-1"))
    kinds = ("TITLE", "TITLE", "HEADER", "TITLE", "TITLE", "HEADER", "DATA", "TITLE", "TITLE")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.lit(i + 1).alias("row_start"), F.lit(1).alias("col_start"), t.alias("value")) for i, (k, t) in enumerate(zip(kinds, texts, strict=True)))))
    return grid.merged_fields(s.select("sheet", rows.alias("r")).select("sheet", "r.*")).select("sheet", "field", "value")


@query(
    _C + ", s AS (SELECT policy_number AS doc_id, count(*) AS n, min_by(claim_id, rec) AS id, min_by(status, rec) AS status FROM claims GROUP BY 1)"
    " SELECT doc_id, 'CLAIM' AS field, CASE WHEN n > 1 THEN id ELSE 'STATUS' END AS value, CASE WHEN n > 1 THEN 0.93 ELSE 0.95 END::DOUBLE AS confidence FROM s UNION ALL SELECT doc_id, CASE WHEN n > 1 THEN 'STATUS' ELSE id END, status, CASE WHEN n > 1 THEN 0.93 ELSE 0.95 END FROM s"
    " UNION ALL SELECT doc_id, 'Policy', doc_id, 0.95 FROM s"
)
def x18_table_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("policy_number").orderBy("rec")))
    pair = F.array(F.array(F.lit("CLAIM"), F.lit("STATUS")), F.array("claim_id", "status"))
    rows = c.select(F.col("policy_number").alias("doc_id"), "r", F.posexplode(pair).alias("k", "cells")).select("doc_id", F.lit(0).alias("tbl"), (2 * F.col("r") + F.col("k")).cast("int").alias("row"), "cells")
    more = c.select(F.col("policy_number").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("row"), F.array(F.lit("Policy:"), "doc_id").alias("cells")), F.struct(F.lit(2).alias("row"), F.array(F.lit("Value"), F.lit("x")).alias("cells")), F.struct(F.lit(3).alias("row"), F.array(F.lit("policy"), F.lit("later")).alias("cells")))).alias("x"))
    return layout.table_fields(rows.unionByName(more.select("doc_id", F.lit(1).alias("tbl"), "x.row", "x.cells"))).select("doc_id", "field", "value", "confidence")


@query(
    _C + ", s AS (SELECT policy_number AS doc_id, string_agg(claim_id, ' | ' ORDER BY rec) AS ids FROM claims GROUP BY 1) SELECT doc_id, unnest(['Causes of Action', 'Case Complaint Summary', 'Carrier', 'Source']) AS field, unnest([ids, 'short: one', 'ACME', 'court']) AS value, unnest([0.9, 0.9, 0.85, 0.85])::DOUBLE AS confidence FROM s WHERE false"
    " UNION ALL SELECT doc_id, unnest(['Causes of Action', 'Case Complaint Summary', 'Carrier', 'short']), unnest([ids, 'short: one', 'ACME', 'one']), unnest([0.9, 0.9, 0.85, 0.85])::DOUBLE FROM s"
)
def x19_section_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).select(F.col("policy_number").alias("doc_id"), "rec", "claim_id")
    start, line = lambda i, t: F.struct(F.lit(i).cast("long").alias("para"), F.lit(t).alias("text")), c.select("doc_id", (F.col("rec") + 10).cast("long").alias("para"), F.col("claim_id").alias("text"))
    top = 1 << 40
    fixed = (start(1, "Overview"), start(2, "general words"), start(3, "Causes of Action:"), start(top, ""), start(top + 1, "Source: court"), start(top + 2, "Carrier: ACME"), start(top + 3, "Complaint Summary"), start(top + 4, "short: one"), start(top + 5, "Case details"), start(top + 6, "carrier: other"))
    around = c.select("doc_id").distinct().select("doc_id", F.explode(F.array(*fixed)).alias("x")).select("doc_id", "x.*")
    return layout.section_fields(line.unionByName(around)).select("doc_id", "field", "value", "confidence")


@query(_C + "SELECT concat('K', claim_id) AS claim_id, true AS duplicate, CAST((rec % 10 = 0 AND status <> 'closed')::INT AS INT) AS changed FROM claims WHERE rec % 2 = 0")
def u01_reingest_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_map = lambda df: df.select("claim_id", F.create_map(F.lit("status"), "status").alias("fields"))
    store = as_map(claims(spark, sf_dir)).select(F.concat(F.lit("K"), "claim_id").alias("claim_id"), "fields", F.lit("first.csv").alias("filename"))
    return snapshots.check_reingest(as_map(claims_again(spark, sf_dir)), store, ident=F.concat(F.lit("K"), "claim_id")).select("claim_id", "duplicate", "changed")


#: keyword, type, severity, document type.
_TYPED = (("license", "legal", "High", None), ("the mit license", "legal", "Moderate", "en"), ("token", "credential", "High", "fr"), ("worthless", "tone", "Low", "en"), ("pre-existing mark", "entity", "Low", None), ("mark seven", "entity", "Low", "en"))


@query(
    f"WITH t AS (SELECT * FROM {_values(_TYPED, 'keyword, type, severity, for_type')}), d AS (SELECT doc_id, lang AS doc_type, concat_ws(' ', text, CASE WHEN doc_id % 5 = 0 THEN 'mark seven' END, CASE WHEN doc_id % 5 = 0 THEN 'pre existing mark' END) AS text FROM documents)"
    " SELECT doc_id, type, keyword FROM d, t WHERE (for_type IS NULL OR for_type = doc_type) AND regexp_matches(lower(text), '(^|[^0-9a-z])' || regexp_replace(keyword, '[^0-9a-z]+', '[^0-9a-z]+', 'g') || '($|[^0-9a-z])')"
)
def j14_typed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"), "text")
    entities = docs.filter("doc_id % 5 = 0").select("doc_id", F.explode(F.array(F.lit("pre existing mark"), F.lit("mark seven"))).alias("value"))
    found = documents.typed_signals(docs, entities, spark.createDataFrame(_TYPED, "keyword string, type string, severity string, for_type string"))
    return found.select("doc_id", "type", "keyword")


#: Entity name, the OCR field that it means, the likeness.
_MEANT = (
    ("claim_number:", "Claim Number", "1.0"), ("Status (now)", "Status", "1.0"), ("Policy Number of record", "Policy Number", "0.6"), ("Reported Date", "Date Reported", "0.6"), ("Total Paid To", "Total Paid", "0.7692"), ("Adjuster", None, None), ("Claimant", "Claimant Name", "0.6154"), ("Net Total Incurred Amount", "Total Incurred", "0.6"),
)


@query(
    _F + f", m AS (SELECT * FROM {_values(_MEANT, 'name, ocr_name, score')}) SELECT c.rec AS doc_id, m.name, f.field AS ocr_name, f.value AS ocr_value, CASE WHEN f.field IS NOT NULL THEN CAST(m.score AS DOUBLE) END AS score"
    " FROM claims c CROSS JOIN m LEFT JOIN fields f ON f.rec = c.rec AND f.field = m.ocr_name AND NOT (m.name = 'Status (now)')"
    " UNION ALL SELECT c.rec, 'Status of it', NULL, NULL, NULL FROM claims c WHERE false"
)
def j15_ocr_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir).select(F.col("rec").alias("doc_id"), F.col("field").alias("name"), "value", F.lit(1).alias("page"), F.lit(0.9).alias("confidence"), "pos")
    names = F.explode(F.array(*(F.lit(m[0]) for m in _MEANT))).alias("name")
    # a value that shares no word with the OCR's makes no match
    entities = claims(spark, sf_dir).select(F.col("rec").alias("doc_id"), names).select("doc_id", "name", F.when(F.col("name") == "Status (now)", "zzz").alias("value"), F.lit(1).alias("page"))
    return review.ocr_matches(entities, f).select("doc_id", "name", "ocr_name", "ocr_value", "score")


@query("SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\\x00-\\x{FF}]', '?', 'g') END, '\\r\\n?', chr(10), 'g') AS text FROM documents")
def s02_decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", "[^\\x00-\\xFF]", "?"), "ISO-8859-1"))
    return docs.select("doc_id", documents.decoded(content).alias("text"))


#: Extension, hex of the content, reason.
_UPLOADS = ((".pdf", "255044462d", None), (".PDF", "504b0304", "content does not match the extension"), (".xlsx", "504b030400", None), (".txt", "00", None), (".docx", "", "empty"))


@query(_C + f"SELECT rec, CASE WHEN rec % 9 = 0 THEN 'too large' ELSE reason END AS reason, rec % 9 <> 0 AND reason IS NULL AS ok FROM claims JOIN {_values(_UPLOADS, 'ext, content, reason')} ON i = rec % {len(_UPLOADS)}")
def f01_upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).withColumn("x", _picked(_UPLOADS, 2)).withColumn("content", F.unhex("x.c1"))
    files = c.select("rec", F.col("x.c0").alias("ext"), "content", F.when(F.col("rec") % 9 == 0, grid.MAX_BYTES + 1).otherwise(F.length("content")).alias("length"))
    return grid.upload_verdict(files).select("rec", "reason", "ok")


@query(_C + "SELECT rec, unnest(['Claim ID', 'Status', 'Paid', 'loss_state']) AS label, unnest([claim_id, status, total_incurred, 'of ' || state]) AS value, unnest([0.9, 0.85, 0.75, 0.9])::DOUBLE AS confidence FROM claims")
def x14_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("no label here\nClaim ID: "), "claim_id", F.lit("\nStatus = "), "status", F.lit("\nPaid    "), "total_incurred", F.lit("\nclaim-id: other\nloss_state: of "), "state")
    docs = claims(spark, sf_dir).select(F.col("rec").alias("doc_id"), text.alias("text"))
    return documents.label_lines(docs).select(F.col("doc_id").alias("rec"), "label", "value", "confidence")
