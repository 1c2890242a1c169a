"""Reconciled fields of one document for each order, in five layouts with blanks, conflicts, uncovered fields and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import reconcile as R
from ledgerline.operators.review import NAME_STOPS
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import CLAIMS_CTE, claims

#: Layout, place, name, value (@: the claim's id, %: its claimant, ~: its loss date), confidence, hint.
_ENTITIES = (
    (0, 1, "Claim Number", "@", 0.9, None), (0, 2, "Insured Name", "", 0.4, None), (0, 3, "Named Insured", "%", None, None), (0, 4, "Loss Date", "~ 10:30 pm", 0.8, None), (0, 5, "Date of Loss", "7/7/1777", 0.8, None), (0, 6, "Claim Notes", "kept out", 0.9, None), (0, 7, "ID", "@", 0.9, None),
    (1, 1, "Total Paid", "zzz", 0.7, None), (1, 2, "Vehicle Damage", "dent in 2 doors", 0.6, None), (1, 3, "Damage", "scratched all over", 0.6, None), (1, 4, "Damage Amount", "$5", 0.6, "Total Paid"), (1, 5, "Adjuster", "Q", 0.5, None), (1, 6, "Policy Number of record", "", 0.5, None),
    (2, 1, "Summary", "The house was lost and it burned down fully", 0.1, None), (2, 2, "Matter", "Anything else?", 0.9, None), (2, 3, "Peril", "Fire, at the mill of %", 0.5, None), (2, 4, "Insured", "%", 0.5, None), (2, 5, "insured:", "% again", 0.5, None), (2, 6, "The Insured", "%", 0.5, None),
    (3, 1, "Status", "okay go ahead", 0.9, None), (3, 2, "Claim No", "@", 0.2, None), (3, 3, "Remark", "one. two. three", 0.9, None), (3, 4, "Case", "@", 0.9, None),
)
#: Layout, place, name, value, confidence, box: 0 none, 1 a part of the page, 2 the page.
_OCR = (
    (0, 1, "claim_number:", "@", 0.95, 1), (0, 2, "Insured Name (full)", "%", 0.7, 2), (0, 3, "Carrier", "ACME", 0.6, 1), (0, 4, "Holder", "%", 0.5, 1), (0, 5, "Loss Date", "~", 0.0, 1), (0, 6, "Insurer", "acme", 0.9, 1), (0, 7, "Adjuster", "N/A", 0.9, 1),
    (1, 1, "Total Paid", "$12 of @", 0.8, 2), (1, 2, "Policy Number", "P-@", 0.65, 0), (1, 3, "policy-number", "P-other", 0.6, 1), (1, 4, "Total  Paid", "$13 of @", 0.9, 1),
    (2, 1, "Cause", "Reported as fire, at the mill of %, at night", 0.77, 1), (2, 2, "Deductible Paid", "100 for @", 0.5, 1), (2, 3, "Unlisted", "dropped @", 0.5, 1), (2, 4, "Paid Deductible", "100 for @", 0.4, 2),
    (4, 1, "Claim Number", "@", 0.9, 1), (4, 2, "Number of Claim", "@", 0.9, 1), (4, 3, "Status", "x", 0.9, 1), (4, 4, "Paid", "none", 0.9, 1),
)
#: Names that a type of document may take from OCR.
_ALLOWED = {"fire": ("paid", "insured", "cause")}
_TYPES = "CASE layout WHEN 2 THEN 'fire' WHEN 1 THEN 'auto' ELSE 'claim' END"
_E, _O = "layout int, pos int, name string, value string, confidence double, key_hint string", "layout int, pos int, name string, value string, confidence double, box int"


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _key(x: str) -> str:
    bare = f"trim(rtrim(trim(regexp_replace(trim({x}), '\\([^)]*\\)', '', 'g')), ':'))"
    return f"regexp_replace(regexp_replace(lower({bare}), '[\\s\\-_:./]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _sig(k: str) -> str:
    return f"list_distinct(list_filter(string_split({k}, '_'), lambda w: len(w) > 1 AND w NOT IN {NAME_STOPS}))"


def _like(a: str, b: str) -> str:
    shared, least, most = f"len(list_intersect({_sig(a)}, {_sig(b)}))", f"least(len({_sig(a)}), len({_sig(b)}))", f"greatest(len({_sig(a)}), len({_sig(b)}))"
    jaccard = f"{shared} / len(list_distinct(list_concat({_sig(a)}, {_sig(b)})))"
    inside = f"(contains({a}, {b}) OR contains({b}, {a})) AND least(len({a}), len({b})) >= 0.6 * greatest(len({a}), len({b}))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {inside} THEN least(len({a}), len({b})) / greatest(len({a}), len({b})) WHEN {least} = 0 THEN 0 WHEN {shared} = {least} AND ({least} >= 2 OR {least} / {most} >= 0.5) THEN 0.6 WHEN {jaccard} >= 0.4 THEN {jaccard} ELSE 0 END"


def _tokens(v: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({v}, '')), '[^0-9a-z_\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) >= 3 AND w NOT IN {R.VALUE_STOPS})"


_FILL = lambda x: f"replace(replace(replace({x}, '@', claim_id), '%', claimant_name), '~', loss_date)"
_WORD = lambda words: "'(?i)\\b(" + words.replace("'", "''") + ")\\b'"
_FAULTY = lambda v: f"(len({v}) < 2 OR ends_with({v}, '?'))"
_SQL = f"""
WITH RECURSIVE {CLAIMS_CTE},
 et(layout, pos, name, value, confidence, key_hint) AS (VALUES {_values(_ENTITIES)}), ot(layout, pos, name, value, confidence, box) AS (VALUES {_values(_OCR)}),
 docs AS (SELECT *, rec AS doc_id, CAST(rec % 5 AS INT) AS layout, rec % 5 = 3 AS is_text, 'of ' || loss_date || ' and later' AS text FROM claims),
 typed AS (SELECT *, {_TYPES} AS doc_type FROM docs),
 e0 AS (SELECT doc_id, is_text, text, pos, name, {_FILL("value")} AS value, confidence, key_hint FROM typed JOIN et USING (layout) WHERE len(trim(name)) > 2 AND NOT (doc_id % 9 = 0 AND name = 'Insured')),
 e1 AS (SELECT * REPLACE (CASE WHEN contains(lower(name), 'damage') AND (NOT regexp_matches(value, '[0-9]') OR regexp_matches(lower(value), '{"|".join(R.DAMAGE_WORDS)}')) THEN 'damage description' ELSE name END AS name), len(list_filter(regexp_split_to_array(trim(value), '\\s+'), lambda w: w <> '')) AS n FROM e0),
 e2 AS (SELECT *, {_key("name")} AS k FROM e1 WHERE NOT regexp_matches(name, {_WORD(R.COMMENTS)})
  AND NOT (is_text AND (regexp_matches(value, {_WORD(R.DIALOGUE)}) OR ends_with(value, '?') OR len(regexp_extract_all(value, '[.!?]')) >= 2 OR (n >= 3 AND regexp_matches(value, {_WORD(R.PROSE)}))))
  AND NOT (NOT is_text AND n >= 4 AND coalesce(confidence, 1) < 0.15 AND regexp_matches(value, {_WORD(R.PROSE)}))),
 o AS (SELECT doc_id, doc_type, pos, name, {_FILL("value")} AS value, confidence, box, {_key("name")} AS k FROM typed JOIN ot USING (layout)),
 met AS (SELECT e2.*, {{'name': o.name, 'value': o.value, 'confidence': o.confidence, 'box': o.box}} AS x, o.pos AS opos, o.k AS ok, o.confidence AS oc, o.value AS ov, o.box AS obox, {_like("e2.k", "o.k")} AS score, CASE WHEN len(list_filter(string_split(e2.k, '_'), lambda w: w <> '')) <= 2 THEN 0.5 ELSE 0.6 END AS need FROM e2 LEFT JOIN o USING (doc_id)),
 best AS (SELECT doc_id, pos, name, value, confidence, key_hint, text, arg_max(x, (score, oc, -opos)) FILTER (score >= need) AS m0, arg_max(x, (oc, -opos)) FILTER (ok = {_key("key_hint")}) AS h,
  arg_min(x, opos) FILTER (obox > 0 AND len(value) > 6 AND contains(lower(ov), lower(array_to_string(regexp_split_to_array(trim(value), '\\s+')[1:6], ' ')))) AS q FROM met GROUP BY ALL),
 vetoed AS (SELECT *, CASE WHEN len({_tokens("value")}) = 0 OR len({_tokens("m0.value")}) = 0 OR list_has_any({_tokens("value")}, {_tokens("m0.value")}) THEN m0 END AS m FROM best),
 ways AS (SELECT *, coalesce(m.box = 1, false) AS placed, coalesce(m.box <> 1, true) AND coalesce(h.box > 0, false) AS hinted FROM vetoed),
 found AS (SELECT *, NOT placed AND NOT hinted AND q IS NOT NULL AS quoted FROM ways),
 mine AS (SELECT doc_id, pos, name, CASE WHEN value = '' THEN coalesce(m.value, '') ELSE value END AS value, text,
  CASE WHEN quoted AND q.confidence > 0 THEN q.confidence WHEN hinted AND h.confidence > 0 THEN h.confidence WHEN m.confidence > 0 THEN m.confidence ELSE coalesce(confidence, 0) END AS confidence,
  CASE WHEN hinted THEN key_hint ELSE coalesce(m.name, CASE WHEN quoted THEN q.name END) END AS ocr_name, placed OR hinted OR quoted AS placed FROM found),
 sound AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, name, value, confidence, 'model' AS origin, ocr_name, placed FROM mine WHERE value <> '' AND NOT {_FAULTY("value")}
  AND (NOT regexp_matches(lower(name), '{"|".join(R.DATE_NAMES)}') OR contains(text, value) OR contains(text, regexp_replace(value, '\\s+[0-9]+:[0-9]+.*$', '')))),
 spare AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, name, value, confidence, k, box = 1 AS placed FROM o WHERE lower(value) NOT IN {R.EMPTY_VALUES} AND NOT {_FAULTY("value")}
  AND (doc_type <> 'fire' OR regexp_matches(lower(name), 'paid|insured|cause')) AND NOT (doc_id % 9 = 0 AND name = 'Insured')),
 fill AS (SELECT docs.doc_id, CAST(0 AS BIGINT) AS i, coalesce(list({_key("s.name")}) FILTER (s.name IS NOT NULL), []) AS names, coalesce(list(lower(trim(s.value))) FILTER (s.name IS NOT NULL), []) AS vals, false AS took FROM docs LEFT JOIN sound s USING (doc_id) GROUP BY docs.doc_id
  UNION ALL SELECT doc_id, i, CASE WHEN took THEN list_append(names, k) ELSE names END, CASE WHEN took THEN list_append(vals, v) ELSE vals END, took
  FROM (SELECT f.doc_id, s.i, f.names, f.vals, s.k, lower(s.value) AS v, NOT list_contains(f.names, s.k) AND NOT list_contains(f.vals, lower(s.value)) AS took FROM fill f JOIN spare s ON s.doc_id = f.doc_id AND s.i = f.i + 1)),
 every AS (SELECT * FROM sound UNION ALL SELECT doc_id, 1000 + i, name, value, confidence, 'ocr', name, placed FROM spare JOIN fill USING (doc_id, i) WHERE took),
 outs AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i), {_key("name")} AS n, lower(trim(value)) AS v FROM every),
 likes AS (SELECT a.doc_id, a.i, b.n AS other, {_like("a.n", "b.n")} >= 0.4 AS alike FROM outs a JOIN outs b ON a.doc_id = b.doc_id AND b.i < a.i GROUP BY ALL),
 once AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS names, CAST([] AS STRUCT(n VARCHAR, v VARCHAR)[]) AS kept, false AS took FROM docs
  UNION ALL SELECT doc_id, i, list_append(names, n), CASE WHEN again OR alike THEN kept ELSE list_append(kept, {{'n': n, 'v': v}}) END, NOT again AND NOT alike
  FROM (SELECT w.doc_id, s.i, w.names, w.kept, s.n, s.v, list_contains(w.names, s.n) AS again, coalesce(l.alike, false) AS alike
   FROM once w JOIN outs s ON s.doc_id = w.doc_id AND s.i = w.i + 1 LEFT JOIN likes l ON l.doc_id = s.doc_id AND l.i = s.i AND l.other = (list_filter(w.kept, lambda x: x.v = s.v)[-1]).n))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, name, value, CAST(confidence AS DOUBLE) AS confidence, origin, ocr_name, placed FROM outs JOIN once USING (doc_id, i) WHERE took
"""


@query(_SQL)
def j16_reconciled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).withColumns({"doc_id": F.col("rec"), "layout": (F.col("rec") % 5).cast("int")})
    fill = F.replace(F.replace(F.replace("value", F.lit("@"), F.col("claim_id")), F.lit("%"), F.col("claimant_name")), F.lit("~"), F.col("loss_date"))
    e = c.join(F.broadcast(spark.createDataFrame(_ENTITIES, _E)), "layout").select("doc_id", "pos", "name", fill.alias("value"), "confidence", "key_hint")
    point = lambda x, y: F.array(F.lit(x), F.lit(y))
    polygon = F.when(F.col("box") == 1, F.array(point(0.0, 0.0), point(2.0, 1.0))).when(F.col("box") == 2, F.array(point(0.0, 0.0), point(8.0, 11.0)))
    o = c.join(F.broadcast(spark.createDataFrame(_OCR, _O)), "layout").select("doc_id", "pos", "name", fill.alias("value"), "confidence", polygon.alias("polygon"), F.lit(8.5).alias("page_width"), F.lit(11.0).alias("page_height"))
    docs = c.select("doc_id", F.expr(_TYPES).alias("doc_type"), (F.col("layout") == 3).alias("is_text"), F.concat(F.lit("of "), "loss_date", F.lit(" and later")).alias("text"))
    gone = c.filter("rec % 9 = 0").select("doc_id", F.lit("Insured").alias("name"))
    return R.reconcile(e, o, docs, _ALLOWED, gone)
