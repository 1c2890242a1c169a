"""Rule signals of one document for each order: labels, fields and texts in all combinations that the rules tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import rules as R
from ledgerline.operators.review import LEVELS
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import table

_TODAY = "1996-06-15"
_DATES = "CASE CAST({0} % 9 AS INT) WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-', CAST(day(o_orderdate) AS STRING)) WHEN 1 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING)) WHEN 2 THEN ' 25/12/1998' WHEN 3 THEN 'Sept. 25th, 1997' WHEN 4 THEN 'March 5 1960 noon' WHEN 5 THEN 'Feb. 30, 1990' WHEN 6 THEN 'soon' WHEN 7 THEN '' ELSE NULL END"
#: Fields by name; a null is no field.
_FIELDS = {
    "Filing Date": _DATES.format("o_orderkey"), "Effective Date": _DATES.format("(o_orderkey + o_custkey)"), "EXPIRATION DATE": _DATES.format("(o_orderkey + 4)"), "Loss Date": _DATES.format("o_custkey"), "Due Date": _DATES.format("(o_custkey + 5)"),
    "policy number": "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN concat('POL-', CAST(o_custkey AS STRING)) WHEN 1 THEN 'NONE-1' WHEN 2 THEN '' ELSE NULL END", "Case Number": "CASE WHEN o_orderkey % 3 = 0 THEN 'C-1' ELSE NULL END", "CLAIM NUMBER": "CASE WHEN o_custkey % 2 = 0 THEN 'K' ELSE NULL END",
}
_PIECES = (
    "the carrier pleads Fraud and fraudulent acts in this matter, and it says so at some length over more than sixty characters of this line\nnext line", "a Punitive   damages count", "this is a CLASS\naction", "there was no valid licence, and the use was an unauthorized use of the car; the owner did not know of it", "negligence of the driver was negligent",
    "they ask for declaratory relief", "coverage denied; coverage lapse", "signed Feb 29th, 1997 and February 29 1996", "Feb. 29, 1996", "policy pol-{}",
)
_TEXT = "concat_ws(' ', " + ", ".join("CASE WHEN CAST(floor(o_orderkey / {}) AS BIGINT) % {} = 0 THEN ".format(k + 1, 2 + k % 4) + ("concat('policy pol-', CAST(o_custkey AS STRING))" if p.endswith("{}") else "'" + p.replace("\n", "{n}") + "'") + " ELSE NULL END" for k, p in enumerate(_PIECES)) + ")"
_LABEL = "CASE CAST(o_custkey % 7 AS INT) " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate((*R.REQUIRED, "General Document"))) + " ELSE 'Other' END"
_DOCS = "SELECT o_orderkey AS doc_id, " + _LABEL + " AS label, " + _TEXT + " AS text, " + ", ".join(f"{sql} AS f{i}" for i, sql in enumerate(_FIELDS.values())) + " FROM {orders}"
_F = {name: f"f{i}" for i, name in enumerate(_FIELDS)}
_LOWER = {name.lower(): c for name, c in _F.items()}


def _parsed(c: str) -> str:
    named = "'^([A-Za-z]+)\\.?\\s+(\\d{1,2})(?:st|nd|rd|th)?,?\\s+(\\d{4})'"
    slashes = "'^(\\d{1,2})/(\\d{1,2})/(\\d{4})$'"
    one = lambda p, y, m, d: f"TRY_CAST(regexp_extract(trim({c}), {p}, {y}) || '-' || lpad(regexp_extract(trim({c}), {p}, {m}), 2, '0') || '-' || lpad(regexp_extract(trim({c}), {p}, {d}), 2, '0') AS DATE)"
    month = f"lpad(CAST(list_position({list(R.MONTHS)}, lower(regexp_extract(trim({c}), {named}, 1))[1:3]) AS VARCHAR), 2, '0')"
    return f"coalesce({one(chr(39) + '^(\\d{4})-(\\d{1,2})-(\\d{1,2})$' + chr(39), 1, 2, 3)}, {one(slashes, 3, 1, 2)}, {one(slashes, 3, 2, 1)}, TRY_CAST(regexp_extract(trim({c}), {named}, 3) || '-' || {month} || '-' || lpad(regexp_extract(trim({c}), {named}, 2), 2, '0') AS DATE))"


def _sql() -> str:
    """Each rule as a SELECT with its number; the numbers order what is equally severe."""
    parts, n = [], 0

    def add(signal: str, level: str, evidence: str, condition: str, repeat: str = "1") -> None:
        nonlocal n
        n += 1
        parts.append(f"SELECT doc_id, {n} AS n, '{signal}' AS signal, '{level}' AS severity, {evidence} AS evidence, {LEVELS.index(level)} AS rank FROM docs, range({repeat}) WHERE {condition}")

    for name in R.DATE_FIELDS:
        if name in _F:
            c, kind = _F[name], name.lower()
            future = ("Filing Date in Future", LEVELS[0]) if kind == "filing date" else ("Effective Date in Future", LEVELS[1]) if "effective" in kind else (f"{name} is a Future Date", LEVELS[2])
            if "expir" not in kind:
                add(*future, f"'{name}: ' || {c}", f"{_parsed(c)} > DATE '{_TODAY}'")
            add(f"Unusually Old Date — {name}", LEVELS[2], f"'{name}: ' || {c}", f"year({_parsed(c)}) < {int(_TODAY[:4]) - 30}")
    leap = f"TRY_CAST(regexp_extract(text, '{R.LEAP_DAY_YEAR}', 1) AS INT)"
    add("Invalid Date — February 29 in Non-Leap Year", LEVELS[0], f"regexp_extract(text, '{R.LEAP_DAY_YEAR}')", f"NOT ({leap} % 4 = 0 AND {leap} % 100 <> 0 OR {leap} % 400 = 0)", f"len(regexp_extract_all(text, '{R.LEAP_DAY}'))")
    for label, wanted in R.REQUIRED.items():
        for name, level in wanted:
            add(f"Missing Field — {name}", level, "''", f"label = '{label}' AND coalesce({_LOWER.get(name.lower(), 'NULL')}, '') = ''")
    policy, filed, effective = _LOWER["policy number"], _LOWER["filing date"], _LOWER["effective date"]
    add("Policy Number Not Found in Body Text", LEVELS[2], f"'Policy Number: ' || {policy}", f"label = 'Legal Document' AND {policy} <> '' AND NOT contains(low, lower({policy}))")
    add("Effective Date Precedes Filing Date", LEVELS[1], f"'Filing Date: ' || {filed} || ' | Effective Date: ' || {effective}", f"{_parsed(effective)} < {_parsed(filed)}")
    for texts, labels in ((R.LEGAL_TEXTS, R.LEGAL_LABELS), (R.INSURANCE_TEXTS, R.INSURANCE_LABELS)):
        for name, level, called, shown, around in texts:
            add(name, level, f"trim(regexp_extract(low, '.{{0,{around}}}{shown}.{{0,{around}}}'))", f"label IN {labels} AND regexp_matches(low, '{called}')")
    count = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in _F.values())
    add("Very Few Fields Extracted", LEVELS[2], "''", f"{count} < 3")
    add("Document May Be Empty or Truncated", LEVELS[1], "''", "len(regexp_extract_all(text, '\\S+')) < 30")
    docs = _DOCS.replace("STRING", "VARCHAR").format(orders="orders", n="' || chr(10) || '")
    return f"WITH base AS ({docs}), docs AS (SELECT *, lower(text) AS low FROM base), every AS ({' UNION ALL '.join(parts)}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank, n) - 1 AS INTEGER) AS ord, signal, severity, evidence FROM every"


@query(_sql())
def r01_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_DOCS.replace("{n}", "\n"), orders=table(spark, sf_dir, "orders").repartition("o_orderkey"))
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in _F.items())), lambda p: p["value"].isNotNull())
    return R.document_signals(rows.select("doc_id", "label", "text", F.map_from_entries(pairs).alias("fields")), F.lit(_TODAY).cast("date"))
