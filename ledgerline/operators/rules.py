"""Rule signals of documents: dates, fields that are missing or in conflict, and what legal and insurance texts speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.review import LEVELS

# Fixed values.
DATE_FIELDS = ("Filing Date", "FILING DATE", "Effective Date", "EFFECTIVE DATE", "Expiration Date", "EXPIRATION DATE", "Loss Date", "Date of Loss", "Invoice Date", "Due Date", "Date of Service")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NAMED_DATE = "(?i)^([A-Za-z]+)\\.?\\s+(\\d{1,2})(?:st|nd|rd|th)?,?\\s+(\\d{4})"
LEAP_DAY, LEAP_DAY_YEAR = "[Ff]eb(?:ruary|\\.)?\\.?\\s+29(?:th)?", "[Ff]eb(?:ruary|\\.)?\\.?\\s+29(?:th)?,?\\s+(\\d{4})"
REQUIRED = {
    "Legal Document": (("Case Number", "Highly Severe"), ("Plaintiff", "High"), ("Defendant", "High"), ("Filing Date", "High"), ("Court", "Moderate")),
    "Insurance Policy": (("Policy Number", "Highly Severe"), ("Insured", "High"), ("Effective Date", "High"), ("Expiration Date", "High"), ("Premium Amount", "Moderate")),
    "Claims Report": (("Claim Number", "Highly Severe"), ("Claimant Name", "High"), ("Loss Date", "High"), ("Claim Status", "Moderate")),
    "Medical Report": (("Patient Name", "Highly Severe"), ("Diagnosis", "High"), ("Date of Service", "High")),
    "Invoice / Bill": (("Invoice Number", "Highly Severe"), ("Total Amount", "High"), ("Due Date", "Moderate")),
}
#: Signal, severity, pattern that calls it, pattern of its evidence, characters of evidence on either side.
LEGAL_TEXTS = (
    ("Fraud or Misrepresentation Allegation", "Highly Severe", "fraud|fraudulent|misrepresent", "(?:fraud|fraudulent|misrepresent)", 60), ("Punitive Damages Claim", "Highly Severe", "punitive\\s+damage", "punitive\\s+damage", 60),
    ("Class Action Exposure", "Highly Severe", "class\\s+action", "class\\s+action", 60), ("Unauthorized Use / Unlicensed Operator", "High", "unauthorized\\s+use|no\\s+valid\\s+(?:license|licence|operator)", "(?:unauthorized\\s+use|no\\s+valid\\s+(?:license|licence|operator))", 80),
    ("Negligence Claim Present", "High", "negligence|negligent", "negligen", 60), ("Declaratory Judgment Action", "Moderate", "declaratory\\s+judgment|declaratory\\s+relief", "declaratory\\s+(?:judgment|relief)", 60),
)
INSURANCE_TEXTS = (("Coverage Exclusion or Denial", "High", "coverage\\s+(?:exclusion|excluded|denied|lapse)", "coverage\\s+(?:exclusion|excluded|denied|lapse)", 80),)
LEGAL_LABELS, INSURANCE_LABELS = ("Legal Document", "General Document"), ("Insurance Policy", "Claims Report", "Loss Run Report", "Certificate of Insurance", "General Document")
MIN_FIELDS, MIN_WORDS, OLD_YEARS = 3, 30, 30
#: Characters in which a phrase and its surroundings are looked for behind its start.
_REACH = 400
_SIGNAL = "array<struct<signal:string,severity:string,evidence:string>>"
_WHITE = " \t\n\x0b\x0c\r"


def rule_date(v: Column) -> Column:
    """Year first, month before day before day before month, or a month's name with or without an ordinal; else null."""
    s = F.trim(v, F.lit(_WHITE))

    def day(pattern: str, order: tuple[int, int, int]) -> Column:
        """The date of a pattern's groups; no day of the calendar is null, without the cost of a failed parse."""
        y, m, d = (F.regexp_extract(s, pattern, g) for g in order)
        m = F.array_position(F.array(*(F.lit(x) for x in MONTHS)), F.substring(F.lower(m), 1, 3)) if pattern == NAMED_DATE else m
        y, m, d = y.try_cast("int"), m.try_cast("int"), d.try_cast("int")
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.when(m.between(1, 12) & d.between(1, days), F.make_date(y, m, d))

    iso, slashes = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$", "^(\\d{1,2})/(\\d{1,2})/(\\d{4})$"
    return F.when(s.rlike(iso), day(iso, (1, 2, 3))).when(s.rlike(slashes), F.coalesce(day(slashes, (3, 1, 2)), day(slashes, (3, 2, 1)))).when(s.rlike(NAMED_DATE), day(NAMED_DATE, (3, 1, 2)))


def _signal(name: Column | str, level: str, evidence: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(name).alias("signal"), F.lit(level).alias("severity"), lit(evidence).alias("evidence"))


def _when(condition: Column, signal: Column) -> Column:
    return F.when(condition, F.array(signal)).otherwise(F.array().cast(_SIGNAL))


def missing_fields(label: Column, value_of) -> Column:
    """Signals of the fields that documents of this label must have; ``value_of`` gives a field's value by its name."""
    return F.coalesce(*(F.when(label == kind, F.concat(*(_when(F.coalesce(value_of(name), F.lit("")) == "", _signal(f"Missing Field — {name}", level, "")) for name, level in wanted))) for kind, wanted in REQUIRED.items()), F.array().cast(_SIGNAL))


def _evidence(low: Column, called: str, shown: str, around: int) -> Column:
    """The first phrase with what stands before and behind it in its line; only its surroundings are searched."""
    at = F.regexp_instr(low, F.lit(called))
    near = F.substring(low, F.greatest(at - around, F.lit(1)), F.lit(2 * around + _REACH))
    return F.trim(F.regexp_extract(near, f"[^\\n]{{0,{around}}}{shown}[^\\n]{{0,{around}}}", 0), F.lit(_WHITE))


def document_signals(docs: DataFrame, as_of: Column) -> DataFrame:
    """(doc_id, ord, signal, severity, evidence) of documents (doc_id, label, text, fields: map), the severest first, else in the rules' order.

    ``as_of`` is today's date. Field names count in either case, of several that agree the last. A null text is empty.
    """
    d = docs.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"), "fields", F.transform(F.map_entries("fields"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))).alias("__e")).withColumn("__low", F.lower("text"))
    low, label = F.col("__low"), F.col("label")
    exact = lambda name: F.try_element_at("fields", F.lit(name))
    of = lambda name: F.element_at(F.concat(F.array(F.struct(F.lit("").alias("key"), F.lit(None).cast("string").alias("value"))), F.filter("__e", lambda e: e["key"] == name.lower())), -1)["value"]
    d = d.withColumns({f"__day{i}": rule_date(exact(name)) for i, name in enumerate(DATE_FIELDS)})
    rules = []
    for i, name in enumerate(DATE_FIELDS):
        v, kind = exact(name), name.lower()
        day, told = F.col(f"__day{i}"), F.concat(F.lit(f"{name}: "), v)
        future = ("Filing Date in Future", LEVELS[0]) if kind == "filing date" else ("Effective Date in Future", LEVELS[1]) if "effective" in kind else None if "expir" in kind else (f"{name} is a Future Date", LEVELS[2])
        if future:
            rules.append(_when(day > as_of, _signal(*future, told)))
        rules.append(_when(F.year(day) < F.year(as_of) - OLD_YEARS, _signal(f"Unusually Old Date — {name}", LEVELS[2], told)))
    year = F.regexp_extract("text", LEAP_DAY_YEAR, 1).try_cast("int")
    common = ~(((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0))
    invalid = _signal("Invalid Date — February 29 in Non-Leap Year", LEVELS[0], F.regexp_extract("text", LEAP_DAY_YEAR, 0))
    rules.append(F.when(common, F.array_repeat(invalid, F.regexp_count("text", F.lit(LEAP_DAY)))).otherwise(F.array().cast(_SIGNAL)))
    rules.append(missing_fields(label, of))
    policy = F.coalesce(of("policy number"), F.lit(""))
    rules.append(_when((label == "Legal Document") & (policy != "") & ~F.contains(low, F.lower(policy)), _signal("Policy Number Not Found in Body Text", LEVELS[2], F.concat(F.lit("Policy Number: "), policy))))
    filed, effective = of("filing date"), of("effective date")
    rules.append(_when(rule_date(effective) < rule_date(filed), _signal("Effective Date Precedes Filing Date", LEVELS[1], F.concat(F.lit("Filing Date: "), filed, F.lit(" | Effective Date: "), effective))))
    for texts, labels in ((LEGAL_TEXTS, LEGAL_LABELS), (INSURANCE_TEXTS, INSURANCE_LABELS)):
        rules += [_when(label.isin(*labels) & low.rlike(called), _signal(name, level, _evidence(low, called, shown, around))) for name, level, called, shown, around in texts]
    words = F.regexp_count("text", F.lit("\\S+"))
    rules += [_when(F.coalesce(F.size("fields"), F.lit(0)) < MIN_FIELDS, _signal("Very Few Fields Extracted", LEVELS[2], "")), _when(words < MIN_WORDS, _signal("Document May Be Empty or Truncated", LEVELS[1], ""))]
    rank = lambda s: F.array_position(F.array(*(F.lit(x) for x in LEVELS)), s["severity"])
    ranked = F.array_sort(F.transform(F.concat(*rules), lambda s, i: F.struct(rank(s).alias("r"), i.alias("i"), s.alias("s"))))
    return d.select("doc_id", F.posexplode(ranked).alias("ord", "x")).select("doc_id", "ord", "x.s.*")
