"""Signals and entities: confidence, category, severity, merging, context rules, coverage, claim ids."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import standardize as S
from ledgerline.operators.documents import one_text
from ledgerline.operators.mapping import STOPWORDS, name_tokens, token_similarity

# Fixed values.
LEVELS = ("Highly Severe", "High", "Moderate", "Low")
LEVEL_WEIGHTS = {"Highly Severe": 1.06, "High": 1.02, "Moderate": 1.0, "Low": 0.94}
TYPE_LEVELS = {"severity": "High", "legal_escalation": "High", "coverage_issue": "Moderate", "medical_complexity": "Moderate", "fraud_indicator": "Moderate"}
CATEGORIES = {
    "legal_escalation": "Litigation Risk", "litigation_exposure": "Litigation Risk", "severity": "Exposure Risk", "medical_complexity": "Exposure Risk", "risk_severity": "Exposure Risk",
    "recovery_subrogation": "Exposure Risk", "coverage_adequacy": "Coverage Risk", "coverage_issue": "Coverage Risk", "risk_appetite": "Reputation Risk", "reputation_risk": "Reputation Risk",
}
CATEGORY_WORDS = (("legal|litigation|attorney|lawsuit", "Litigation Risk"), ("recovery|subroga|severity|medical|injury|risk_sev", "Exposure Risk"), ("coverage|adequacy", "Coverage Risk"), ("reputation|appetite", "Reputation Risk"))
ANCHORS = {
    "wrongful death": 0.95, "class action": 0.95, "punitive": 0.92, "bad faith": 0.92, "amputation": 0.92, "paralysis": 0.92, "permanent disability": 0.88, "misrepresentation": 0.88, "catastrophic": 0.88, "fatal": 0.90,
    "death": 0.90, "deceased": 0.90, "fraud": 0.90, "criminal": 0.90, "staged": 0.85, "surgery": 0.75, "attorney": 0.78, "lawsuit": 0.80, "litigation": 0.80, "hospitalized": 0.75, "subrogation": 0.78,
    "reservation of rights": 0.82, "fracture": 0.72, "inconsistent": 0.60, "suspicious": 0.62, "severe": 0.60, "injury": 0.55, "damage": 0.50, "pain": 0.45, "open": 0.45, "reserve": 0.50,
}
THIRD_PARTY = (
    "she hit me", "he hit me", "they hit me", "hit me", "ran into me", "rear ended", "rear impact", "at fault", "her fault", "his fault", "their fault", "other driver", "other vehicle", "other party", "pushed me into", "pushed you into",
    "she's at fault", "he's at fault", "i was stopped", "fully stopped", "was stationary", "ran a red", "ran the red", "ran a stop", "wrong lane", "wrong side", "third party", "subrogation", "assume she", "assume he", "i assume",
)
LITIGATION = ("filed suit", "lawsuit filed", "attorney retained", "counsel retained", "legal action", "demand letter", "punitive", "bad faith", "complaint filed", "court filing", "class action", "pre-litigation")
AMBIGUOUS = ("liability", "negligence", "damages", "damages sought", "third party")
#: Of a text, beside the snippet, that is searched for context; part of the rule.
CONTEXT_CHARS = 5000
EXCLUDED_NAMES = ("date of birth", "dob", "birth date", "birthdate", "social security", "ssn", "tax id", "ein", "passport", "driver license", "drivers license", "license number", "bank account", "routing number", "credit card", "personal email", "home address", "home phone", "gender", "race", "ethnicity", "marital status", "religion", "salary", "wage rate", "hourly rate")
# Of each pattern the first group is the value, label and all.
PATTERNS = {
    "Claim Number": "\\b(claim\\s*(?:number|no|#)[:\\s#]*([A-Z0-9\\-]{5,20}))",
    "Policy Number": "\\b(policy\\s*(?:number|no|#)[:\\s#]*([A-Z0-9\\-]{5,20}))",
    "Date of Loss": "\\b(date\\s*of\\s*loss[:\\s]*(\\d{1,2}[\\/\\-]\\d{1,2}[\\/\\-]\\d{2,4}|\\w+ \\d{1,2},?\\s*\\d{4}))",
    "Time of Loss": "\\b(time\\s*of\\s*(?:loss|incident)[:\\s]*(\\d{1,2}:\\d{2}\\s*(?:AM|PM|am|pm)?))",
    "Phone Number": "\\b((?:phone|cell|mobile|contact)[:\\s]*(\\(?\\d{3}\\)?[\\s\\-\\.]\\d{3}[\\s\\-\\.]\\d{4}))",
    "Email": "\\b([a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})",
    "Police Report Number": "\\b(police\\s*report\\s*(?:number|no|#)[:\\s#]*([A-Z0-9\\-]{4,20}))",
    "Location of Loss": "\\b((?:location|address|place)\\s*of\\s*(?:loss|incident)[:\\s]*([^\\n]{5,80}))",
    "Adjuster": "\\b(adjuster[:\\s]*([A-Z][a-z]+ [A-Z][a-z]+))",
    "Cause of Loss": "\\b(cause\\s*of\\s*(?:loss|incident)[:\\s]*([^\\n]{3,60}))",
}


def _map(table: Mapping[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def clean_text(v: Column) -> Column:
    """Hard blanks and private glyphs out, runs squeezed, edge punctuation and a lone check-box sign at the start gone."""
    t = F.translate(F.translate(v, " ", " •"), "", "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    t = F.regexp_replace(t, "^[ :.\\n\\t-]+|[ :.\\n\\t-]+$", "")
    return F.trim(F.regexp_replace(t, "^[CBDOX■□●○◆◇▪▫■□•]\\s+", ""))


def risk_category(kind: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    out = F.when(F.try_element_at(_map(CATEGORIES), s).isNotNull(), F.try_element_at(_map(CATEGORIES), s))
    for pattern, category in CATEGORY_WORDS:
        out = out.when(s.rlike(pattern), category)
    return out.otherwise("Exposure Risk")


def severity(level: Column, kind: Column) -> Column:
    """The given level if it is one, else by the signal's type."""
    given = F.initcap(F.trim(level))
    return F.when(given.isin(*LEVELS), given).otherwise(F.coalesce(F.try_element_at(_map(TYPE_LEVELS), kind), F.lit("Low")))


def keyword_confidence(keyword: Column, level: Column, context: Column) -> Column:
    """From a keyword's anchor or its length, weighted by severity, with up to 0.05 for words that the context holds; 0.30 to 0.97."""
    k = F.lower(F.trim(keyword))
    words = F.array_distinct(F.split(k, "\\s+"))
    shape = F.least(F.lit(0.82), 0.40 + 0.12 * F.log1p(F.size(F.split(k, "\\s+"))) + 0.002 * F.least(F.length(k), F.lit(20)))
    base = F.coalesce(F.try_element_at(_map(ANCHORS), k), shape) * F.coalesce(F.try_element_at(_map(LEVEL_WEIGHTS), level), F.lit(1.0))
    shared = F.size(F.array_intersect(words, F.split(F.lower(F.trim(context)), "\\s+"))) / F.greatest(F.size(words), F.lit(1))
    bonus = F.when(F.coalesce(context, F.lit("")) == "", 0.0).otherwise(0.05 * shared)
    return F.bround(F.least(F.lit(0.97), F.greatest(F.lit(0.30), base + bonus)), 2)


def effective_confidence(confidence: Column, boxed: Column) -> Column:
    return F.when(confidence > 0, confidence).when(boxed, 0.85).otherwise(0.0)


def covers_too_much(polygon: Column, width: Column, height: Column, share: float = 0.25) -> Column:
    """Whether the bounding box of an array of (x, y) takes more than its share of the page."""
    span = lambda axis: F.array_max(F.transform(polygon, lambda p: p[axis])) - F.array_min(F.transform(polygon, lambda p: p[axis]))
    return F.coalesce(span("x") * span("y") / (width * height) > share, F.lit(False))


def is_excluded(field: Column) -> Column:
    """Names of personal and demographic columns."""
    return F.lower(F.replace(field, F.lit("_"), F.lit(" "))).rlike("|".join(EXCLUDED_NAMES))


def has_keys(result: Column, keys: Sequence[str]) -> Column:
    missing = F.filter(F.array(*(F.lit(k) for k in keys)), lambda k: ~F.map_contains_key(result, k))
    return F.when(result.isNull(), "not a record").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))


def typed_patterns(docs: DataFrame, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """(doc_id, field, value, confidence) of each pattern's first match with two characters at least; the first group is the value."""
    found = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_replace(F.trim(F.regexp_extract("text", f"(?i){p}", 1)), "[.,;]+$", "").alias("value")) for f, p in patterns.items()))
    hits = docs.select("doc_id", F.explode(F.filter(found, lambda x: F.length(x["value"]) >= 2)).alias("x"))
    return hits.select("doc_id", "x.field", "x.value", F.lit(0.92).alias("confidence"))


def reclassify(signals: DataFrame, docs: DataFrame) -> DataFrame:
    """Ambiguous legal triggers become recovery signals where the context tells of a third party's fault and of no litigation."""
    joined = signals.join(one_text(docs).select("doc_id", F.lower(F.left("text", F.lit(CONTEXT_CHARS))).alias("start")), "doc_id")
    context = F.concat_ws(" ", F.lower("snippet"), "start")
    holds = lambda phrases: F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(context, p))
    turn = (F.col("type") == "legal_escalation") & F.lower(F.trim("keyword")).isin(*AMBIGUOUS) & holds(THIRD_PARTY) & ~holds(LITIGATION)
    return joined.select("doc_id", "keyword", "snippet", F.when(turn, "recovery_subrogation").otherwise(F.col("type")).alias("type"), F.when(turn, "High").otherwise(F.col("severity")).alias("severity"), turn.alias("reclassified"))


def merge_layers(signals: DataFrame) -> DataFrame:
    """Signals (doc_id, layer: model, enriched or keyword, ord, type, keyword) without those that an earlier one covers.

    Model before enriched before keyword; a signal repeats one of the same type and first 30 characters, a keyword one is also
    covered if its first 10 occur in an accepted one of the type. Of signals that repeat each other, or keywords with equal first
    10 characters, only the first can stay, so partial aggregates reduce a document to those; what they still depend on, the order
    within a document and type, is a fold over their array (it grows with the square of a type's accepted signals in one document).
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    key = F.concat(low("type"), F.lit(":"), F.substring(low("keyword"), 1, 30))
    listed = F.col("layer") == "keyword"
    order = F.struct(listed.cast("int").alias("rank"), (F.col("layer") != "model").cast("int").alias("later"), F.col("ord").alias("ord"), F.col("keyword").alias("word"))
    s = signals.select("doc_id", low("type").alias("__type"), order.alias("__order"), key.alias("__key"), F.substring(low("keyword"), 1, 10).alias("__start"), listed.alias("__listed"), F.struct(*signals.columns).alias("__row"))
    first = s.groupBy("doc_id", "__type", "__listed", F.when(F.col("__listed"), F.col("__start")).otherwise(F.col("__key")).alias("__same")).agg(F.min_by(F.struct("__order", "__key", "__start", "__listed", "__row"), "__order").alias("x"))
    own = first.groupBy("doc_id", "__type").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast(f"array<{signals.select(F.struct(*signals.columns).alias('r')).schema['r'].dataType.simpleString()}>").alias("rows"))

    def accept(acc: Column, x: Column) -> Column:
        covered = x["__listed"] & (x["__start"] != "") & F.exists(acc["keys"], lambda k: F.contains(k, x["__start"]))
        return F.when(covered | F.array_contains(acc["keys"], x["__key"]), acc).otherwise(F.struct(F.array_append(acc["keys"], x["__key"]).alias("keys"), F.array_append(acc["rows"], x["__row"]).alias("rows")))

    return own.select(F.explode(F.aggregate("xs", start, accept, lambda acc: acc["rows"])).alias("r")).select("r.*")


def ocr_index(entries: DataFrame) -> DataFrame:
    """The surest entry of each (doc_id, field) over the pages, the first on ties."""
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("confidence"), "page", "pos")
    return entries.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def coverage(fields: DataFrame) -> DataFrame:
    """Fields of each document: all, matched by OCR, with a box, edited."""
    return fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields"), F.count_if("matched").alias("matched"), F.count_if("boxed").alias("boxed"), F.count_if("edited").alias("edited"))


def label_rules(docs: DataFrame, dictionary: Mapping[str, Sequence[str]], otherwise: str = "General") -> DataFrame:
    """The label whose keywords a text holds the largest share of, the first on ties, and those found."""
    low = F.lower("text")
    found = lambda words: F.filter(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(low, w))
    each = F.array(*(F.struct((F.size(found(words)) / len(words)).alias("share"), F.lit(-i).alias("o"), F.lit(label).alias("label"), found(words).alias("found")) for i, (label, words) in enumerate(dictionary.items())))
    best = docs.select("doc_id", F.array_max(each).alias("b"))
    some = F.col("b.share") > 0
    return best.select("doc_id", F.when(some, F.col("b.label")).otherwise(otherwise).alias("label"), F.round("b.share", 4).alias("share"), F.array_join("b.found", ",").alias("found"))


def dictionary_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("doc_type", "kind").agg(F.count(F.lit(1)).alias("n"))


def field_list(first: DataFrame, second: DataFrame) -> DataFrame:
    """Names (name, ord) of both lists in order, each once, the first list's before the second's."""
    both = first.select("name", F.lit(0).alias("p"), "ord").unionByName(second.select("name", F.lit(1).alias("p"), "ord"))
    kept = both.groupBy("name").agg(F.min(F.struct("p", "ord")).alias("at"))
    return kept.select("name", F.col("at.p").alias("part"), F.col("at.ord").alias("ord"))


def merge_sources(strong: DataFrame, weak: DataFrame) -> DataFrame:
    """Fields (doc_id, name, value) of the stronger source, then those of the weaker whose name, case aside, it lacks."""
    key = F.upper(F.trim("name")).alias("k")
    rest = weak.withColumn("k", key).join(strong.select("doc_id", key).distinct(), ["doc_id", "k"], "left_anti").select(*strong.columns)
    return strong.unionByName(rest)


CHECK_NAMES = ("check number", "check no", "check #", "check num", "cheque number", "cheque no")
ID_NAMES = ("claim id", "claim_id", "claimid", "claim number", "claim no", "claim #", "claim ref", "claim reference", "file number", "record id", "clm id", "clm no", "clm#", "loss ref", "file num", "file #", "filenum")


#: Least share of words that a column's name has in common with a name that is sought.
ID_LIKENESS, KEY_LIKENESS = 0.55, 0.6
#: Place of fields that hold no claim's id.
NO_PLACE = 9


def _words(name: str) -> list[str]:
    """``name_tokens`` of a constant."""
    return list(dict.fromkeys(w for w in re.split(r"\s+", re.sub("[_/#+]", " ", name.lower()).strip()) if len(w) > 1 and w not in STOPWORDS))


def _likeness(name: Column, words: Sequence[str]) -> Column:
    """The best similarity of a name to one of several; the name is cut into words once, the others beforehand."""
    each = sorted({tuple(_words(w)) for w in words})
    return F.transform(F.array(name_tokens(name)), lambda t: F.greatest(F.lit(0.0), *(token_similarity(t, F.array(*(F.lit(x) for x in w)).cast("array<string>")) for w in each)))[0]


def claim_ids(fields: DataFrame) -> DataFrame:
    """(sheet, rec, claim_id, stage): 0 from a check number, else 1 from a column named like an id, else 2 from a value that looks like one, else 3 the record's number.

    A column is named like an id if its name holds one of ``ID_NAMES``; after those, if it shares enough words with one.
    """
    name, v = F.trim(F.replace(F.lower("field"), F.lit("_"), F.lit(" "))), F.trim("value")
    holds = lambda words: reduce(lambda a, b: a | b, (F.contains(name, F.lit(w)) for w in words))
    alike = (F.length(v) >= 2) & (_likeness(name, ID_NAMES) >= ID_LIKENESS)
    # only names with a word of an id's name are compared: without one the likeness is 0
    worded = F.concat(F.lit(" "), F.translate(name, "/#+\t\n\x0b\x0c\r", " " * 8), F.lit(" ")).rlike(" (?:" + "|".join(sorted({re.escape(t) for w in ID_NAMES for t in _words(w)})) + ") ")
    like_id = v.rlike("(?i)^[A-Z]{2,5}[-_]?[A-Z0-9]{2,15}$") & v.rlike("[0-9]")
    place = F.when(v.isNull() | (v == ""), NO_PLACE).when(holds(CHECK_NAMES), 0).when(holds(ID_NAMES), 1).when(worded & alike, 2).when(like_id, 3).otherwise(NO_PLACE)
    best = fields.groupBy("sheet", "rec").agg(F.min(F.struct(place.alias("place"), "pos", "value")).alias("b")).select("sheet", "rec", "b.place", "b.value")
    found = F.col("place") < NO_PLACE
    claim_id = F.when(found, F.col("value")).otherwise((F.col("rec") + 1).cast("string"))
    stage = F.when(~found, 3).when(F.col("place") < 2, F.col("place")).otherwise(F.col("place") - 1)
    return best.select("sheet", "rec", claim_id.alias("claim_id"), stage.alias("stage"))


def lookup_value(fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first filled value of each record whose column holds or is held by one of the names, else shares enough words with one; names before columns in order."""
    low = F.lower("field")
    at = F.coalesce(*(F.when(F.contains(low, F.lit(k.lower())) | F.contains(F.lit(k.lower()), low), i) for i, k in enumerate(keys)), *(F.when(_likeness(low, [k]) >= KEY_LIKENESS, len(keys) + i) for i, k in enumerate(keys)))
    w = Window.partitionBy("sheet", "rec").orderBy("at", "pos")
    found = fields.withColumn("at", at).filter("at IS NOT NULL AND value <> ''")
    return found.withColumn("r", F.row_number().over(w)).filter("r = 1").select("sheet", "rec", "field", "value")


def rule_signals(docs: DataFrame, as_of: Column, min_words: int = 30, min_fields: int = 3) -> DataFrame:
    """Rule signals of documents (doc_id, text, fields map): dates ahead or over 30 years back, February 29 in common years, few fields, few words."""
    dates = F.map_entries(F.map_filter(F.transform_values("fields", lambda k, v: S.parse_date(v)), lambda k, v: v.isNotNull() & k.rlike("(?i)date")))
    signal = lambda name, level, evidence: F.struct(name.alias("signal"), F.lit(level).alias("severity"), evidence.alias("evidence"))
    ahead = F.transform(F.filter(dates, lambda e: (e["value"] > as_of) & ~e["key"].rlike("(?i)expir")), lambda e: signal(F.concat(e["key"], F.lit(" in future")), "High", e["value"].cast("string")))
    old = F.transform(F.filter(dates, lambda e: F.year(e["value"]) < F.year(as_of) - 30), lambda e: signal(F.concat(e["key"], F.lit(" unusually old")), "Moderate", e["value"].cast("string")))
    year = F.regexp_extract("text", "(?i)feb(?:ruary|\\.)?\\s+29(?:th)?,?\\s+([0-9]{4})", 1).try_cast("int")
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    one = lambda cond, s: F.when(cond, F.array(s)).otherwise(F.array().cast("array<struct<signal:string,severity:string,evidence:string>>"))
    words = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    every = F.concat(
        ahead, old, one(year.isNotNull() & ~leap, signal(F.lit("invalid february 29"), "Highly Severe", year.cast("string"))),
        one(F.size("fields") < min_fields, signal(F.lit("few fields"), "Moderate", F.size("fields").cast("string"))), one(words < min_words, signal(F.lit("few words"), "Low", words.cast("string"))),
    )
    return docs.select("doc_id", F.explode(every).alias("s")).select("doc_id", "s.*")
