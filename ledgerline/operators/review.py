"""Reviewing extracted fields: canonical records, where a value comes from, what is wrong with it, whether its name belongs there."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = ("value", "modified", "confidence", "source_type")
LEVELS = ("Highly Severe", "High", "Moderate", "Low")
# Fixed values.
GRAVE = ("fatal", "death", "fatality", "catastrophic", "permanent disab", "punitive", "class action", "multi-party", "fraud confirmed")
LEGAL = ("legal", "litigation", "lawsuit", "severe")
GAPS = ("missing", "gap", "inconsistent", "risk")
FALLBACK_CAUSES = ("other", "n/a", "unknown", "not specified", "not stated", "unspecified", "see narrative", "various")
LONG_FIELDS = ("description", "summary", "narrative", "complaint", "cause of loss", "description of loss", "treatment", "case complaint", "overview")
DATE_FIELDS = ("date", "due date", "date of loss", "date of service", "filing date", "incident date", "report date", "date filed")
NAME_FIELDS = ("patient", "patient name", "claimant", "plaintiff", "defendant", "insured", "policyholder", "provider name", "adjuster", "attorney")
DURATION_FIELDS = ("years in business", "time in business", "years operating", "years established", "business age")
COURT_FIELDS = ("circuit", "division", "docket")
SINGLE_FIELDS = ("circuit", "division", "judge", "status", "category", "docket", "matter type", "practice area")
TALK_VERBS = "is|are|was|were|do|does|can|could|would|should|have|has|had|will|feel|need|want|think|know|see|said|told|asked|fine|safe|right|okay|sure"
MONEY_OR_DATES = "\\$[\\d,]+|\\d{2}/\\d{2}/\\d{2}|Balance|Payment|Charges"
BILLING = ("\\$[\\d,]+\\.\\d{2}", "\\d{2}/\\d{2}/\\d{2}", "Balance", "Payment", "Adjustment")
MONTH_DAY = "\\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\\w*\\s+\\d{1,2}"
QUESTION = "what|when|where|who|why|how|is are|was|were|do|does|did|can|could|would|should|have|has"
DIALOGUE = (
    "are you|can you|do you|is this|i understand|this is|please|thank you|hello|goodbye|okay|ok|sure|absolutely|correct|right|first are|sounds good|makes sense|"
    "go ahead|of course|no problem|let me|i need|i want|i have|i feel|i think|we need|we have"
)
PROSE = "is|was|were|has|have|had|will|would|can|could|caused|suffered|sustained|occurred|happened|resulted|indicates|appears|seems|found|shows|states|reports|provides"


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def canonical_fields(fields: DataFrame, source_type: str, keys: Sequence[str] = ("sheet", "rec", "field")) -> DataFrame:
    """``keys`` with the four canonical columns filled in, and all other columns that are not null, the source type included, as the map ``source_ref``.

    A column of the four that the input lacks counts as null; a confidence that is no number as 0.
    """
    have = set(fields.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    value = F.coalesce(col("value").cast("string"), F.lit(""))
    others = [c for c in fields.columns if c not in (*keys, "value", "modified", "confidence")]
    pairs = F.map_from_arrays(F.array(*(F.lit(c) for c in others)), F.array(*(F.col(c).cast("string") for c in others))) if others else F.create_map().cast("map<string,string>")
    return fields.select(
        *keys, value.alias("value"), F.coalesce(col("modified").cast("string"), value).alias("modified"), F.coalesce(col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(col("source_type"), F.lit(source_type)).alias("source_type"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("source_ref"),
    )


def is_canonical(fields: DataFrame) -> bool:
    return set(CANONICAL) <= set(fields.columns)


def source_label(added: Column, text_file: Column, model: Column, fallback: Column, matched: Column, matched_confidence: Column, searched: Column) -> Column:
    """How a value was found: by hand, in plain text, by the model with or without a place on the page, or by OCR alone. Null flags count as false."""
    added, text_file, model, fallback, matched, searched = (F.coalesce(x, F.lit(False)) for x in (added, text_file, model, fallback, matched, searched))
    sure = F.coalesce(matched_confidence, F.lit(0.0)) > 0
    placed = F.when(matched & sure, "ocr confidence and place").when(matched, "ocr place").when(searched, "text layer place").otherwise("model")
    return F.when(added, "manual").when(text_file, "text").when(model & ~fallback, placed).when(model, "model fallback").when(matched, "ocr").otherwise("ocr raw")


def rule_severity(severity: Column, description: Column, evidence: Column) -> Column:
    """A level as it is, an old name translated, else by the words of description and evidence."""
    given = F.initcap(F.trim(F.coalesce(severity, F.lit(""))))
    old = F.replace(F.lower(given), F.lit(" "), F.lit("_"))
    text = F.lower(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(evidence, F.lit(""))))
    words = F.when(_any(text, GRAVE), LEVELS[0]).when(_any(text, LEGAL), LEVELS[1]).when(_any(text, GAPS), LEVELS[2]).otherwise(LEVELS[3])
    return F.when(given.isin(*LEVELS), given).when(old == "severely_high", LEVELS[0]).when(old == "moderate", LEVELS[2]).when(old == "low", LEVELS[3]).otherwise(words)


def mapping_method(title: Column, embedding: Column, memory: Column, outside: Column, score: Column, subrow: Column) -> Column:
    """The way by which a field got its column; ``score`` is the header's, 0 to 100."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    s = F.coalesce(score, F.lit(0.0))
    by_score = F.when(s >= 90, "exact").when(s >= 65, "fuzzy").when(s > 0, "partial").when(yes(subrow), "sub-row").otherwise("direct")
    return F.when(yes(title), "title row").when(yes(embedding), "embedding").when(yes(memory), "memory").when(yes(outside), "external").otherwise(by_score)


def inferred_cause(method: Column, field: Column, column: Column, value: Column) -> Column:
    """``method``, but external where a cause of loss that was read directly holds one of the model's stopgaps."""
    name = F.lower(field)
    cause = F.contains(name, F.lit("cause of loss")) | F.contains(name, F.lit("cause_of_loss")) | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit("cause"))
    return F.when(cause & (method == "direct") & F.lower(F.trim(value)).isin(*FALLBACK_CAUSES), "external").otherwise(method)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 80, "high").when(confidence >= 50, "medium").otherwise("low")


def value_fault(field: Column, value: Column) -> Column:
    """The first rule that a value breaks for a field of this name, null if it is a plausible value."""
    name, v = F.lower(F.trim(field)), F.regexp_replace(value, "^\\s+|\\s+$", "")
    size = F.length(F.trim(field))
    words = F.filter(F.split(v, "\\s+"), lambda w: w != "")
    n = F.size(words)
    lines = F.filter(F.transform(F.split(v, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    long_ok, several = _any(name, LONG_FIELDS), F.contains(v, F.lit("\n"))
    has = lambda alternatives: v.rlike(f"(?i)\\b({alternatives})\\b")
    billing = sum((v.rlike(f"(?i){p}").cast("int") for p in BILLING), F.lit(0))
    court = v.rlike("^\\d+$") | v.rlike("\\s+\\d+(\\s+\\d+)*\\s*$") | ((n <= 2) & F.forall(words, lambda w: w.rlike("^\\d+$"))) | (n > 4)
    of_court = (F.contains(name, F.lit("circuit")) & (n > 2) | F.contains(name, F.lit("division"))) & F.contains(F.lower(v), F.lit("circuit"))
    rules = (
        ("empty", F.coalesce(v, F.lit("")) == ""), ("short name, talk", (size <= 4) & (n >= 4) & has(TALK_VERBS)), ("lines", several & ~long_ok), ("digit line", (F.size(lines) >= 2) & F.exists(lines, lambda x: x.rlike("^\\d+$"))),
        ("date", _any(name, DATE_FIELDS) & ((F.length(v) > 45) | F.contains(v, F.lit("$")))), ("name", _any(name, NAME_FIELDS) & ((n > 10) | F.contains(v, F.lit("$")) | several | v.rlike(MONEY_OR_DATES))), ("billing", billing >= 3),
        ("long", ~long_ok & (F.length(v) > 300)), ("duration", _any(name, DURATION_FIELDS) & v.rlike("^(19|20)\\d{2}$")), ("court", _any(name, COURT_FIELDS) & (court | of_court)),
        ("several", _any(name, SINGLE_FIELDS) & (several | (F.regexp_count(v, F.lit(f"(?i){MONTH_DAY}")) > 1))), ("one letter", F.length(v) < 2), ("question", v.endswith("?") | v.rlike(f"(?i)^({QUESTION})\\b")), ("dialogue", has(DIALOGUE)),
        ("short name", (size <= 3) & (n >= 4)), ("prose", has(PROSE) & (n >= 4) & ~long_ok), ("short name, long value", (size <= 4) & (n >= 5)),
    )
    return F.coalesce(*(F.when(broken, rule) for rule, broken in rules))


def allowed_names(fields: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Fields (doc_type, name, ...) whose name holds, or is held by, a name that is allowed for the document's type; types without a list keep all."""
    norm = F.trim(F.regexp_replace(F.lower(F.trim("name")), "[\\s\\-_:./]+", " "))
    fits = [(F.col("doc_type") == t) & F.exists(F.array(*(F.lit(w) for w in names)), lambda w: F.contains(norm, w) | F.contains(w, norm)) for t, names in allowed.items() if names]
    free = ~F.coalesce(F.col("doc_type").isin(*(t for t, names in allowed.items() if names)), F.lit(False))
    return fields.filter(reduce(lambda a, b: a | b, fits, free))


#: Words that say nothing about a field's name. Fixed values.
NAME_STOPS = ("a", "of", "to", "in", "on", "by", "at", "id", "no", "the", "and", "or")
VALUE_STOPS = ("the", "and", "for", "from", "with", "that")


def name_key(name: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim(name), "\\([^)]*\\)", "")), ":+$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(bare)), "[\\s\\-_:./]+", "_"), "^_+|_+$", "")


def name_words(key: Column) -> Column:
    """The words of a name's key that say something about it."""
    return F.array_distinct(F.filter(F.split(key, "_"), lambda w: (F.length(w) > 1) & ~w.isin(*NAME_STOPS)))


def name_score(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """Likeness of two name keys, 0 to 1: equal, one in the other, all words of the shorter, or shared words; ``x`` and ``y``: their words, if at hand."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    x, y = name_words(a) if x is None else x, name_words(b) if y is None else y
    shared, least, most = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    jaccard = shared / (F.size(x) + F.size(y) - shared)
    inside = (F.contains(a, b) | F.contains(b, a)) & (short >= 0.6 * long)
    apart = (least == 0) | ~F.arrays_overlap(x, y)
    return F.when(a == b, 1.0).when(long == 0, 0.0).when(inside, short / long).when(apart, 0.0).when((shared == least) & ((least >= 2) | (least / most >= 0.5)), 0.6).when(jaccard >= 0.4, jaccard).otherwise(0.0)


def ocr_matches(entities: DataFrame, ocr: DataFrame) -> DataFrame:
    """Each entity (doc_id, name, value, page) with the OCR field (doc_id, name, value, page, confidence, pos) that is meant, null if none is.

    The best likeness counts, at least 0.5 for names of one or two words and 0.6 for longer ones; among equals
    the entity's page, then the confidence, then the place. No match if both values have words and share none.
    Names meet within their document only.
    """
    tokens = lambda v: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), "[^0-9a-z_\\s]", " "), "\\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*VALUE_STOPS)))
    need = F.when(F.size(F.filter(F.split("a", "_"), lambda w: w != "")) <= 2, 0.5).otherwise(0.6)
    e = entities.select("doc_id", "name", "value", "page", name_key(F.col("name")).alias("a")).withColumns({"x": name_words(F.col("a")), "need": need})
    o = ocr.select("doc_id", *(F.col(c).alias(f"ocr_{c}") for c in ("name", "value", "page", "confidence", "pos")), name_key(F.col("name")).alias("b")).withColumn("y", name_words(F.col("b")))
    met = e.join(o, "doc_id").withColumn("score", name_score(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).filter("score >= need")
    w = Window.partitionBy("doc_id", "name", "value", "page").orderBy(F.desc("score"), F.coalesce(F.col("ocr_page") == F.col("page"), F.lit(False)).desc(), F.desc("ocr_confidence"), "ocr_pos")
    x, y = tokens(F.col("value")), tokens(F.col("ocr_value"))
    best = met.withColumn("r", F.row_number().over(w)).filter("r = 1").filter((F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y))
    found = best.select("doc_id", "name", "value", "page", "ocr_name", "ocr_value", "ocr_confidence", F.round("score", 4).alias("score"))
    left = entities.select("doc_id", "name", "value", "page").alias("l")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("doc_id", "name", "value", "page")]
    return left.join(found.alias("f"), same, "left").select("l.*", "f.ocr_name", "f.ocr_value", "f.ocr_confidence", "f.score")
