"""Whether a document's text bears out what was found in it. Nothing is dropped; what the text doesn't bear out keeps a low confidence.

The entities or signals of a document come to its text's row as one array, dozens of them, and are tested there; texts are
neither repeated nor crossed with words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EXEMPT_NAMES = (
    "severity", "litigation risk", "fraud indicator", "recommended next step", "coverage concern", "estimated loss amount", "medical complexity", "risk appetite score", "bind / decline recommendation",
    "cat exposure flag", "adequacy ratio", "estimated annual premium", "loss ratio trend", "referral required", "pricing adequacy",
)
CLEAN_SOURCES = ("txt", "html")
PLAIN_WORDS = ("signal", "detected", "identified", "document", "indicates", "referenced", "mentioned", "present", "reported", "found", "noted")
TYPE_WORDS = {
    "severity": ("injur", "pain", "fractur", "surg", "hospital", "fatal", "death", "disab", "trauma", "loss"),
    "legal_escalation": ("attorney", "lawyer", "lawsuit", "court", "legal", "litigat", "demand", "complaint", "counsel"),
    "litigation_exposure": ("attorney", "lawyer", "lawsuit", "court", "legal"),
    "fraud_indicator": ("inconsist", "suspic", "staged", "false", "fraud", "misrepresent", "conflict", "unusual"),
    "medical_complexity": ("surg", "hospital", "therapy", "specialist", "chronic", "treatment", "procedure", "medic"),
    "recovery_subrogation": ("third party", "subroga", "vendor", "contractor", "liable", "recover", "upstream"),
    "coverage_adequacy": ("exclusion", "limit", "denial", "reserv", "gap", "underinsur", "coverage"),
    "coverage_issue": ("exclusion", "denial", "reserv", "coverage"),
    "risk_severity": ("injur", "loss", "damage", "severe", "hazard"),
    "risk_appetite": ("non-renew", "disclose", "incomplete", "expir"),
}
CAP, HALF, QUARTER, THIRD = 0.45, 0.50, 0.25, 0.30
_WHITE = " \t\n\x0b\x0c\r"


def _strip(v: Column) -> Column:
    return F.trim(F.coalesce(v, F.lit("")), F.lit(_WHITE))


def _words(v: Column, least: int) -> Column:
    return F.array_distinct(F.filter(F.split(v, "\\s+"), lambda w: F.length(w) >= least))


def _share(words: Column, of: Column, least: float) -> Column:
    """Whether so large a share of the words, of which there are some, is among those of the text."""
    return (F.size(words) > 0) & (F.size(F.array_intersect(words, of)) >= least * F.size(words))


def _beside_text(rows: DataFrame, docs: DataFrame, order: str) -> DataFrame:
    """(doc_id, __xs, source, low): each document's rows as an array beside its text; of a repeated document the least text."""
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rows.columns if c not in ("doc_id", order))))).alias("__xs"))
    source = F.min("source") if "source" in docs.columns else F.lit(None).cast("string")
    texts = docs.groupBy("doc_id").agg(F.min("text").alias("text"), source.alias("source"))
    return own.join(texts, "doc_id", "left").select("doc_id", "__xs", "source", F.lower(F.coalesce("text", F.lit(""))).alias("low"))


def _told(tested: DataFrame, columns: list[str], order: str) -> DataFrame:
    each = tested.select("doc_id", F.explode("__xs").alias("x"))
    sure = F.when(F.col("x.ok"), F.col("x.row.confidence")).otherwise(F.least(F.coalesce("x.row.confidence", F.lit(0.5)), F.lit(CAP)))
    return each.select("doc_id", *(sure.alias(c) if c == "confidence" else F.col(f"x.row.{c}") for c in columns if c != "doc_id"), F.col("x.ok").alias("verified"))


def verified_entities(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities (doc_id, pos, name, value, confidence) with ``verified``; ``docs`` (doc_id, source, text).

    Verified: in documents of clean text, under an assessed name, values below two characters, verbatim, by half of the words of
    three characters or more, or by a run of four digits or more. The rest has a confidence of ``CAP`` at most.
    """
    bare = lambda t: F.regexp_replace(t, "[^\\p{L}\\p{N}_\\s]", " ")
    d = _beside_text(entities, docs, "pos").withColumns({"words": F.array_distinct(F.split(bare(F.col("low")), "\\s+")), "digits": F.regexp_replace("low", "[^0-9]", "")})

    def ok(e: Column) -> Column:
        v = F.lower(_strip(e["value"]))
        digits = F.regexp_replace(v, "[^0-9]", "")
        exempt = F.exists(F.array(*(F.lit(n) for n in EXEMPT_NAMES)), lambda n: F.contains(F.lower(e["name"]), n))
        borne = F.contains(F.col("low"), v) | _share(_words(bare(v), 3), F.col("words"), HALF) | ((F.length(digits) >= 4) & F.contains(F.col("digits"), digits))
        return F.coalesce(F.col("source").isin(*CLEAN_SOURCES), F.lit(False)) | exempt | (F.length(v) < 2) | borne

    tested = d.withColumn("__xs", F.transform("__xs", lambda e: F.struct(e.alias("row"), ok(e).alias("ok"))))
    return _told(tested, entities.columns, "pos")


def verified_signals(signals: DataFrame, docs: DataFrame) -> DataFrame:
    """Signals (doc_id, pos, type, keyword, description, snippet, confidence) with ``verified``; ``docs`` (doc_id, text).

    By the snippet (verbatim or a quarter of its words), the keyword (with or without its dashes), one of the keyword's words, a
    third of the description's words, or a word of the type. Signals of documents without text stay as they are.
    """
    d = _beside_text(signals, docs, "pos").withColumn("words", F.array_distinct(F.split("low", "\\s+")))
    hints = F.create_map(*(x for k, own in TYPE_WORDS.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in own)))))

    def ok(s: Column) -> Column:
        low, words = F.col("low"), F.col("words")
        snippet, trigger, told = (F.lower(_strip(s[c])) for c in ("snippet", "keyword", "description"))
        by_snippet = (F.length(snippet) >= 3) & (F.contains(low, snippet) | _share(_words(snippet, 3), words, QUARTER))
        plain = _strip(F.regexp_replace(trigger, "[—\\-–]", " "))
        by_trigger = (trigger != "") & (F.contains(low, trigger) | F.contains(low, plain) | F.arrays_overlap(_words(trigger, 4), words))
        by_words = _share(F.filter(_words(told, 5), lambda w: ~w.isin(*PLAIN_WORDS)), words, THIRD)
        by_type = F.exists(F.coalesce(F.try_element_at(hints, F.lower(s["type"])), F.array().cast("array<string>")), lambda w: F.contains(low, w))
        return (low == "") | by_snippet | F.coalesce(by_trigger, F.lit(False)) | by_words | by_type

    tested = d.withColumn("__xs", F.transform("__xs", lambda s: F.struct(s.alias("row"), ok(s).alias("ok"))))
    return _told(tested, signals.columns, "pos")
