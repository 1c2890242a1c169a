"""Texts of parsed documents, the fields that their lines name, and what records tell of the cause of a loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
#: Confidence and pattern of labels and values, each over the whole text; of names that agree the first pattern's first counts.
LABELLED = (
    (0.90, "(?m)^[ \\t]*([A-Za-z][A-Za-z0-9 _./()'&-]{1,54}?)\\s*:\\s+(.+)$"), (0.85, "(?m)^[ \\t]*([A-Za-z][A-Za-z0-9 _./()'&-]{1,54}?)\\s*=\\s+(.+)$"),
    (0.75, "(?m)^[ \\t]*([A-Za-z][A-Za-z0-9 _./()'&-]{2,40})\\s{2,}\\t*([^\\s].+)$"),
)
VERBS = "\\b(is|are|was|were|has|have|had|will|would|should|can|may)\\b"
#: What is one sign in a label's key; the letter s is among them.
KEY_SIGNS = "[\\\\s_\\-]+"
DESCRIPTIONS = (
    "desc|narr|detail|note|comment|descript|loss\\s*desc|allegation|nature|nature.of.claim|nature.of.loss|nature.of.injury|type.of.claim|type.of.loss|cause.of.loss|services.involved|service.type"
    "|injury.type|accident.type|incident.type|claim.type|peril|event.type|description.of.loss|what.happened|loss.description|went.wrong|ouch|incident|gibber|ploop|flibber|boo|thingThat|went|wrong|happened"
)
NO_DESCRIPTIONS = "^(date|claim.?id|claim.?num|claimant|adjuster|insured|paid|incurred|reserve|total|cost|amount|number|id|#)$"
STANDARD_DESCRIPTIONS, SHORT_DATE, CAUSE_NAMES = "description|cause|loss|narrative", "^\\d{1,4}[-/]\\d{1,2}[-/]\\d{2,4}$", "^cause\\s*of\\s*loss$|^cause_of_loss$"
#: Words that call a taxonomy, in order; its labels.
TAXONOMIES = {
    "professional liability": (
        ("prof liab", "professional liab", "e&o", "errors", "fiduciary", "advisory", "malpractice"),
        ("Negligent Advice", "Unsuitable Product Recommendation", "Misrepresentation", "Failure to Execute Instructions", "Breach of Fiduciary Duty", "Conflict of Interest", "Unauthorized Trading", "Due Diligence Failure", "Inadequate Risk Assessment", "Failure to Disclose", "Elder Financial Abuse", "Fraud / Intentional Misrepresentation", "Omission of Material Fact", "Portfolio Mismanagement", "Failure to Supervise", "Other - Professional Liability"),
    ),
    "workers compensation": (
        ("workers comp", "work comp", "wc loss", "injury", "strain", "sprain", "lacerat"),
        ("Strain / Sprain - Back", "Strain / Sprain - Shoulder", "Strain / Sprain - Knee", "Laceration", "Fracture", "Contusion / Bruising", "Slip and Fall", "Trip and Fall", "Repetitive Stress Injury", "Occupational Disease", "Heat / Chemical Exposure", "Electrical Injury", "Crush Injury", "Vehicle Accident - Work Related", "Falling Object", "Equipment Failure", "Other - Workers Comp"),
    ),
    "auto": (
        ("auto", "vehicle", "collision", "motor", "driving", "fleet"),
        ("Rear-End Collision", "Side-Impact Collision", "Head-On Collision", "Single Vehicle Accident", "Pedestrian Strike", "Uninsured Motorist", "Hit and Run", "Backing Accident", "Vehicle Rollover", "Weather-Related Collision", "DUI-Related Accident", "Vehicle Theft", "Vandalism", "Other - Auto"),
    ),
    "property": (
        ("property", "building", "premises", "fire", "water damage", "theft", "hail"),
        ("Fire - Electrical", "Fire - Arson", "Fire - Unknown", "Water Damage - Pipe", "Water Damage - Flood", "Wind / Hail Damage", "Lightning Strike", "Earthquake", "Theft / Burglary", "Vandalism", "Collapse", "Equipment Breakdown", "Mold", "Sinkhole", "Other - Property"),
    ),
    "general": (
        (),
        ("Slip and Fall", "Trip and Fall", "Vehicle Collision", "Rear-End Collision", "Fire - Electrical", "Fire - Arson", "Fire - Unknown", "Theft", "Burglary", "Vandalism", "Water Damage - Flood", "Water Damage - Pipe", "Wind / Hail", "Lightning", "Earthquake", "Product Liability", "Professional Error", "Medical Malpractice", "Assault / Battery", "Equipment Failure", "Explosion", "Repetitive Stress Injury", "Strain / Sprain", "Animal Bite", "Falling Object", "Other"),
    ),
}
_WHITE = " \t\n\x0b\x0c\r"


def _strip(v: Column) -> Column:
    return F.trim(v, F.lit(_WHITE))


def _first(*columns: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def full_text(full: Column, text: Column, content: Column, transcript: Column, pages: Column) -> Column:
    """A document's text: the first of four that is not empty, else its pages under their numbers.

    ``pages``: array of (page_num, page, raw_text, text, content, transcript); a page's text is the first of the last four that is
    not empty, blank pages are left out, and a page without a number has its place among those before it that stay.
    """
    no = F.lit("").cast("string")
    told = F.transform(pages, lambda p: F.struct(F.coalesce(p["page_num"], p["page"]).cast("string").alias("no"), _strip(F.coalesce(_first(p["raw_text"], p["text"], p["content"], p["transcript"]), no)).alias("t")))
    parts = F.aggregate(F.filter(told, lambda p: p["t"] != ""), F.array().cast("array<string>"), lambda acc, p: F.array_append(acc, F.concat(F.lit("[PAGE "), F.coalesce(p["no"], (F.size(acc) + 1).cast("string")), F.lit("]\n"), p["t"])))
    return F.coalesce(_strip(_first(full, text, content, transcript)), F.array_join(parts, "\n\n"), no)


def plausible_label(label: Column) -> Column:
    words = F.size(F.filter(F.split(label, "\\s+"), lambda w: w != ""))
    return (label != "") & (F.length(label) <= 55) & (words <= 7) & label.rlike("^\\p{L}") & ~label.rlike(f"(?i){VERBS}")


def text_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, label, value, confidence) of texts (doc_id, text): ``label: value``, then ``label = value``, then ``label   value``.

    A value may stand on the line below its label. Labels with verbs, of more than 55 characters or seven words, values of more than
    2,000 characters and short values in capitals without a digit don't count.
    """
    def found(k: int, sure: float, pattern: str) -> Column:
        part = lambda g: F.regexp_extract_all("text", F.lit("(?d)" + pattern), g)
        return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b")), lambda x, i: F.struct(F.lit(k).alias("pass"), i.alias("i"), _strip(x["a"]).alias("label"), _strip(x["b"]).alias("value"), F.lit(sure).alias("confidence")))

    each = docs.filter("text IS NOT NULL").select("doc_id", F.explode(F.concat(*(found(k, *x) for k, x in enumerate(LABELLED)))).alias("f")).select("doc_id", "f.*")
    value = F.col("value")
    shouted = (value == F.upper(value)) & (F.size(F.filter(F.split(value, "\\s+"), lambda w: w != "")) <= 4) & ~value.rlike("\\d")
    kept = each.filter(plausible_label(F.col("label")) & (value != "") & (F.length(value) <= 2000) & ~shouted)
    key = F.regexp_replace(F.lower("label"), KEY_SIGNS, "_")
    return kept.groupBy("doc_id", key.alias("k")).agg(F.min_by(F.struct("label", "value", "confidence"), F.struct("pass", "i")).alias("x")).select("doc_id", "x.*")


def taxonomy_of(text: Column) -> Column:
    """The first taxonomy that a word of the text calls, else the general one."""
    low, out = F.lower(text), F
    for name, (words, _) in TAXONOMIES.items():
        if words:
            out = out.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w)), name)
    return out.otherwise("general")


def cause_candidates(fields: DataFrame) -> DataFrame:
    """(sheet, rec, text, taxonomy) of records that tell of a loss and have no clean cause of it yet: what a model is asked about.

    ``fields``: sheet, rec, pos, field, value, modified, standard (the field's standard name or null). Texts of fields that are
    named, or whose standard is named, like a description, in order, with ``|`` between them; too short ones and dates don't count.
    """
    shown = _strip(F.coalesce(_first(F.col("modified"), F.col("value")), F.lit("")))
    named = F.col("field").rlike(f"(?i){DESCRIPTIONS}") & ~F.trim("field").rlike(f"(?i){NO_DESCRIPTIONS}")
    by_standard = F.coalesce(F.col("standard").rlike(f"(?i){STANDARD_DESCRIPTIONS}"), F.lit(False))
    told = (named | by_standard) & (F.length(shown) > 6) & ~shown.rlike(SHORT_DATE)
    clean = F.trim("field").rlike(f"(?i){CAUSE_NAMES}") & (F.length(shown) > 3) & (F.length(shown) < 60) & ~F.contains(shown, F.lit("."))
    texts = F.array_sort(F.collect_list(F.when(told, F.struct("pos", shown.alias("t")))))
    records = fields.groupBy("sheet", "rec").agg(F.array_join(F.transform(texts, lambda x: x["t"]), " | ").alias("text"), F.bool_or(clean).alias("known"))
    asked = records.filter("text <> '' AND NOT known")
    return asked.select("sheet", "rec", "text", taxonomy_of(F.concat_ws(" ", "sheet", "text")).alias("taxonomy"))


def valid_causes(answers: DataFrame) -> DataFrame:
    """Answers (sheet, rec, taxonomy, cause) that name a label of their taxonomy."""
    labels = F.create_map(*(x for name, (_, own) in TAXONOMIES.items() for x in (F.lit(name), F.array(*(F.lit(v) for v in own)))))
    return answers.filter(F.coalesce(F.array_contains(F.try_element_at(labels, F.col("taxonomy")), F.col("cause")), F.lit(False)))
