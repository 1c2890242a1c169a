"""What a model read from documents, reconciled with what OCR read there: one list of fields a document.

Entities and OCR fields of a document meet in one join on the document, reduced by partial aggregates; the two steps that
depend on the order of a document's fields (filling up, last duplicates) are folds over its array of fields, of which a
document has hundreds, not more. Texts stay in their rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.review import allowed_names, name_key, name_score, name_words, value_fault

# Fixed values.
DIALOGUE = (
    "are you|can you|do you|is this|i understand|this is|please|thank you|hello|goodbye|yes|no sir|no ma'am|okay|ok|sure|absolutely|correct|right|exactly|first|second|third|actually|basically|honestly|"
    "i see|i know|i think|i feel|i need|i want|i have|we need|we have|we can|let me|let us|go ahead|of course|no problem|sounds good|makes sense"
)
PROSE = (
    "is|was|were|has|have|had|will|would|can|could|caused|traced|completed|attached|walk|run|said|told|asked|replied|mentioned|noted|confirmed|suffered|sustained|"
    "occurred|happened|resulted|indicates|appears|seems|found|shows|states|reports|provides|contains"
)
QUESTION = "what|when|where|who|why|how|is|are|was|were|do|does|did|can|could|would|should|have|has"
COMMENTS = "commentary|comment|note|notes|narrative|remarks"
DAMAGE_WORDS = ("dent", "scratch", "broken", "frame", "paint")
DATE_NAMES = ("date filed", "date of loss", "date of report", "incident date", "loss date", "time of loss", "date of incident", "date reported", "filing date", "report date")
EMPTY_VALUES = ("not found", "n/a", "na", "none", "unknown", "not available", "not stated", "not specified", "not provided", "unspecified", "see narrative", "not applicable", "-", "—", "")
VALUE_STOPS = ("the", "and", "for", "from", "with", "that")
#: Name likeness from which equal values count once; share of a page from which a place says nothing; confidence below which prose goes.
SAME_NAME, WHOLE_PAGE, POOR = 0.40, 0.25, 0.15
_WHITE = " \t\n\x0b\x0c\r"
_KEPT = "array<struct<pos:long,name:string,value:string,confidence:double,origin:string,ocr_name:string,placed:boolean,n:string,v:string>>"


def _strip(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")), F.lit(_WHITE))


def _words(v: Column) -> Column:
    return F.filter(F.split(v, "\\s+"), lambda w: w != "")


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def _value_tokens(v: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), "[^0-9a-z_\\s]", " "), "\\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*VALUE_STOPS)))


def plausible_entities(entities: DataFrame) -> DataFrame:
    """Entities (name, value, confidence, is_text) without those whose name or value is talk, a question or a comment; damage texts under one name."""
    v, low = _strip(F.col("value")), F.lower(F.coalesce("value", F.lit("")))
    told = F.contains(F.lower("name"), F.lit("damage")) & (~low.rlike("[0-9]") | _any(low, DAMAGE_WORDS))
    named = entities.filter(F.length(_strip(F.col("name"))) > 2).withColumn("name", F.when(told, "damage description").otherwise(F.col("name")))
    n = F.size(_words(v))
    prose = v.rlike(f"(?i)\\b({PROSE})\\b") & (n >= 3)
    talk = v.rlike(f"(?i)\\b({DIALOGUE})\\b") | v.endswith("?") | v.rlike(f"(?i)^({QUESTION})\\b") | (F.regexp_count(v, F.lit("[.!?]")) >= 2) | ((F.length(_strip(F.col("name"))) <= 3) & (n >= 4)) | prose
    poor = prose & (n >= 4) & (F.coalesce("confidence", F.lit(1.0)) < POOR)
    return named.filter(~F.when(F.coalesce("is_text", F.lit(False)), talk).otherwise(poor) & ~F.col("name").rlike(f"(?i)\\b({COMMENTS})\\b"))


def _placed(polygon: Column, width: Column, height: Column) -> Column:
    """Whether the polygon, points (x, y), is there."""
    return F.coalesce(F.size(polygon) > 0, F.lit(False))


def _wide(polygon: Column, width: Column, height: Column) -> Column:
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.coalesce((F.array_max(x) - F.array_min(x)) * (F.array_max(y) - F.array_min(y)) / F.nullif(width * height, F.lit(0.0)) > WHOLE_PAGE, F.lit(False))


def matched_entities(entities: DataFrame, ocr: DataFrame) -> DataFrame:
    """Entities with the value, confidence and place that OCR gives them.

    The OCR field of the likeliest name, unless both values have words and share none; where its place is none or most of a
    page, the field that ``key_hint`` names; then the first field whose value has the entity's first six words.
    """
    o = ocr.select("doc_id", F.struct("name", "value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), _placed(F.col("polygon"), F.col("page_width"), F.col("page_height")).alias("placed"), _wide(F.col("polygon"), F.col("page_width"), F.col("page_height")).alias("wide"), F.col("pos").cast("long").alias("pos"), name_key(F.col("name")).alias("key")).alias("o"))
    o = o.withColumn("said", name_words(F.col("o.key")))
    need = F.when(F.size(F.filter(F.split("key", "_"), lambda w: w != "")) <= 2, 0.5).otherwise(0.6)
    snippet = F.lower(F.array_join(F.slice(_words(_strip(F.col("value"))), 1, 6), " "))
    own = entities.withColumns({"key": name_key(F.col("name")), "hint": name_key(F.col("key_hint")), "snippet": snippet}).withColumns({"told": name_words(F.col("key")), "need": need})
    met = own.join(o, "doc_id", "left").withColumn("score", name_score(F.col("key"), F.col("o.key"), F.col("told"), F.col("said")))
    score, need = F.col("score"), F.col("need")
    quoted = (F.length("value") > 6) & F.contains(F.lower("o.value"), F.col("snippet")) & F.col("o.placed")
    sure = F.struct(F.col("o.confidence"), -F.col("o.pos"))
    best = met.groupBy(*entities.columns).agg(
        F.max_by("o", F.when(score >= need, F.struct(score.alias("s"), F.col("o.confidence"), -F.col("o.pos")))).alias("m"),
        F.max_by("o", F.when(F.col("o.key") == F.col("hint"), sure)).alias("h"), F.min_by("o", F.when(quoted, F.col("o.pos"))).alias("q"),
    )
    x, y = _value_tokens(F.col("value")), _value_tokens(F.col("m.value"))
    best = best.withColumn("m", F.when((F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y), F.col("m")))
    placed = F.coalesce(F.col("m.placed") & ~F.col("m.wide"), F.lit(False))
    hinted = ~placed & F.coalesce(F.col("h.placed"), F.lit(False))
    by_words = ~placed & ~hinted & F.col("q").isNotNull()
    last = F.when(by_words, F.col("q")).when(hinted, F.col("h")).otherwise(F.col("m"))
    ahead = F.when(F.col("h.confidence").isNotNull() & hinted & (F.col("h.confidence") > 0), F.col("h.confidence")).when(F.col("m.confidence") > 0, F.col("m.confidence")).otherwise(F.coalesce("confidence", F.lit(0.0)))
    value = F.when(F.coalesce("value", F.lit("")) == "", F.coalesce(F.nullif(F.col("m.value"), F.lit("")), F.col("value"))).otherwise(F.col("value"))
    confidence = F.when(by_words & (F.col("q.confidence") > 0), F.col("q.confidence")).otherwise(ahead)
    return best.select(*(c for c in entities.columns if c not in ("value", "confidence")), value.alias("value"), confidence.alias("confidence"), F.when(hinted & ~by_words, F.col("key_hint")).otherwise(F.coalesce("m.name", F.when(by_words, last["name"]))).alias("ocr_name"), (placed | hinted | by_words).alias("placed"))


def _field(pos: Column, name: Column, value: Column, confidence: Column, origin: str, ocr_name: Column, placed: Column) -> Column:
    parts = (pos.cast("long").alias("pos"), name.alias("name"), value.alias("value"), confidence.cast("double").alias("confidence"), F.lit(origin).alias("origin"), ocr_name.alias("ocr_name"), placed.alias("placed"))
    return F.struct(*parts, name_key(name).alias("n"), F.lower(_strip(value)).alias("v"))


def reconcile(entities: DataFrame, ocr: DataFrame, docs: DataFrame, allowed: Mapping[str, Sequence[str]], deleted: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, name, value, confidence, origin: model or ocr, ocr_name, placed) of each document.

    ``entities`` (doc_id, pos, name, value, confidence, key_hint); ``ocr`` (doc_id, pos, name, value, confidence, polygon: points,
    page_width, page_height); ``docs`` (doc_id, doc_type, is_text, text), one row a document; ``deleted`` (doc_id, name).
    Entities that are plausible, with what OCR adds, whose dates stand in the text and whose values fit their names; then OCR
    fields that are not covered by the name or the value of a field before them and whose name the document's type allows;
    of fields with one name the first, of fields with one value and like names (``SAME_NAME``) the first.
    """
    kind = docs.select("doc_id", "doc_type", "is_text")
    gone = None if deleted is None else deleted.select("doc_id", "name").distinct()
    keep = lambda df: df if gone is None else df.join(gone, ["doc_id", "name"], "left_anti")
    told = plausible_entities(keep(entities).join(kind, "doc_id")).select("doc_id", "pos", "name", "value", "confidence", "key_hint")
    mine = matched_entities(told, ocr).filter(value_fault(F.col("name"), F.coalesce("value", F.lit(""))).isNull())
    e = mine.groupBy("doc_id").agg(F.array_sort(F.collect_list(_field(F.col("pos"), F.col("name"), F.col("value"), F.col("confidence"), "model", F.col("ocr_name"), F.col("placed")))).alias("e"))
    value = _strip(F.col("value"))
    fit = ocr.withColumn("value", value).filter(~F.lower("value").isin(*EMPTY_VALUES) & value_fault(F.col("name"), F.col("value")).isNull())
    fit = keep(allowed_names(fit.join(kind, "doc_id"), allowed))
    placed = _placed(F.col("polygon"), F.col("page_width"), F.col("page_height")) & ~_wide(F.col("polygon"), F.col("page_width"), F.col("page_height"))
    o = fit.groupBy("doc_id").agg(F.array_sort(F.collect_list(_field(F.col("pos"), F.col("name"), F.col("value"), F.coalesce("confidence", F.lit(0.0)), "ocr", F.col("name"), placed))).alias("o"))
    both = e.join(o, "doc_id", "full_outer").select("doc_id", *(F.coalesce(c, F.array().cast(_KEPT)).alias(c) for c in ("e", "o")))
    text = F.lower(F.coalesce("text", F.lit("")))
    day = lambda f: _strip(F.regexp_replace(f["v"], "\\s+[0-9]{1,2}:[0-9]{2}.*$", ""))
    stands = lambda f: ~_any(F.lower(_strip(f["name"])), DATE_NAMES) | (f["v"] == "") | F.contains(text, f["v"]) | ((F.length(day(f)) >= 4) & F.contains(text, day(f)))
    dated = docs.select("doc_id", "text").join(both, "doc_id").select("doc_id", F.filter("e", stands).alias("e"), "o")
    free = lambda acc, f: ~F.exists(acc, lambda x: (x["n"] == f["n"]) | (x["v"] == f["v"]))
    filled = dated.select("doc_id", F.aggregate("o", F.col("e").cast(_KEPT), lambda acc, f: F.when(free(acc, f), F.array_append(acc, f)).otherwise(acc)).alias("f"))
    start = F.struct(F.array().cast(_KEPT).alias("kept"), F.array().cast("array<string>").alias("names"))

    def first_of_like(acc: Column, f: Column) -> Column:
        same = F.filter(acc["kept"], lambda x: x["v"] == f["v"])
        like = (f["v"] != "") & (F.size(same) > 0) & F.coalesce(name_score(F.get(same, F.size(same) - 1)["n"], f["n"]) >= SAME_NAME, F.lit(False))
        again = (f["v"] != "") & F.array_contains(acc["names"], f["n"])
        names = F.array_append(acc["names"], f["n"])
        return F.when(again, acc).when(like, F.struct(acc["kept"].alias("kept"), names.alias("names"))).otherwise(F.struct(F.array_append(acc["kept"], f).alias("kept"), names.alias("names")))

    once = filled.select("doc_id", F.posexplode(F.aggregate("f", start, first_of_like, lambda acc: acc["kept"])).alias("ord", "f"))
    return once.select("doc_id", "ord", "f.name", "f.value", "f.confidence", "f.origin", "f.ocr_name", "f.placed")
