"""Filters over records in long form: (sheet, rec, claim_id, pos, field, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import standardize as S

PLACEHOLDERS = ("", "not found", "n/a", "na", "none", "null", "unknown", "-", "—")


def search_records(fields: DataFrame, text: str) -> DataFrame:
    """All fields of the records in which any value holds the text, in either case."""
    hits = fields.filter(F.contains(F.lower("value"), F.lit(text.lower()))).select("sheet", "rec")
    return fields.join(hits, ["sheet", "rec"], "left_semi")


def empty_columns(fields: DataFrame) -> DataFrame:
    """(sheet, field) of the columns without a value in any row."""
    empty = F.bool_and(F.coalesce(F.trim("value"), F.lit("")) == "")
    return fields.groupBy("sheet", "field").agg(empty.alias("empty")).filter("empty").drop("empty")


def without_placeholders(fields: DataFrame, words: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    return fields.filter(~F.lower(F.trim("value")).isin(*words))


def low_confidence(fields: DataFrame, threshold: float) -> DataFrame:
    return fields.filter(F.col("confidence") < threshold)


def missing_required(records: DataFrame, fields: DataFrame, required: DataFrame) -> DataFrame:
    """(rec, field) of required fields that a record lacks or holds empty; ``required`` is a small dictionary."""
    wanted = records.select("rec", F.lit(1).alias("__all")).distinct().join(F.broadcast(required.select("field", F.lit(1).alias("__all")).distinct()), "__all").drop("__all")
    return wanted.join(fields.filter(F.trim("value") != "").select("rec", "field"), ["rec", "field"], "left_anti")


def date_order_conflicts(mapped: DataFrame) -> DataFrame:
    """``mapped`` (rec, loss, reported, closed and a confidence of each) with 30 points off for each conflict, 10 left at least."""
    pairs = (("loss", "reported"), ("loss", "closed"), ("reported", "closed"))
    bad = {p: F.coalesce(F.col(p[1]) < F.col(p[0]), F.lit(False)).cast("int") for p in pairs}
    out = mapped
    for name in ("loss", "reported", "closed"):
        k = sum((bad[p] for p in pairs if name in p), F.lit(0))
        out = out.withColumn(f"{name}_confidence", F.when(k == 0, F.col(f"{name}_confidence")).otherwise(F.greatest(F.lit(10), F.col(f"{name}_confidence") - 30 * k)))
    return out


def value_index(fields: DataFrame) -> DataFrame:
    """(field, value in lower case): the claims that hold it, how many, and how sure a repeat is, 0 to 100."""
    held = fields.filter(F.trim("value") != "").select("field", F.lower(F.trim("value")).alias("value"), "claim_id").distinct()
    n = F.col("claims")
    counted = held.groupBy("field", "value").agg(F.count(F.lit(1)).alias("claims"), F.min("claim_id").alias("first_claim"), F.max("claim_id").alias("last_claim"))
    return counted.withColumn("confidence", F.when(n <= 1, 0).otherwise(F.least(F.lit(100), 60 + 10 * n)).cast("int"))


def duplicate_ids(proposed: DataFrame, records: DataFrame) -> DataFrame:
    """Proposed (sheet, rec, new_id) whose id another record of the sheet has."""
    other = records.select(F.col("sheet"), F.col("rec").alias("other"), F.col("claim_id").alias("new_id"))
    return proposed.join(other, ["sheet", "new_id"]).filter("other <> rec").select("sheet", "rec", "new_id").distinct()


def column_totals(fields: DataFrame) -> DataFrame:
    """Sums of the amount columns of each sheet; values that aren't numbers are left out, columns of zeros too."""
    number = S.number_of(F.trim(F.regexp_replace("value", "[,$%]", "")))
    sums = fields.select("sheet", "field", number.alias("n")).filter("n IS NOT NULL")
    return sums.groupBy("sheet", "field").agg(F.sum("n").alias("total"), F.bool_or(F.col("n") != 0).alias("some")).filter("some").drop("some").filter(S.is_financial(F.col("field")))


def totals_with_fallback(explicit: DataFrame, computed: DataFrame) -> DataFrame:
    """A sheet's own totals row if it has one, else the sums."""
    rest = computed.join(explicit.select("sheet").distinct(), "sheet", "left_anti")
    return explicit.withColumn("source", F.lit("row")).unionByName(rest.withColumn("source", F.lit("computed")))


def first_filled(fields: DataFrame) -> DataFrame:
    """The first value that isn't empty of each field over the pages of a document."""
    w = Window.partitionBy("doc_id", "field").orderBy("page", "pos")
    return fields.filter(F.trim("value") != "").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def distinct_fields(fields: DataFrame) -> DataFrame:
    """The first of the fields that agree in name and value, case aside, on a page."""
    w = Window.partitionBy("doc_id", "page", F.lower("field"), F.lower("value")).orderBy("pos")
    return fields.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def overlay_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Fields with the latest edit of each (rec, field): replaced, deleted or added; of edits at one time the last by kind, then by value."""
    w = Window.partitionBy("rec", "field").orderBy(F.desc("edited_at"), F.desc("kind"), F.desc("new_value"))
    last = edits.withColumn("n", F.row_number().over(w)).filter("n = 1").select("rec", "field", "kind", "new_value")
    both = fields.select("rec", "field", "value").join(last, ["rec", "field"], "full_outer")
    return both.filter("kind IS NULL OR kind <> 'delete'").select("rec", "field", F.when(F.col("kind").isNotNull(), F.col("new_value")).otherwise(F.col("value")).alias("value"))


def standard_changes(fields: DataFrame, edits: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Fields whose standardised value differs, as new_value; a user's edits (rec, field) stay as they are."""
    std = fields.withColumn("new_value", S.standard_value(F.col("field"), F.col("value"), statuses))
    return std.filter("new_value <> value AND value <> ''").join(edits.select("rec", "field").distinct(), ["rec", "field"], "left_anti")


def incomplete(mapped: DataFrame, required: DataFrame, threshold: float) -> DataFrame:
    """(rec, field, reason) of mapped fields (rec, field, value, confidence) below the threshold, and of required fields that a record lacks or holds empty."""
    low = low_confidence(mapped, threshold).select("rec", "field", F.lit("low confidence").alias("reason"))
    return low.unionByName(missing_required(mapped, mapped, required).withColumn("reason", F.lit("missing")))


def key_union(*tables: DataFrame) -> DataFrame:
    """The distinct keys of all tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


EXPORT_PLACEHOLDERS = ("not found", "n/a", "na", "none", "unknown", "not available", "not stated", "not specified", "not provided", "unspecified", "see narrative", "not applicable", "-", "—", "")
PHONE = "\\d{3}[\\)\\-\\.\\s]\\s*\\d{3}[\\-\\.\\s]\\d{4}"


def flat_export(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, document): the shown values of a document's fields (doc_id, pos, name, value, modified) as one JSON object, in order.

    An edit (doc_id, name, new_value) goes before the modified value, that before the value. Placeholders, plain yes and no, and
    longer texts that hold a phone number are left out; of a name that comes twice the last counts. Fields of a document are one map.
    """
    from ledgerline.operators.export import last_of_each

    newest = edits.groupBy("doc_id", "name").agg(F.max("new_value").alias("new_value"))
    shown = F.coalesce("new_value", "modified", "value", F.lit(""))
    low = F.lower(F.trim("shown", F.lit(" \t\n\r")))
    each = fields.join(newest, ["doc_id", "name"], "left").withColumn("shown", shown)
    kept = each.filter(~low.isin(*EXPORT_PLACEHOLDERS, "yes", "no", "true", "false") & ~(F.col("shown").rlike(PHONE) & (F.length("shown") > 20)))
    entries = F.array_sort(F.collect_list(F.struct("pos", "name", "shown")))
    return kept.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.transform(last_of_each(entries, "name"), lambda e: F.struct(e["name"], e["shown"])))).alias("document"))
