"""Claim snapshots: re-ingest check, diffs, and remembered header mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.standardize import normal_header
from ledgerline.operators.export import last_of_each
from ledgerline.operators.stores import latest, upsert


def snapshots(fields: DataFrame, order: Column) -> DataFrame:
    """(claim_id, fields): a map of the filled values of each claim's last record by ``order``; of a field that comes twice the last by ``pos``, if there is one, then by value."""
    last = fields.select("claim_id", "rec", order.alias("__o")).distinct()
    last = latest(last, ["claim_id"], [F.desc("__o")]).select("claim_id", "rec")
    filled = fields.filter(F.trim("value") != "").join(last, ["claim_id", "rec"], "left_semi")
    place = F.col("pos") if "pos" in filled.columns else F.lit(0)
    entries = F.array_sort(F.collect_list(F.struct(place.alias("pos"), "field", F.trim("value").alias("value"))))
    return filled.groupBy("claim_id").agg(F.map_from_entries(F.transform(last_of_each(entries), lambda e: F.struct(e["field"], e["value"]))).alias("fields"))


def map_changes(old: Column, new: Column) -> Column:
    """Array of (field, before, after) of the values that differ, by field."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.struct(F.coalesce(a, F.lit("")).alias("before"), F.coalesce(b, F.lit("")).alias("after")))
    differ = F.map_filter(both, lambda k, v: v["before"] != v["after"])
    return F.array_sort(F.transform(F.map_entries(differ), lambda e: F.struct(e["key"].alias("field"), e["value"]["before"].alias("before"), e["value"]["after"].alias("after"))))


def check_reingest(new: DataFrame, store: DataFrame, ident: Column | None = None) -> DataFrame:
    """Whether each claim was seen, and how many values changed or stayed; ``fields`` maps on both sides.

    ``ident`` gives a new record's claim id, the column ``claim_id`` if left out; records without one are left out.
    """
    if ident is not None:
        new = new.withColumn("claim_id", ident).filter("claim_id <> ''")
    old = store.select("claim_id", F.col("fields").alias("__old"), F.col("filename").alias("prev_filename"))
    joined = new.join(old, "claim_id", "left").withColumn("duplicate", F.coalesce(F.size("__old") > 0, F.lit(False)))
    changes = F.when(F.col("duplicate"), map_changes(F.col("__old"), F.col("fields")))
    out = joined.withColumn("changes", changes)
    changed = F.when(F.col("duplicate"), F.size("changes"))
    return out.select("claim_id", "duplicate", F.when(F.col("duplicate"), F.col("prev_filename")).alias("prev_filename"), changed.alias("changed"), F.when(F.col("duplicate"), F.greatest(F.lit(0), F.size("fields") - changed)).alias("unchanged"), "changes", "fields")


def diff_long(old: DataFrame, new: DataFrame) -> DataFrame:
    """(claim_id, field, before, after) of long-form values that differ, for claims on both sides."""
    a, b = old.select("claim_id", "field", F.trim("value").alias("before")), new.select("claim_id", "field", F.trim("value").alias("after"))
    both = a.join(b, ["claim_id", "field"], "full_outer").select("claim_id", "field", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    known = old.select("claim_id").distinct().join(new.select("claim_id").distinct(), "claim_id", "left_semi")
    return both.filter("before <> after").join(known, "claim_id", "left_semi")


def mapping_keys(columns: DataFrame, schema: str) -> DataFrame:
    return columns.withColumn("mapping_key", F.concat_ws("|", F.lit(schema), normal_header(F.col("source_column"))))


def lookup_mappings(columns: DataFrame, memory: DataFrame, schema: str) -> DataFrame:
    """Columns with what is remembered of them, null if nothing."""
    known = memory.select("mapping_key", "resolved_field", "method", "confidence", "hit_count", "user_corrected")
    return mapping_keys(columns, schema).join(known, "mapping_key", "left")


def remembered_rows(memory: DataFrame, entries: DataFrame, schema: str) -> DataFrame:
    """The memory's rows for entries (source_column, resolved_field, method, confidence), one hit more each; none for what a user corrected."""
    prior = memory.select("mapping_key", F.col("hit_count").alias("__hits"), F.col("user_corrected").alias("__user"))
    new = mapping_keys(entries, schema).join(prior, "mapping_key", "left").filter("NOT coalesce(__user, false)")
    return new.select("mapping_key", F.lit(schema).alias("schema_name"), F.col("source_column").alias("source_column_raw"), normal_header(F.col("source_column")).alias("source_column_normalized"), "resolved_field", "method", "confidence", (F.coalesce("__hits", F.lit(0)) + 1).alias("hit_count"), F.lit(False).alias("user_corrected"))


#: Of two entries for a column the surer one is remembered.
REMEMBERED_FIRST = (F.desc, "confidence"), (F.col, "resolved_field")


def remember_mappings(memory: DataFrame, entries: DataFrame, schema: str) -> DataFrame:
    """The memory with the entries (source_column, resolved_field, method, confidence) added, one hit more each; what a user corrected stays."""
    return upsert(memory, remembered_rows(memory, entries, schema), ["mapping_key"], [f(c) for f, c in REMEMBERED_FIRST])
