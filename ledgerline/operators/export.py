"""Nested JSON documents from records in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(entries: Column, key: str = "field") -> Column:
    """Entries without those whose key comes again later: a map takes each key once."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x[key] == e[key]))


def record_maps(fields: DataFrame) -> DataFrame:
    """(sheet, rec, claim_id, fields): the filled values of a record as a map in column order; of a field that comes twice the last."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "field", "value")))
    filled = fields.filter("trim(value) <> ''")
    return filled.groupBy("sheet", "rec", "claim_id").agg(F.map_from_entries(F.transform(last_of_each(entries), lambda e: F.struct(e["field"], e["value"]))).alias("fields"))


def standard_documents(fields: DataFrame) -> DataFrame:
    """One JSON document a record, with its sheet."""
    m = record_maps(fields)
    return m.select("sheet", "rec", F.to_json(F.struct("claim_id", "fields")).alias("document"))


def split_documents(fields: DataFrame, financial: Sequence[str], currency: str = "USD") -> DataFrame:
    """One JSON document a record with its amounts apart from the other fields."""
    m = record_maps(fields)
    amounts = F.map_filter("fields", lambda k, v: k.isin(*financial))
    others = F.map_filter("fields", lambda k, v: ~k.isin(*financial))
    return m.select("sheet", "rec", F.to_json(F.struct("claim_id", others.alias("fields"), amounts.alias("financials"), F.lit(currency).alias("currency"))).alias("document"))


def transaction_documents(fields: DataFrame, kind: str = "UPDATE") -> DataFrame:
    """One JSON transaction a record, each filled field with whether it was edited; ``original`` is null for those that weren't."""
    value = F.struct("value", F.col("original").isNotNull().alias("edited"), F.col("original").alias("originalValue"))
    entries = F.array_sort(F.collect_list(F.struct("pos", "field", value.alias("v"))))
    m = fields.filter("trim(value) <> ''").groupBy("sheet", "rec").agg(F.map_from_entries(F.transform(last_of_each(entries), lambda e: F.struct(e["field"], e["v"]))).alias("claim"))
    return m.select("sheet", "rec", F.to_json(F.struct(F.lit(kind).alias("transactionType"), "claim")).alias("document"))


def sheet_summary(fields: DataFrame, totals: DataFrame) -> DataFrame:
    """(sheet, record_count, totals as JSON): what heads a sheet's documents; records themselves aren't gathered."""
    t = totals.groupBy("sheet").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.col("total").cast("string")))))).alias("totals"))
    return fields.groupBy("sheet").agg(F.count_distinct("rec").alias("record_count")).join(t, "sheet", "left")


def sheet_metadata(titles: Mapping[str, Column], regions: Column) -> Column:
    """Title fields first, then regions that they lack; blanks out."""
    first = F.create_map(*(x for k, v in titles.items() for x in (F.lit(k), v)))
    filled = F.map_filter(first, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return F.map_concat(filled, F.map_filter(regions, lambda k, v: ~F.map_contains_key(filled, k) & (F.trim(v) != "")))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select("document").write.text(path)
