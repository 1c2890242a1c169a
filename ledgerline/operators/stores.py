"""Keyed tables: lookups, upserts, deletes, latest rows, and the hashes that key them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.standardize import fold_punctuation

if TYPE_CHECKING:
    from ledgerline.operators.keyed_store import KeyedTable


def filtered(table: DataFrame, condition: Column | str, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows that meet a condition; a limit needs an order."""
    if limit is not None and not order:
        raise ValueError("a limit needs an order")
    out = table.filter(condition)
    return out if limit is None else out.orderBy(*order).limit(limit)


def count_where(table: DataFrame, condition: Column | str) -> DataFrame:
    return table.filter(condition).agg(F.count(F.lit(1)).alias("n"))


def append(rows: DataFrame, path: str) -> None:
    """One commit for the whole batch."""
    rows.write.mode("append").parquet(path)


def lookup(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_semi")


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; ties must be broken by it."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def upsert(table: DataFrame, source: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``table`` with the rows of ``source``, of which the first of each key in ``order`` counts."""
    new = latest(source, key, order)
    return new.select(*table.columns).unionByName(table.join(new.select(*key), list(key), "left_anti"))


def write_version(table: DataFrame, root: str, version: int) -> str:
    """Writes a new version beside those that may still be read; returns its path."""
    path = f"{root}/v{version:09d}"
    table.write.mode("errorifexists").parquet(path)
    return path


def delete_keys(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def statistics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(store, rows) of each table, in one job."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("store"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def sheet_hash(values: DataFrame, sheet: str, value: str, end: str = "\0") -> DataFrame:
    """SHA-256 of a sheet's filled values in code-point order, each followed by ``end``; row order plays no part."""
    filled = values.select(sheet, F.trim(value).alias("v")).filter("v <> ''")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda x: F.concat(x, F.lit(end))), "")
    return filled.groupBy(sheet).agg(F.sha2(listed, 256).alias("sheet_hash"))


def seen_files(files: DataFrame, store: DataFrame) -> DataFrame:
    """Files with whether their content was seen, when first and under which name."""
    old = store.select("file_hash", F.col("filename").alias("first_name"), "first_seen")
    return files.join(old, "file_hash", "left").withColumn("duplicate", F.col("first_seen").isNotNull())


def register_files(files: DataFrame, store: DataFrame) -> DataFrame:
    """The store with the unseen files added."""
    new = files.join(store.select("file_hash"), "file_hash", "left_anti")
    return store.unionByName(latest(new, ["file_hash"], [F.col("first_seen"), F.col("filename")]).select(*store.columns))


def sheet_duplicates(sheets: DataFrame) -> DataFrame:
    """Sheets whose hash another file has, with the file that was seen last among those (the smallest name on ties).

    One aggregation and one join back: files are never paired.
    """
    w = sheets.groupBy("sheet_hash", "file").agg(F.max("first_seen").alias("seen"))
    ranked = w.withColumn("r", F.row_number().over(Window.partitionBy("sheet_hash").orderBy(F.desc("seen"), "file"))).filter("r <= 2")
    best = ranked.groupBy("sheet_hash").agg(F.max(F.when(F.col("r") == 1, F.col("file"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("file"))).alias("two")).filter("two IS NOT NULL")
    return sheets.join(best, "sheet_hash").select("file", "sheet", "sheet_hash", F.when(F.col("one") == F.col("file"), F.col("two")).otherwise(F.col("one")).alias("other"))


def save_parsed(table: KeyedTable, sheets: DataFrame, token: str | None = None) -> int:
    """Parsed sheets (sheet_hash, sheet_name, saved_at, data) under the hash of their content, punctuation folded; the last save of a hash counts."""
    return table.upsert(sheets.withColumn("data", fold_punctuation(F.col("data"))), [F.desc("saved_at"), F.col("sheet_name"), F.col("data")], token)


def load_parsed(table: KeyedTable, hashes: DataFrame) -> DataFrame:
    """``hashes`` (sheet_hash, ...) with what was saved under each, and whether anything was."""
    saved = table.read().select("sheet_hash", "sheet_name", "saved_at", "data", F.lit(True).alias("__hit"))
    return hashes.join(saved, "sheet_hash", "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


EXPORTS = "dup_key string, filename string, sheet string, export_type string, export_time string, record_count long, record_json string"


def append_exports(table: KeyedTable, entries: DataFrame, token: str | None = None) -> int:
    """Exports (filename, sheet, export_type, export_time, record_count, record_json), one row for each file, sheet and type: the newest."""
    name = lambda c: F.coalesce(c, F.lit(""))
    keyed = entries.withColumn("dup_key", F.concat_ws("|", name("filename"), name("sheet"), name("export_type"))).withColumn("record_count", F.coalesce(F.col("record_count").cast("long"), F.lit(0)))
    return table.upsert(keyed, [F.desc("export_time"), F.col("record_json")], token)


def read_exports(table: KeyedTable) -> DataFrame:
    """The history as the records tell it; what a record lacks, or a broken one, comes from the columns."""
    told = lambda key, column: F.coalesce(F.get_json_object("record_json", f"$.{key}"), F.col(column).cast("string"))
    return table.read().select("dup_key", told("filename", "filename").alias("filename"), told("sheet", "sheet").alias("sheet"), told("type", "export_type").alias("type"), told("record_count", "record_count").alias("record_count"), told("timestamp", "export_time").alias("timestamp"), F.get_json_object("record_json", "$.cost_metadata.total_cost_usd").alias("cost"))
