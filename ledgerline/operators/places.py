"""Places on pages: boxes of polygons, and OCR fields merged into those of the page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD = "struct<pos:int,name:string,value:string,confidence:double,polygon:array<struct<x:double,y:double>>,source:string>"


def merged_box(a: Column, b: Column) -> Column:
    """The corners of the box around two polygons, arrays of (x, y); null if neither has points."""
    points = F.concat(F.coalesce(a, F.array().cast("array<struct<x:double,y:double>>")), F.coalesce(b, F.array().cast("array<struct<x:double,y:double>>")))
    end = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
    x0, x1, y0, y1 = end(F.array_min, "x"), end(F.array_max, "x"), end(F.array_min, "y"), end(F.array_max, "y")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when(F.size(points) > 0, F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def enriched_fields(text_fields: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, page, ord, name, value, confidence, polygon, source) of pages: the text's fields, then OCR fields under new names.

    Both: doc_id, page, pos, name, value, confidence, polygon. An OCR field whose name, case aside, is there already lifts the first
    field whose name holds or is held by its own: to its confidence, if above 0, and to its polygon, if there was none. A page's
    fields are one array, dozens of them.
    """
    low = lambda name: F.lower(F.trim(F.coalesce(name, F.lit(""))))
    norm = lambda name: F.trim(F.regexp_replace(low(name), "[\\s:]+", " "))
    listed = lambda df, source: df.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "name", "value", F.col("confidence").cast("double").alias("confidence"), "polygon", F.lit(source).alias("source")))).cast(f"array<{_FIELD}>").alias(source))
    both = listed(text_fields, "text").join(listed(ocr, "ocr"), ["doc_id", "page"], "full_outer")
    none = F.array().cast(f"array<{_FIELD}>")

    def add(acc: Column, f: Column) -> Column:
        known = F.exists(acc, lambda e: low(e["name"]) == low(f["name"]))
        meant = F.array_position(F.transform(acc, lambda e: (norm(e["name"]) == norm(f["name"])) | F.contains(norm(f["name"]), norm(e["name"])) | F.contains(norm(e["name"]), norm(f["name"]))), F.lit(True))
        lifted = F.transform(acc, lambda e, i: F.when(i + 1 == meant, F.struct(e["pos"].alias("pos"), e["name"].alias("name"), e["value"].alias("value"), F.when(f["confidence"] > 0, f["confidence"]).otherwise(e["confidence"]).alias("confidence"), F.coalesce(e["polygon"], f["polygon"]).alias("polygon"), e["source"].alias("source"))).otherwise(e))
        return F.when(known, lifted).otherwise(F.array_append(acc, f))

    merged = both.select("doc_id", "page", F.aggregate(F.coalesce("ocr", none), F.coalesce("text", none), add).alias("fs"))
    return merged.select("doc_id", "page", F.posexplode("fs").alias("ord", "f")).select("doc_id", "page", "ord", "f.name", "f.value", "f.confidence", "f.polygon", "f.source")
