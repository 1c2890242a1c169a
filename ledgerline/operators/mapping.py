"""Column headers to target fields: similarity, greedy one-to-one mapping, embeddings, cascades."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.standardize import value_quality
from ledgerline.operators.keyed_store import KeyedTable
from ledgerline.operators.snapshots import REMEMBERED_FIRST, lookup_mappings, remembered_rows

STOPWORDS = ("of", "the", "a", "an", "and", "or", "to", "in", "for")  # fixed values
MIN_MATCH = 0.65
#: Score of a column that only an outside map names.
OUTSIDE_SCORE = 0.75


def name_tokens(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[_/#+]", " ")), "\\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def header_scores(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(header, field, score) of the pairs that score above 0: 1 for an alias, else the best similarity to an alias or the field's name.

    ``aliases`` (field, alias) is a dictionary, ``headers`` (header) distinct names. Pairs meet on a shared
    token or the whole alias, so the two sides are never crossed.
    """
    norm = F.trim(F.replace(F.lower("header"), F.lit("_"), F.lit(" ")))
    every = aliases.select("field", F.lower("alias").alias("alias")).union(aliases.select("field", F.lower("field"))).distinct().withColumn("b", name_tokens(F.col("alias")))
    h = headers.select("header", norm.alias("norm")).withColumn("a", name_tokens(F.col("norm")))
    left = h.select("header", "norm", "a", F.explode("a").alias("token"))
    right = every.select("field", "alias", "b", F.explode("b").alias("token"))
    by_token = left.join(F.broadcast(right), "token").select("header", "field", token_similarity(F.col("a"), F.col("b")).alias("score"))
    own = aliases.select("field", F.lower("alias").alias("norm"))
    exact = h.join(F.broadcast(own), "norm").select("header", "field", F.lit(1.0).alias("score"))
    return by_token.union(exact).groupBy("header", "field").agg(F.max("score").alias("score"))


def greedy_mapping(columns: DataFrame, scores: DataFrame, accepted: Sequence[str], least: float = MIN_MATCH, outside: DataFrame | None = None) -> DataFrame:
    """(colset, field, header, score, source): each field in order takes the best column that is left, the first on ties.

    A field without one takes the first column that ``outside`` (header, field), an outside map, has for it,
    taken or not, at ``OUTSIDE_SCORE``. ``columns`` (colset, header, pos) holds the distinct sets of columns;
    a group is one set, at most as long as a sheet is wide.
    """
    known = scores.select("header", "field", "score", F.lit(0).alias("outside"))
    if outside is not None:
        known = known.union(outside.select("header", "field", F.lit(OUTSIDE_SCORE), F.lit(1)).distinct())
    known = known.filter(F.col("field").isin(*accepted) & ((F.col("outside") == 1) | (F.col("score") >= least)))
    place = F.array_position(F.array(*(F.lit(f) for f in accepted)), F.col("field")).cast("int")
    pairs = columns.join(known, "header").select("colset", "field", place.alias("place"), F.struct("outside", (-F.col("score")).alias("below"), "pos", "header").alias("c"))
    fields = pairs.groupBy("colset", "place", "field").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    sets = fields.groupBy("colset").agg(F.array_sort(F.collect_list(F.struct("place", "field", "cs"))).alias("fs"))
    found = "array<struct<field:string,header:string,score:double,source:string>>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(found).alias("found"))

    def take(acc: Column, f: Column) -> Column:
        best = F.get(F.filter(f["cs"], lambda c: (c["outside"] == 1) | ~F.array_contains(acc["used"], c["header"])), F.lit(0))
        one = F.struct(f["field"].alias("field"), best["header"].alias("header"), (-best["below"]).cast("double").alias("score"), F.when(best["outside"] == 1, "outside").otherwise("header").alias("source"))
        return F.when(best.isNull(), acc).otherwise(F.struct(F.array_append(acc["used"], best["header"]).alias("used"), F.array_append(acc["found"], one).alias("found")))

    return sets.select("colset", F.explode(F.aggregate("fs", start, take, lambda acc: acc["found"])).alias("m")).select("colset", "m.*")


def mapped_records(values: DataFrame, mapped: DataFrame, titles: DataFrame, accepted: Sequence[str]) -> DataFrame:
    """Records under their target fields: sheet, rec, field, header, value, header_score, value_score, confidence, source.

    ``values`` (sheet, rec, header, value) are the cells, ``mapped`` the columns of each sheet as
    ``greedy_mapping`` gives them. A field without a column takes the sheet's title value (``titles``: sheet,
    field, value, row_no; one row a field), at a confidence of 95 at most.
    """
    columns = mapped.withColumnRenamed("colset", "sheet")
    cells = values.join(columns, ["sheet", "header"]).select("sheet", "rec", "field", "header", "value", "score", "source")
    free = titles.filter(F.col("field").isin(*accepted)).join(columns, ["sheet", "field"], "left_anti")
    place = F.concat(F.lit("[title row "), F.col("row_no").cast("string"), F.lit("]"))
    banner = values.select("sheet", "rec").distinct().join(free, "sheet").select("sheet", "rec", "field", place.alias("header"), "value", F.lit(1.0).alias("score"), F.lit("title").alias("source"))
    quality, most = value_quality(F.col("value"), F.col("field")), F.when(F.col("source") == "title", 95).otherwise(100)
    each = cells.unionByName(banner).withColumn("quality", quality)
    return each.select(
        "sheet", "rec", "field", "header", "value", F.bround(F.col("score") * 100).cast("int").alias("header_score"), F.bround(F.col("quality") * 100).cast("int").alias("value_score"),
        F.least(most, mapping_confidence(F.col("score"), F.col("quality"))).alias("confidence"), "source",
    )


def mapping_confidence(header_score: Column, quality: Column) -> Column:
    return F.bround(header_score * 40 + quality * 60).cast("int")


def unit_vectors(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def embedding_match(headers: DataFrame, candidates: DataFrame, least: float = 0.75, block: int = 50_000) -> DataFrame:
    """The candidate (candidate, ord, vector) with the largest cosine for each header (header, vector), the smallest ``ord`` on ties; none below ``least``.

    Candidates are sent in blocks of about ``block`` vectors, however many there are; headers meet a block as a matrix product,
    batch by batch, and the blocks' best are compared by header. Scores are rounded to 12 digits before they are compared.
    Without candidates every header has nulls.
    """
    c = candidates.select(F.col("candidate").cast("string").alias("candidate"), F.col("ord").cast("long").alias("ord"), unit_vectors(F.col("vector")).alias("u"))
    h = headers.select("header", unit_vectors(F.col("vector")).alias("u"))
    blocks, context = -(-c.count() // block), headers.sparkSession.sparkContext
    schema = T.StructType([headers.schema["header"], *T.StructType.fromDDL("score double, ord long, candidate string").fields])

    def nearest(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        names, orders, matrix = sent.value
        for b in batches:
            if len(b):
                scores = np.round(np.stack(b.column("u").to_numpy(zero_copy_only=False)) @ matrix.T, 12)
                best = scores.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("header"), pa.array(scores.max(axis=1)), pa.array(orders[best]), pa.array([names[i] for i in best], pa.string())], names=["header", "score", "ord", "candidate"])

    found = h.select("header", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("candidate")) if not blocks else None
    for k in range(blocks):
        rows = list(c.filter(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == k).orderBy("ord").toLocalIterator())
        if rows:
            sent = context.broadcast(([r.candidate for r in rows], np.array([r.ord for r in rows]), np.array([r.u for r in rows], dtype=np.float64)))
            one = h.mapInArrow(lambda batches, sent=sent: nearest(batches, sent), schema)
            found = one if found is None else found.unionByName(one)
    if blocks > 1:
        best = F.max_by(F.struct("score", "candidate"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b")
        found = found.groupBy("header").agg(best).select("header", "b.*")
    return found.select("header", F.when(F.col("score") >= least, F.col("candidate")).alias("candidate"), F.round("score", 3).alias("score"))


def cascade(columns: DataFrame, stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The first stage's answer (header, field, confidence) for each column, with the stage's name."""
    left, out = columns.select("header"), None
    for name, found in stages:
        hit = left.join(found.filter("field IS NOT NULL").select("header", "field", "confidence"), "header").withColumn("method", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select("header"), "header", "left_anti")
    return out


#: Confidence of a column that only an outside map names.
OUTSIDE_CONFIDENCE = 75.0
MEMORY = "mapping_key string, schema_name string, source_column_raw string, source_column_normalized string, resolved_field string, method string, confidence double, hit_count int, user_corrected boolean"


def resolve_columns(memory: KeyedTable, columns: DataFrame, schema: str, candidates: DataFrame, outside: DataFrame, run: str, least: float = 0.75) -> DataFrame:
    """(header, field, confidence, method) of the columns (header, vector) that the memory, embeddings or an outside map (header, field) knows, asked in this order.

    What the later two answer is written back to the memory, in one commit that carries ``run``: the same run again gives the same
    answers, from the memory as it was before, and counts no hit twice. Distinct headers; a user's corrections stay.
    """
    done = memory.committed(run)
    before = memory.read(None if done is None else done - 1)
    known = lookup_mappings(columns.select(F.col("header").alias("source_column")), before, schema).filter("resolved_field IS NOT NULL")
    known = known.select(F.col("source_column").alias("header"), F.col("resolved_field").alias("field"), "confidence")
    near = embedding_match(columns.join(known.select("header"), "header", "left_anti"), candidates, least)
    near = near.select("header", F.col("candidate").alias("field"), F.round(F.col("score") * 100, 1).alias("confidence"))
    told = outside.groupBy("header").agg(F.min("field").alias("field")).withColumn("confidence", F.lit(OUTSIDE_CONFIDENCE))
    resolved = cascade(columns, [("memory", known), ("semantic", near), ("external", told)])
    if done is None:
        entries = resolved.filter("method <> 'memory'").select(F.col("header").alias("source_column"), F.col("field").alias("resolved_field"), "method", "confidence")
        memory.upsert(remembered_rows(before, entries, schema), [f(c) for f, c in REMEMBERED_FIRST], run)
    return resolved


def standard_names(columns: DataFrame, phrases: DataFrame, longest: int = 4, least: int = 8) -> DataFrame:
    """(header, standard): the best phrase among a header's runs of words, 10 a word less its place; ``phrases`` (phrase, standard) is a dictionary."""
    spaced = F.regexp_replace(F.regexp_replace("header", "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^a-zA-Z]+", " ")), " "), lambda w: F.length(w) > 1)
    w = columns.select("header", words.alias("w")).filter(F.size("w") > 0)

    def runs_of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: i <= F.size("w") - n)
        return F.transform(starts, lambda i: F.struct(F.array_join(F.slice("w", i + 1, F.lit(n)), " ").alias("phrase"), (10 * n - i).alias("score"), (i + 100 * n).alias("at")))

    runs = [runs_of(n) for n in range(1, longest + 1)]
    found = w.select("header", F.explode(F.concat(*runs)).alias("r")).select("header", "r.*").join(F.broadcast(phrases), "phrase")
    best = found.groupBy("header", "standard").agg(F.max("score").alias("score"), F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("header").orderBy(F.desc("score"), "at"))
    return best.withColumn("r", rank).filter(f"r = 1 AND score >= {least}").select("header", "standard", "score")


def rename_columns(columns: DataFrame, standards: DataFrame, outside: DataFrame) -> DataFrame:
    """(sheet, header, name): the first column of a sheet with a standard name gets it, then an outside map names columns that are left."""
    named = columns.join(standards.select("header", "standard"), "header")
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("sheet", "standard").orderBy("pos"))).filter("r = 1").select("sheet", "header", F.col("standard").alias("name"), "pos")
    rest = columns.join(first.select("sheet", "header"), ["sheet", "header"], "left_anti").join(outside.withColumnRenamed("field", "name"), "header").join(first.select("sheet", "name"), ["sheet", "name"], "left_anti")
    more = rest.withColumn("r", F.row_number().over(Window.partitionBy("sheet", "name").orderBy("pos"))).filter("r = 1").select("sheet", "header", "name", "pos")
    return first.unionByName(more).drop("pos")


def call_model(rows: DataFrame, key: str, function, schema: str, tries: int = 2, wait: float = 1.5, partitions: int | None = None) -> DataFrame:
    """A caller's batch function (pandas frame to frame) on the distinct rows, tried again after growing waits; rows of a batch that fails come back with nulls and the error.

    ``schema`` has the columns of the result after ``key``; the function must give one row for each of its input.
    """
    fields = T._parse_datatype_string(schema).fields if hasattr(T, "_parse_datatype_string") else None
    names = [f.name for f in fields] if fields else [p.split()[0] for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            error = None
            for k in range(tries):
                try:
                    got = function(b)
                    if len(got) != len(b):
                        raise ValueError("empty or partial result")
                    yield got.assign(error=None)[[key, *names, "error"]]
                    break
                except Exception as e:  # whatever the caller's function raises is kept with its rows
                    error = str(e)[:200]
                    time.sleep(wait * 2**k if k + 1 < tries else 0)
            else:
                yield b[[key]].assign(**{n: None for n in names}, error=error)[[key, *names, "error"]]

    distinct = rows.dropDuplicates([key])
    kind = rows.schema[key].dataType.simpleString()
    return (distinct.repartition(partitions) if partitions else distinct).mapInPandas(run, f"{key} {kind}, {schema}, error string")
