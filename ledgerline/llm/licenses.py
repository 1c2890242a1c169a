"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are all runs of consecutive words, across line ends, of a template's length and a quarter more, as
sets of words; a template is found in a block that holds at least ``threshold`` of its words, those that
tell it from other licenses (``MARKS``) among them. Words are ordered by their frequency over the whole
corpus, rarest first, so that a block must share one of a template's first ``n - ceil(threshold n) + 1``
words (prefix filter); the runs around each such word are counted, if the words around it hold enough of the
template's at all. Only DataFrame functions.

Null text has no words and no blocks. Rows that repeat an id with other text are documents of their own;
equal rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "All rights reserved"),
)
#: Words that must be in a block if the label's template has them.
MARKS = {"mit": {"mit"}, "apache-2": {"apache", "2"}, "gpl-3": {"gnu", "3"}, "mpl-2": {"mozilla"}, "cc-by-nc": {"nc"}, "cc-by": {"creative", "commons", "attribution"}}
THRESHOLD = 0.8
_NOT_WORD = "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(_all_words(text)))


def _all_words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def block_length(text: str) -> int:
    return math.ceil(1.25 * len(_all_words(text)))


def _spaced(text: Column) -> Column:
    """The words with a space before, between and after them, case kept."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _NOT_WORD, " ")), F.lit(" "))


def _n_words(spaced: Column) -> Column:
    return F.when(F.length(F.trim(spaced)) == 0, 0).otherwise(F.size(F.split(F.trim(spaced), " "))).cast("long")


def word_order(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[str]:
    """The templates' words, rarest in the corpus first; one count a word comes to the driver."""
    words = sorted({w for _, t in templates for w in template_words(t)})
    seen = docs.select(F.explode(F.split(F.lower(_spaced(F.col("text"))), " ")).alias("w")).filter(F.col("w").isin(words))
    count = {r.w: r.n for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (count.get(w, 0), w))


def match_templates(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, order: Sequence[str] | None = None) -> DataFrame:
    """(keys, label, containment) of every template found, each with its best block.

    ``docs`` has the key columns ``k1`` and ``k2`` and ``text``.
    """
    rank = {w: i for i, w in enumerate(order or word_order(docs, templates))}
    rows = []  # a row for each prefix word of each template
    for label, t in templates:
        words = sorted(template_words(t), key=rank.get)
        need = math.ceil(threshold * len(words) - 1e-9)
        rows += [(w, label, words, sorted(MARKS.get(label, set()) & set(words)), need, block_length(t)) for w in words[: len(words) - need + 1]]
    index = F.broadcast(docs.sparkSession.createDataFrame(rows, "word string, label string, words array<string>, marks array<string>, need int, length int"))
    prefixes, reach = sorted({r[0] for r in rows}, key=rank.get), max(r[-1] for r in rows) - 1
    any_prefix = f"(?i)(?<![0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])(?:{'|'.join(prefixes)})(?![0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])"
    near = docs.filter(F.col("text").rlike(any_prefix))
    held = near.select("k1", "k2", F.split(F.translate(F.trim(_spaced(F.col("text"))), _UPPER, _LOWER), " ").alias("all"))
    places = F.filter(F.transform("all", lambda w, i: F.when(w.isin(prefixes), i + 1)), lambda i: i.isNotNull())
    placed = held.select("k1", "k2", "all", places.alias("places"))
    first = lambda at, n: F.greatest(F.lit(1), at - n)
    # the words around each place, so that long texts aren't carried along with each of them
    near_by = F.transform("places", lambda i: F.struct((i - first(i, reach) + 1).alias("at"), F.slice("all", first(i, reach), i - first(i, reach) + 1 + reach).alias("near")))
    entries = placed.select("k1", "k2", F.explode(near_by).alias("e")).select("k1", "k2", "e.at", "e.near", F.element_at("e.near", F.col("e.at")).alias("word"))
    start = first(F.col("at"), F.col("length") - 1)
    around = entries.join(index, "word").withColumn("near", F.slice("near", start, F.col("at") - start + F.col("length")))
    enough = lambda block: (F.size(F.array_intersect(block, "words")) >= F.col("need")) & (F.size(F.array_except("marks", block)) == 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("near") - F.col("length") + 1))
    blocks = F.filter(F.transform(starts, lambda i: F.slice("near", i, F.col("length"))), enough)
    shared = F.array_max(F.transform(blocks, lambda b: F.size(F.array_intersect(b, "words"))))
    best = around.filter(enough(F.col("near"))).select("k1", "k2", "label", (shared / F.size("words")).alias("containment")).filter("containment IS NOT NULL")
    return best.groupBy("k1", "k2", "label").agg(F.max("containment").alias("containment"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Words, base phrase places, labels and score of every document."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))
    found = match_templates(keyed, templates, threshold).groupBy("k1", "k2").agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__score"))

    phrase = "(?i)(?<= )(?:" + "|".join(p for p, _ in PHRASES) + ")(?= )"
    cut = keyed.select("doc_id", "k1", "k2", _spaced(F.col("text")).alias("s"))
    with_hits = cut.select("*", F.when(F.col("s").rlike(phrase), F.regexp_extract_all("s", F.lit(phrase), F.lit(0))).alias("hits"))
    count = lambda piece: F.size(F.filter(F.split(piece, " "), lambda w: w != "")).cast("long")
    pieces = F.split("s", phrase)
    label = lambda hit: F.element_at(F.create_map(*(F.lit(x) for p in PHRASES for x in p)), F.translate(hit, _UPPER, _LOWER))
    base = with_hits.select(
        "doc_id", "k1", "k2", _n_words(F.col("s")).alias("n_words"),
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_base"),
        F.when(F.col("hits").isNotNull(), count(F.element_at(pieces, 1))).alias("first_word"),
        F.when(F.col("hits").isNotNull(), _n_words(F.col("s")) - count(F.element_at(pieces, -1)) - count(F.element_at("hits", -1))).alias("last_word"),
        F.when(F.col("hits").isNotNull(), F.array_sort(F.array_distinct(F.transform("hits", label)))).otherwise(F.array().cast("array<string>")).alias("__base"),
    )
    base = base.withColumn("n_base", F.when(F.col("n_base") < 0, 0).otherwise(F.col("n_base")))
    both = base.join(found, ["k1", "k2"], "left")
    extra = F.coalesce("__labels", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", extra)), ",").alias("labels"),
        F.when(F.size("__base") > 0, 1.0).otherwise(F.coalesce("__score", F.lit(0.0))).alias("score"),
    )
