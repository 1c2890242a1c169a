"""Line dedup: exact copies by hash, near copies by a segment-partition edit join.

A line (trimmed; at least ``min_chars`` code points) is dropped if an earlier line of the corpus equals
it or, both having at least ``near_chars``, lies within ``max_edits`` edits. Earlier means a smaller
(doc_id, hash of the document, line number), null ids first. Lines below ``min_chars`` always stay.

Distinct lines are split into ``max_edits + 1`` even segments; two lines within the threshold share one
at a place that follows from their lengths, so each line indexes its segments and probes those of lines
up to ``max_edits`` shorter (length-aware substring index). A segment that many lines share isn't
expanded into pairs: those lines are keyed again by all but ``max_edits`` of ``FINE_SEGMENTS`` segments,
which still covers every pair; of lines that meet there only those are paired whose letter counts an edit
distance within the threshold allows. Candidates with such counts that share enough of eight parts are
verified, between the first and the last part that differs, by an automaton whose states are the diagonals of
the edit band, as bits of one integer for each number of edits. Only DataFrame functions.

Null text stays null. Rows that agree in id and text are one document and lose the same lines; rows that
repeat an id with another text are documents of their own. All other columns stay as they are.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.workspace import Workspace, sized, unused

MIN_CHARS, NEAR_CHARS, MAX_EDITS = 10, 24, 2
#: Lines that share a segment at most, to be paired by it alone.
BUCKET_LINES = 16
FINE_SEGMENTS = 5
#: Letters that are counted, one byte each; any choice is right, frequent ones tell more lines apart.
LETTERS = "etaoinshrdlucmfw"
#: Bytes that may be sent to every executor; a line's number takes 4, a document's row about 64.
BROADCAST_BYTES = 64 << 20

#: A key: (difference of the lengths, number, [(first segment, end segment, shift)]); shift 0 throughout indexes.
Scheme = list[tuple[int, int, list[tuple[int, int, int]]]]


def coarse_scheme(edits: int) -> Scheme:
    """Single segments at every shift that a pair within the threshold can need."""
    m, out = edits + 1, []
    for delta, i in product(range(edits + 1), range(m)):
        for s in range(max(-i, delta - (m - 1 - i)), min(i, delta + (m - 1 - i)) + 1):
            out.append((delta, i, [(i, i + 1, s)]))
    return out


def fine_scheme(edits: int, segments: int) -> Scheme:
    """All but ``edits`` segments together: those before, between and after the edited ones, shifted alike."""
    out = []
    for number, gone in enumerate(combinations(range(segments), edits)):
        for shifts in product(range(-edits, edits + 1), repeat=edits):
            moves = sum(abs(b - a) for a, b in zip((0, *shifts), shifts, strict=False))
            if shifts[-1] < 0 or moves > edits:
                continue
            parts = zip((0, *(g + 1 for g in gone)), (*gone, segments), (0, *shifts), strict=True)
            out.append((shifts[-1], number, [p for p in parts if p[0] < p[1]]))
    return out


def keyed(lines: DataFrame, scheme: Scheme, segments: int) -> DataFrame:
    """``lines`` (line, size and others) without these two, a row for each key and whether it is a probe; else it is the index.

    Cuts and hashes of pieces are columns that the keys share, each made once a line: written out in every key they
    are more code than Spark compiles, and the driver fails at it slowly.
    """
    own = lambda delta: F.col("size") - delta
    keys = {(delta, number, tuple(parts)): delta > 0 or any(s for *_, s in parts) for delta, number, parts in scheme}
    places = sorted({(delta, k) for delta, _, parts in keys for a, b, _ in parts for k in (a, b)})
    pieces = sorted({(delta, *part) for delta, _, parts in keys for part in parts})
    at = {p: f"__cut{i}" for i, p in enumerate(places)}
    named = {p: f"__piece{i}" for i, p in enumerate(pieces)}
    more = [c for c in lines.columns if c not in ("line", "size")]
    cut = lines.select("*", *(F.floor(own(delta) * k / segments).cast("int").alias(name) for (delta, k), name in at.items()))
    piece = lambda delta, a, b, s: F.xxhash64(F.substr("line", F.col(at[delta, a]) + 1 + s, F.col(at[delta, b]) - F.col(at[delta, a])))
    hashed = cut.select(*more, "size", *(piece(*p).alias(name) for p, name in named.items()))
    out = [F.struct(F.xxhash64(own(delta), F.lit(number), *(named[delta, *part] for part in parts)).alias("key"), F.lit(probe).alias("probe")) for (delta, number, parts), probe in keys.items()]
    return hashed.select(*more, F.explode(F.array(*out)).alias("e")).select("e.key", "e.probe", *more)


def _times(line: Column, letter: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))


def _letters(line: Column) -> list[Column]:
    """Two longs of eight counts each, up to 255."""
    times = lambda c: F.least(_times(line, c), F.lit(255)).cast("long")
    return [sum((F.shiftleft(times(c), 8 * i) for i, c in enumerate(LETTERS[at : at + 8])), F.lit(0).cast("long")) for at in (0, 8)]


def _alike(a: list[Column], b: list[Column], edits: int) -> Column:
    """Whether letter counts differ by what so many edits change at most: each takes one letter and brings one."""
    byte = lambda x, i: F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("long"))
    return sum((F.abs(byte(x, i) - byte(y, i)) for x, y in zip(a, b, strict=True) for i in range(8)), F.lit(0).cast("long")) <= 2 * edits


def within_edits(pairs: DataFrame, edits: int) -> DataFrame:
    """The rows of ``pairs`` whose strings ``left`` and ``right`` are at most ``edits`` edits apart.

    Bit d of state e stands for the cell on diagonal d - edits of the band, reached with at most e edits; a
    step takes a character of ``right`` and all cells of its column at once.
    """
    cells, parts = range(2 * edits + 1), 8
    # Most candidates fail here: each edit spoils one of the left line's parts at most, all others occur in
    # the right line up to `edits` places away. What is left is compared between its first and last spoilt part.
    n, delta = F.length("left"), F.length("right") - F.length("left")
    at = lambda i: F.floor(n * i / parts).cast("int")
    same = lambda i, s: F.substr("left", at(i) + 1, at(i + 1) - at(i)) == F.substr("right", at(i) + 1 + s, at(i + 1) - at(i))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    shifts = F.array(*(F.lit(s) for s in sorted(range(-edits, edits + 1), key=abs)))
    met = F.size(F.filter(every, lambda i: F.exists(shifts, lambda s: same(i, s))))
    apart = sum((F.abs(_times(F.col("left"), c) - _times(F.col("right"), c)) for c in LETTERS), F.lit(0))
    counted = pairs.filter((F.abs(delta) <= edits) & (apart <= 2 * edits))
    thin = counted.filter((n < parts * (edits + 1)) | (met >= parts - edits))
    thin = thin.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Generated columns: a filter above would otherwise take their expressions along into every use of them.
    keep = lambda df, **made: df.select(*df.columns, F.inline(F.array(F.struct(*(c.alias(k) for k, c in made.items())))))
    head = F.array_position(F.transform(every, lambda i: same(i, F.lit(0))), False)
    tail = F.array_position(F.transform(every, lambda i: same(F.lit(parts - 1) - i, delta)), False)
    ends = keep(thin, __head=F.when(head == 0, parts).otherwise(head - 1).cast("int"), __tail=F.when(tail == 0, 0).otherwise(parts + 1 - tail).cast("int"))
    long = n >= parts * (edits + 1)  # a part is longer than the difference of the lengths
    start, stop = at(F.col("__head")), at(F.greatest(F.col("__tail"), F.least(F.col("__head") + 1, F.lit(parts))))
    chars = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))
    mid = keep(ends, __l=F.when(long, F.substr("left", start + 1, stop - start)).otherwise(F.col("left")), __r=F.when(long, F.substr("right", start + 1, stop - start + delta)).otherwise(F.col("right")))
    cut = keep(mid, __left=chars(F.col("__l")), __right=chars(F.col("__r")))
    cut = cut.filter(F.abs(F.size("__left") - F.size("__right")) <= edits)
    equal = lambda c, j: sum((F.when(F.get("__left", j + (d - edits)) == c, 1 << d).otherwise(0) for d in cells), F.lit(0))
    cut = cut.withColumn("__equal", F.transform("__right", equal))

    def step(state: Column, match: Column) -> Column:
        out = [state["r0"].bitwiseAND(match)]
        for e in range(1, edits + 1):
            low = state[f"r{e - 1}"]
            new = state[f"r{e}"].bitwiseAND(match).bitwiseOR(low).bitwiseOR(F.shiftright(low, 1)).bitwiseOR(F.shiftleft(out[-1], 1))
            out.append(new.bitwiseAND(F.lit((1 << len(cells)) - 1)))
        return F.struct(*(x.alias(f"r{e}") for e, x in enumerate(out)))

    start = F.struct(*(F.lit(sum(1 << (edits + i) for i in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)))
    ended = cut.withColumn("__end", F.aggregate("__equal", start, step)[f"r{edits}"])
    last = F.size("__left") - F.size("__right") + edits
    return ended.filter(F.getbit("__end", last) == 1).select(*pairs.columns)


def _lines(docs: DataFrame, *more: Column) -> DataFrame:
    """(id, k, no, line) of every line that is long enough; ``more`` are further columns."""
    every = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("k"), *more, F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return every.withColumn("line", F.btrim("line", F.lit(" \t\r"))).withColumn("size", F.length("line"))


def _hashed(lines: DataFrame) -> DataFrame:
    """With a 128-bit hash of the line."""
    return lines.withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line", "size"))


def _pairs(rows: DataFrame, bucket: int | None, work: Workspace, name: str, edits: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(a, b) that share a key in buckets of up to ``bucket`` lines, and the lines (h) of larger ones; with ``edits`` letter counts (c0, c1) must be alike."""
    dealt = rows.repartition("key")
    more = [c for c in rows.columns if c in ("c0", "c1")]
    stats = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("h").alias("x"), F.max("h").alias("y"), F.bool_and("probe").alias("no_index"))
    met = work.write(dealt.join(stats.filter("x <> y AND NOT no_index").select("key", "rows"), "key"), name, release=True)
    small = met if bucket is None else met.filter(F.col("rows") <= bucket)
    index = small.filter("NOT probe").select("key", F.col("h").alias("a"), *(F.col(c).alias(f"{c}a") for c in more))
    other = small.select("key", F.col("h").alias("b"), "probe", *(F.col(c).alias(f"{c}b") for c in more))
    meet = F.expr("a <> b AND (probe OR a < b)")
    if edits is not None:
        meet = meet & _alike([F.col("c0a"), F.col("c1a")], [F.col("c0b"), F.col("c1b")], edits)
    pairs = index.join(other, "key").filter(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, None if bucket is None else met.filter(F.col("rows") > bucket).select("h").distinct()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, max_edits: int = MAX_EDITS, bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """(k, no, near) of every line to drop: hash of the document's id and text, line number, and whether it is only near."""
    work = Workspace(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    occurrences = work.write(_hashed(_lines(docs).filter(F.col("size") >= min_chars)).select("id", "k", "no", "h", "h2", "size"), "occurrences")
    firsts = work.write(occurrences.groupBy("h", "h2").agg(F.min(F.struct("id", "k", "no")).alias("first"), F.first("size").alias("size")), "firsts")

    # the text of lines where they first occur
    places = firsts.filter(F.col("size") >= near_chars).groupBy(F.col("first.k").alias("__k")).agg(F.collect_set("first.no").alias("__nos"))
    places = work.write(places, "places")
    size = places.agg(F.sum(4 * F.size("__nos") + 64)).head()[0] or 0
    places = F.broadcast(places) if size <= BROADCAST_BYTES else places
    here = docs.join(places, F.xxhash64("doc_id", "text") == F.col("__k"))
    kept = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.array_contains("__nos", i), F.btrim(x, F.lit(" \t\r"))))
    texts = _hashed(here.select(F.explode(F.array_distinct(kept)).alias("line")).filter("line IS NOT NULL").withColumn("size", F.length("line")))
    texts = work.write(texts, "texts")

    segments = max_edits + 1
    near, crowded = _pairs(keyed(texts.select("h", "line", "size"), coarse_scheme(max_edits), segments), bucket_lines, work, "coarse")
    crowded = sized(work.write(crowded, "crowded"))
    one, two = _letters(F.col("line"))
    # counted before the keys are made, once a line
    again = texts.join(crowded, "h").select("h", "line", "size", one.alias("c0"), two.alias("c1"))
    fine, _ = _pairs(keyed(again, fine_scheme(max_edits, FINE_SEGMENTS), FINE_SEGMENTS), None, work, "fine", max_edits)
    pairs = work.write(near.union(fine).distinct(), "pairs", release=True)
    work.delete("coarse", "fine", "crowded", "places")

    wanted = sized(work.write(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted"))
    found = work.write(texts.join(wanted, "h").select("h", "h2", "line").distinct().join(firsts.select("h", "h2", "first"), ["h", "h2"]), "found", release=True)
    work.delete("texts", "wanted")
    side = lambda x, y: found.select(F.col("h").alias(x), F.struct("first", "h", "h2").alias(f"at_{x}"), F.col("line").alias(y))
    links = within_edits(pairs.join(side("a", "left"), "a").join(side("b", "right"), "b"), max_edits)
    near = work.write(links.select(F.greatest("at_a", "at_b")["first"].alias("at")).select("at.k", "at.no", F.lit(True).alias("near")).distinct(), "near")
    # what isn't the first of its kind is a copy; a key for nearly every row, so that a common line fills no task
    copies = occurrences.select("k", "no").distinct().join(firsts.select("first.k", "first.no"), ["k", "no"], "left_anti")
    dropped = work.write(copies.withColumn("near", F.lit(False)).unionByName(near), "dropped", release=True)
    work.delete("occurrences", "firsts", "pairs", "found", "near")
    return dropped


def mark_lines(docs: DataFrame, **limits: int) -> tuple[DataFrame, str]:
    """``docs`` with a map from the numbers of lines to drop to whether they are only near copies, and that column's name."""
    key, drop = unused(docs, "line_key", "line_drop")
    work = Workspace(docs.sparkSession)
    drops = dropped_lines(docs, **limits).groupBy(F.col("k").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("no", "near"))).alias(drop))
    drops = work.write(drops, "drops")
    size = drops.agg(F.sum(16 * F.size(drop) + 64)).head()[0] or 0
    return docs.join(F.broadcast(drops) if size <= BROADCAST_BYTES else drops, F.xxhash64("doc_id", "text") == F.col(key), "left").drop(key), drop


def _rest(drop: str) -> Column:
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.map_contains_key(drop, i))
    return F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))


def dedup_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text`` and, where there is one, ``n_chars`` counted anew."""
    out, drop = mark_lines(docs, **limits)
    out = out.withColumn("text", _rest(drop))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, **limits: int) -> DataFrame:
    """Per document: its lines, those dropped as exact and as near copies, and the text that stays."""
    marked, drop = mark_lines(docs.select("doc_id", "text"), **limits)
    gone = lambda near: F.coalesce(F.size(F.filter(F.map_values(drop), lambda x: x == F.lit(near))), F.lit(0)).cast("long")
    none = F.col(drop).isNull()
    return marked.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(gone(False)).cast("long").alias("n_exact"), F.when(none, 0).otherwise(gone(True)).cast("long").alias("n_near"), _rest(drop).alias("text"),
    )
