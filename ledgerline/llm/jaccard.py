"""N-gram Jaccard join: the exact links between documents' shingle sets, as connected components.

Grouped prefix join. Equal sets are one unit. A unit's prefix is its first ``n - ceil(t n) + 1`` shingles in
one order for all, rare ones first: by the magnitude of their counts in all texts, then by hash. The counts
are a table of at most ``MAX_COUNTERS`` counters addressed by hash; where shingles share a counter the order
changes, not the result. Units with the same prefix and size form one group; groups that share a prefix
shingle are the candidates, thinned by length, position and bit-map filters; their members are then expanded
and verified by intersection. By position: at its first shared shingle, which is in both prefixes, a linked
pair has enough shingles left in both.

No bucket is expanded into all its pairs. First each bucket and group is linked to its most central member,
the one with the fewest rarer shingles (one pair a row); the verified links form components, and only members
of different components are then paired, so that a group of thousands of near copies costs thousands of
pairs, and no link between components is missed. A component doesn't change by the links left out, which lie
inside it.

Whole texts, words split at ASCII white space, A-Z lower-cased. A document without words is linked with
nothing. Null ids count as the largest and give a null component only if the component has no other.
Rows that repeat an id are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.shingles import ShingleHasher
from ledgerline.llm.words import lower_blank_words, slices
from ledgerline.llm.workspace import HOT_ROWS, Workspace, bounded_batches, components, join_hot, sized, unused

SHINGLE_WORDS, MIN_PERCENT = 4, 85
#: Longs of a unit's bit map at least; it doubles until it has a bit for ``MAP_LOAD`` shingles.
MAP_LONGS, MAP_LOAD = 16, 0.7
#: Counters of shingles: one for so many bytes of text, up to a table that every executor can hold.
COUNTER_BYTES, MIN_COUNTERS, MAX_COUNTERS = 256, 1 << 12, 1 << 20
#: Tables of counters that one task, and the driver, adds up.
FAN_IN = 8


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _bit_map(hashes: np.ndarray) -> np.ndarray:
    longs = MAP_LONGS
    while len(hashes) > MAP_LOAD * 64 * longs:
        longs *= 2
    bits = np.zeros(64 * longs, bool)
    bits[(hashes & (64 * longs - 1))] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of longs."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def shingle_magnitudes(docs: DataFrame, words: int, work: Workspace) -> np.ndarray:
    """Magnitude (base 2) of each counter after all shingles of all texts were counted.

    Tasks add counters up, ``FAN_IN`` tables a task, until the driver can add the last few.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    counters = min(MAX_COUNTERS, max(MIN_COUNTERS, 1 << (size // COUNTER_BYTES).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = ShingleHasher(words), np.zeros(counters, np.uint32)
        for b in slices(batches, "text", 1 << 20):
            for text in b.column("text"):
                for h in hasher.spans(lower_blank_words(text.as_py())):
                    np.add.at(total, h & (counters - 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.uint64).tobytes()], pa.binary())], ["counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.uint64)
        for b in batches:
            for raw in b.column("counts"):
                total += np.frombuffer(raw.as_buffer(), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    table = work.write(docs.select("text").mapInArrow(run, "counts binary"), "counters")
    while (n := table.count()) > FAN_IN:
        table = work.write(table.coalesce(-(-n // FAN_IN)).mapInArrow(add_up, "counts binary"), f"counters{n}")
    total = np.zeros(counters, np.uint64)
    for r in table.toLocalIterator():
        total += np.frombuffer(r.counts, np.uint64)
    work.delete("counters")
    return np.ceil(np.log2(total + 1.0)).astype(np.uint8)


def _heads(docs: DataFrame, words: int, percent: int, magnitudes) -> DataFrame:
    """A row for each document: its size, a 128-bit fingerprint of the set, bit map and prefix."""
    names = ["row", "key", "n", "fp", "check"]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in names), T.StructField("map", longs), T.StructField("prefix", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, row, rank = ShingleHasher(words), TaskContext.get().partitionId() << 40, magnitudes.value
        for b in slices(batches, "text", 1 << 20):
            sets = [hasher.distinct(lower_blank_words(text.as_py())) for text in b.column("text")]
            sizes = [len(s) for s in sets]
            # stable: hashes are sorted, and stay so within a magnitude
            first = [s[np.argsort(rank[s & (len(rank) - 1)], kind="stable")[: prefix_size(len(s), percent)]] if len(s) else s for s in sets]
            one, two = fingerprints(sets)
            numbers = [np.arange(row, row + len(sets)), b.column("key"), sizes, one, two]
            row += len(sets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) if not isinstance(x, pa.Array) else x for x in numbers), _lists([_bit_map(s) for s in sets]), _lists(first)], ["doc_id", *names, "map", "prefix"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(run, schema)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the mixed hashes of each set."""
    sizes = np.array([len(s) for s in sets])
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    with np.errstate(over="ignore"):
        u = np.concatenate([*sets, np.empty(0, np.int64)]).view(np.uint64)
        a = (u ^ (u >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        b = (u ^ (u >> np.uint64(27))) * np.uint64(0xC2B2AE3D27D4EB4F)
        out = []
        for mixed in (a ^ (a >> np.uint64(28)), b ^ (b >> np.uint64(33))):
            sums = np.zeros(len(sets), np.uint64)
            if len(starts):
                sums[sizes > 0] = np.add.reduceat(mixed, starts)
            out.append(sums.view(np.int64))
        return out[0], out[1]


def _sets(docs: DataFrame, units: DataFrame, words: int) -> DataFrame:
    """(unit, shingles) of the units in ``units`` (unit, key, fp, check)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)
        for b in slices(batches, "text", 1 << 20):
            sets = [hasher.distinct(lower_blank_words(t.as_py())) for t in b.column("text")]
            one, two = fingerprints(sets)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), _lists(sets)], ["fp", "check", "shingles"])

    # rows that are repeated have one key
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").join(units.select("key").distinct(), "key", "left_semi")
    return keyed.select("text").mapInArrow(run, "fp long, check long, shingles array<long>").join(units.select("fp", "check", "unit"), ["fp", "check"]).select("unit", "shingles").dropDuplicates(["unit"])


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of these sizes that are linked."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent) - 1e-9)


def _places(percent: int, a: str = "", b: str = "2") -> Column:
    """Whether sets of sizes n whose first shared shingles are at i may be linked."""
    n, m, i, j = (F.col(x) for x in (f"n{a}", f"n{b}", f"i{a}", f"i{b}"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - i, m - j) >= _needed(n, m, percent))


def _thin(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of units whose bit maps allow a link, with the sizes."""
    side = lambda x: maps.select(F.col("unit").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # of maps of two lengths the longer one is folded: its bits are the same hashes modulo the shorter length
    length = F.least(F.size("ma"), F.size("mb"))
    either = lambda m, i: F.aggregate(F.sequence(i, F.size(m) - 1, length), F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(F.get(m, k)))
    folded = lambda m: F.when(F.size(m) == length, F.col(m)).otherwise(F.transform(F.sequence(F.lit(0), length - 1), lambda i: either(m, i)))
    lost = lambda x, y: F.aggregate(F.zip_with(folded(f"m{x}"), folded(f"m{y}"), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
    need = _needed(F.col("na"), F.col("nb"), percent)
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (lost("a", "b") <= F.col("na") - need) & (lost("b", "a") <= F.col("nb") - need)
    return both.filter(fits).select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union."""
    side = lambda x: sets.select(F.col("unit").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return shared.filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b").distinct()


def jaccard_rows(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = MIN_PERCENT, hot: int = HOT_ROWS) -> DataFrame:
    """doc_id, key (hash of id and text), n_shingles, component and component_id of every document.

    ``component`` is null for a document without words. ``hot``: rows of one key that a join may bring to one task.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession)
    docs = bounded_batches(docs.select("doc_id", "text"))
    magnitudes = spark.sparkContext.broadcast(shingle_magnitudes(docs, words, work))
    full = work.write(_heads(docs, words, percent, magnitudes), "full")
    magnitudes.unpersist()

    # a unit is named after the first row that has its set
    copies = full.filter("n > 0").groupBy("fp", "check").agg(F.min("row").alias("unit"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = work.write(copies, "copies")
    mine = full.filter("n > 0").select("row", "fp", "check", F.struct("fp", "check").alias("set"))
    named = join_hot(mine, copies.select(F.struct("fp", "check").alias("set"), "unit", "copies"), "set", "copies", hot).select("row", F.coalesce("unit", "row").alias("unit"))
    named = work.write(named, "named")
    rows = work.write(full.join(named, "row", "left").select("doc_id", "key", "n", F.coalesce("unit", "row").alias("unit")), "rows")
    units = full.join(named.filter("unit = row").select("row"), "row", "left_semi").withColumn("g", F.struct(F.xxhash64("n", "prefix"), F.xxhash64(F.lit(7), "n", "prefix")))
    units = work.write(units.select(F.col("row").alias("unit"), "key", "n", "fp", "check", "map", "prefix", "g"), "units")
    work.delete("full", "named", "copies")

    # the index: a row for each group, named after its first unit, and shingle of its prefix that another group has too
    many = work.write(units.groupBy("g").agg(F.min("unit").alias("lead"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "many")
    grouped = join_hot(units.select("unit", "g"), many, "g", "k", hot).filter("lead IS NOT NULL").select("unit", F.col("lead").alias("group"))
    grouped = work.write(grouped, "grouped")
    leads = units.join(grouped.filter("unit <> group").select("unit"), "unit", "left_anti")
    dealt = leads.select(F.col("unit").alias("group"), "n", F.posexplode("prefix").alias("i", "shingle")).repartition("shingle")
    # all columns are read, so that the exchange serves the join as well; the most central member leads
    met = dealt.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("i", "group", "n")).alias("l")).filter("k > 1")
    index = dealt.join(met.select("shingle", F.col("l.group").alias("a"), F.col("l.n").alias("n2"), F.col("l.i").alias("i2")), "shingle")
    index = work.write(index, "index", release=True)

    # one pair a row: the leader of each bucket and the first unit of each group
    stars = index.filter(_places(percent)).select("a", F.col("group").alias("b"))
    inside = grouped.select(F.col("group").alias("a"), F.col("unit").alias("b"))
    first = work.write(_linked(stars.union(inside).filter("a <> b").distinct(), docs, units, words, percent, work, "stars"), "links1", release=True)
    labels = work.write(components(first, work, "one", hot), "labels1")

    # members of different components that meet in a bucket or group
    labelled = lambda df: df.join(sized(labels.withColumnRenamed("node", "unit")), "unit", "left").withColumn("label", F.coalesce("label", "unit"))
    own = work.write(labelled(grouped), "own")
    kinds = sized(work.write(own.select("group", "label").distinct(), "kinds"))
    alone = labelled(index.drop("a", "n2", "i2").join(kinds.select("group").distinct(), "group", "left_anti").withColumnRenamed("group", "unit")).withColumnRenamed("unit", "group")
    spots = alone.unionByName(index.drop("a", "n2", "i2").join(kinds, "group"))
    spots = work.write(spots, "spots").repartition("shingle")
    mixed = spots.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min(F.struct("group", "n", "i"))).filter("x <> y").select("shingle")
    spots = work.write(spots.join(mixed, "shingle"), "mixed", release=True)
    work.delete("index", "spots")
    other = spots.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("group", "n", "i", "label")))
    meet = spots.join(other, "shingle").filter((F.col("label") < F.col("label2")) & _places(percent)).select("group", "label", "group2", "label2")
    split = kinds.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("group")
    halves = kinds.join(split, "group")
    within = halves.join(halves.select("group", F.col("label").alias("label2")), "group").filter("label < label2").select("group", "label", F.col("group").alias("group2"), "label2")
    candidates = work.write(meet.union(within).distinct(), "candidates", release=True)
    side = lambda y: own.select(F.col("unit").alias(f"unit{y}"), F.col("group").alias(f"group{y}"), F.col("label").alias(f"label{y}"))
    # groups of one unit are no rows of ``own``
    pairs = candidates.join(side(""), ["group", "label"], "left").join(side("2"), ["group2", "label2"], "left").select(F.coalesce("unit", "group").alias("a"), F.coalesce("unit2", "group2").alias("b"))
    second = work.write(_linked(pairs.distinct(), docs, units, words, percent, work, "pairs"), "links2", release=True)
    work.delete("mixed", "candidates", "own", "kinds", "grouped", "many", "units")
    labels = work.write(components(first.union(second).distinct(), work, "two", hot), "labels2")
    work.delete("labels1", "links1", "links2")

    # the least id of a unit, then of its component, then back to the rows
    per_unit = rows.filter("n > 0").groupBy("unit").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("copies"))
    per_unit = work.write(per_unit.join(sized(labels.withColumnRenamed("node", "unit")), "unit", "left").withColumn("label", F.coalesce("label", "unit")), "per_unit")
    shared = work.write(per_unit.groupBy("label").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("k"), F.sum("copies").alias("rows")).filter("rows > 1"), "shared")
    told = join_hot(per_unit, shared.select("label", "least", F.lit(True).alias("many"), "k"), "label", "k", hot)
    told = work.write(told.filter("many").select("unit", F.col("label").alias("component"), "least", "copies"), "told")
    own = join_hot(rows, told, "unit", "copies", hot)
    return own.select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "unit")).alias("component"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def _linked(pairs: DataFrame, docs: DataFrame, units: DataFrame, words: int, percent: int, work: Workspace, name: str) -> DataFrame:
    """The pairs of units that are linked; whole sets are made only for those that the bit maps let through."""
    thin = work.write(_thin(pairs, units.select("unit", "n", "map"), percent), name, release=True)
    few = sized(thin.select(F.explode(F.array("a", "b")).alias("unit")).distinct())
    few = sized(work.write(units.select("unit", "key", "fp", "check").join(few, "unit", "left_semi"), f"{name}_units"))
    links = work.write(_verify(thin, work.write(_sets(docs, few, words), f"{name}_sets", release=True), percent), f"{name}_links", release=True)
    work.delete(name, f"{name}_units", f"{name}_sets")
    return links


def jaccard_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = MIN_PERCENT) -> DataFrame:
    """Per document its set's size and the smallest doc_id that it reaches by links."""
    return jaccard_rows(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest id, columns as they were.

    Rows with equal id and text are one document; of documents that share the smallest id, the one with
    the smallest text hash stays. Documents without words all stay.
    """
    work = Workspace(docs.sparkSession)
    found = work.write(jaccard_rows(docs, words, percent), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = work.write(found.filter("component IS NOT NULL").groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.min(order).alias("best")).filter("k > 1"), "best")
    ident, key = unused(docs, "first_id", "row_key")
    drop = join_hot(found.filter("component IS NOT NULL"), best, "component", "k").filter("best IS NOT NULL AND NOT (doc_id <=> best.doc_id AND key = best.key)")
    drop = work.write(drop.select(F.col("doc_id").alias(ident), F.col("key").alias(key)).distinct(), "drop")
    mine = F.xxhash64("doc_id", "text")
    kept = docs.join(sized(drop), F.col("doc_id").eqNullSafe(F.col(ident)) & (mine == F.col(key)), "left_anti")
    if found.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count():
        kept = kept.withColumn(key, mine).dropDuplicates(["doc_id", key]).drop(key)
    return kept
