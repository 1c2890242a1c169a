"""Ranked lexical search over a length-stratified index, with whole results in integer arithmetic.

A document of n terms has the normaliser m = 100 - b + (b * n * N) div L (b = 90; N documents with terms, L all their terms);
a term's tf in it then has the impact (10^9 * tf) div (1000 * tf + 8 * m). Documents of equal m are a stratum. The index deals
documents by m, a frequent m over many tasks, and packs them into shards of at most ``SHARD_POSTINGS`` postings; a shard has
the postings of each stratum by term and falling tf, so that an impact is computed once for all documents of equal m and tf.
For an item each stratum has a bound, the sum of its terms' largest impacts there times their weights; strata are visited in
the order of their bounds, in growing steps, until the bound is below the kth score so far, which a task keeps from shard to
shard. Items are broadcast in blocks, ``PASS_BLOCKS`` at a time, about. Every document is indexed, whole, with all its terms.

Defined results: null texts and texts without a term have no terms and take no part; items without a term, or equal to an
earlier item in id and text, give no rows of their own; a null doc_id or item_id is a value like others (null ids come first
among ties); repeated documents are rows of their own, each with a rank; an empty table gives no rows; other columns don't
count, whatever they are called.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.workspace import Workspace, bounded_batches, release, sized

#: Bytes to lower case, what is no term to a blank: terms are runs of 0-9, A-Z, a-z and characters beyond ASCII.
_FOLD = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Of a shard; of a pass, about.
SHARD_POSTINGS, PASS_ITEMS, PASS_TERMS = 100_000, 4_096, 200_000
#: Of the index's files: a reader holds one row group.
ROW_GROUP_BYTES = 4 << 20
B = 90
_COUNTS = "id long, n long, k int, terms string, tfs binary"
_COUNT_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary())
_SHARDS = "ids array<long>, ms array<long>, terms array<string>, dfs array<long>, strata array<int>, places array<int>, tfs array<int>, starts array<int>, docs array<int>"
_FOUND = "item long, item_id long, doc_id long, score long"
_NULL = np.iinfo(np.int64).min


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each text and how often they occur, in two strings of bytes a text."""
    for batch in batches:
        rows: list[tuple] = []
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if words := text.translate(_FOLD).split():
                counts = Counter(words)
                rows.append((key, len(words), len(counts), b" ".join(counts), array("I", counts.values()).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COUNT_TYPES, strict=True)], names=["id", "n", "k", "terms", "tfs"])
    release()


def count_terms(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, n, k, terms, tfs) of each text with a term: its k distinct terms with blanks between them, and their tf, 32 bits each."""
    some = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL")
    return bounded_batches(some).mapInArrow(_count, _COUNTS)


def _packed(table: pa.Table) -> pa.RecordBatch:
    """A shard of documents that come by rising m."""
    tfs = np.frombuffer(b"".join(table.column("tfs").to_pylist()), np.uint32).astype(np.int64)
    coded = pc.split_pattern(table.column("terms").combine_chunks(), " ").flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(table)), table.column("k").to_numpy())
    ms, stratum = np.unique(table.column("m").to_numpy(), return_inverse=True)
    place = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((doc, -tfs, place, stratum[doc]))
    keys = np.stack((stratum[doc], place, tfs))[:, order]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(keys) != 0).any(0))))
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.RecordBatch.from_pydict(
        {
            "ids": one(table.column("id").to_pylist(), pa.int64()), "ms": one(ms, pa.int64()), "terms": pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
            "dfs": one(np.bincount(place, minlength=len(coded.dictionary)), pa.int64()), "strata": one(keys[0, starts].astype(np.int32), pa.int32()), "places": one(keys[1, starts].astype(np.int32), pa.int32()),
            "tfs": one(keys[2, starts].astype(np.int32), pa.int32()), "starts": one(np.append(starts, len(order)).astype(np.int32), pa.int32()), "docs": one(doc[order].astype(np.int32), pa.int32()),
        }
    )


def _pack(batches: Iterable[pa.RecordBatch], postings: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        sizes = batch.column("k").to_numpy()
        begin = 0
        for end in range(1, len(batch) + 1):
            n += sizes[end - 1]
            if n >= postings or end == len(batch):
                held.append(batch.slice(begin, end - begin))
                begin = end
            if n >= postings:
                yield _packed(pa.Table.from_batches(held))
                held, n = [], 0
    if held:
        yield _packed(pa.Table.from_batches(held))
    release()


def build_index(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", postings: int = SHARD_POSTINGS) -> tuple[DataFrame, int]:
    """The shards of the index, a written table, and N."""
    counts = work.write(count_terms(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "counts")
    n_docs, n_terms, n_postings = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1)), F.coalesce(F.sum("k"), F.lit(0))).head()
    m = F.lit(100 - B) + F.expr(f"({B} * n * {n_docs}L) div {n_terms}L")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, n_postings // (4 * postings))
    dealt = counts.withColumn("m", m).repartitionByRange(parts, "m", "row").sortWithinPartitions("m", "row").drop("row", "n")
    shards = work.write(bounded_batches(dealt).mapInArrow(lambda b: _pack(b, postings), _SHARDS), "shards", release=True, **{"parquet.block.size": ROW_GROUP_BYTES})
    work.delete("counts")
    return shards, n_docs


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, range by range."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class _Shard:
    def __init__(self, row: dict, wanted: pa.Array):
        self.ids, self.docs, self.starts = row["ids"], row["docs"], row["starts"]
        self.strata, places, tfs = row["strata"], row["places"], row["tfs"].astype(np.int64)
        self.impacts = (1_000_000_000 * tfs) // (1_000 * tfs + 8 * row["ms"][self.strata])
        self.n_strata = len(row["ms"])
        #: Runs of groups of one term in one stratum, by term: the first group has the largest tf and so the largest impact.
        first = np.flatnonzero(np.concatenate(([True], (np.diff(self.strata) != 0) | (np.diff(places) != 0))))
        last = np.append(first[1:], len(places))
        by_term = np.argsort(places[first], kind="stable")
        self.first, self.last = first[by_term], last[by_term]
        ends = np.searchsorted(places[self.first], np.arange(len(row["terms"]) + 1))
        known = np.flatnonzero(pc.is_in(row["terms"], value_set=wanted).to_numpy(zero_copy_only=False))
        self.runs = {t: (ends[i], ends[i + 1]) for i, t in zip(known, row["terms"].take(pa.array(known)).to_pylist(), strict=True)}


class _Best:
    """The best documents of an item so far."""

    def __init__(self, item: dict, k: int):
        self.item, self.item_id, self.terms, self.k = item["item"], item["item_id"], [(t["term"], t["w"]) for t in item["terms"]], k
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def visit(self, shard: _Shard) -> None:
        hit = [(shard.runs[t], w) for t, w in self.terms if w > 0 and t in shard.runs]
        if not hit:
            return
        begins = np.array([r[0] for r, _ in hit])
        sizes = np.array([r[1] - r[0] for r, _ in hit])
        runs, weights = _spread(begins, sizes), np.repeat(np.array([w for _, w in hit]), sizes)
        strata = shard.strata[shard.first[runs]]
        bounds = np.zeros(shard.n_strata, np.int64)
        np.add.at(bounds, strata, weights * shard.impacts[shard.first[runs]])
        order = np.argsort(-bounds, kind="stable")
        at, step = 0, 1
        while at < len(order) and bounds[order[at]] > 0 and (len(self.ids) < self.k or bounds[order[at]] >= self.scores[-1]):
            chosen = np.zeros(shard.n_strata, bool)
            chosen[order[at : at + step]] = True
            mine = chosen[strata]
            firsts, groups = shard.first[runs[mine]], shard.last[runs[mine]] - shard.first[runs[mine]]
            group = _spread(firsts, groups)
            points = np.repeat(weights[mine], groups) * shard.impacts[group]
            many = shard.starts[group + 1] - shard.starts[group]
            scores = np.zeros(len(shard.ids), np.int64)
            np.add.at(scores, shard.docs[_spread(shard.starts[group], many)], np.repeat(points, many))
            self.add(shard.ids, scores)
            at, step = at + step, step * 2

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        new = np.flatnonzero(scores >= max(1, self.scores[-1] if len(self.ids) == self.k else 1))
        if len(new):
            ids, scores = np.concatenate((self.ids, ids[new])), np.concatenate((self.scores, scores[new]))
            top = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[top], scores[top]


def _search(batches: Iterable[pa.RecordBatch], items: list[dict], k: int) -> Iterator[pa.RecordBatch]:
    best = [_Best(x, k) for x in items]
    wanted = pa.array(sorted({t for x in best for t, _ in x.terms}), pa.string())
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i].values for name in batch.schema.names}
            shard = _Shard({name: x if name == "terms" else (x.fill_null(_NULL) if x.null_count else x).to_numpy(zero_copy_only=False) for name, x in row.items()}, wanted)
            for x in best:
                x.visit(shard)
    rows = [(x.item, x.item_id, None if d == _NULL else int(d), int(s)) for x in best for d, s in zip(x.ids, x.scores, strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item", "item_id", "doc_id", "score"])
    release()


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", pass_items: int = PASS_ITEMS, postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0, ties to the smaller doc_id.

    ``docs`` (doc_id, text); ``items`` (``item_col``, text).
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    shards, n_docs = build_index(docs, work, postings=postings)
    own = count_terms(items.select(item_col, "text").distinct(), item_col).select(F.monotonically_increasing_id().alias("item"), F.col("id").alias("item_id"), F.split("terms", " ").alias("terms"))
    own = work.write(own, "items")
    terms = own.select("item", "item_id", F.explode("terms").alias("term"))
    words = work.write(terms.select("term").distinct(), "words")
    dfs = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    w = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = work.write(dfs.join(sized(words), "term").groupBy("term").agg(F.sum("df").alias("df")).select("term", w.alias("w")), "weights")
    weighed = terms.join(sized(weights), "term").groupBy("item", "item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    weighed = work.write(weighed, "weighed")
    n_items, n_terms = weighed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).head()
    passes = max(1, -(-n_items // pass_items), -(-n_terms // PASS_TERMS))
    for p in range(passes):
        some = [r.asDict(recursive=True) for r in weighed.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).toLocalIterator()]
        sent = spark.sparkContext.broadcast(some)
        found = bounded_batches(shards.drop("dfs")).mapInArrow(lambda b, sent=sent: _search(b, sent.value, k), _FOUND)
        work.write(found, f"found/pass={p}")
        sent.destroy()
    work.delete("shards", "items", "words", "weights", "weighed")
    found = spark.read.schema(_FOUND).parquet(f"{work.root}/found/pass=*")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
