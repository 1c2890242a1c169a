"""Exact search for the k largest inner products, by ball trees with branch and bound.

Vectors are quantised to integers and packed as they are read (no shuffle) into shards of at most ``SHARD_ROWS`` rows, each
with a ball tree: a node has a centre, a radius and two children. Queries are packed into blocks. A block meets a shard's
nodes in the order of their upper bounds, the inner product with the centre plus the query's length times the radius; a
query leaves a node whose bound is below its kth score so far. That score is shared: a block starts with the kth score among
its own queries, which are rows of the table too, and a task carries it from shard to shard. The blocks of a pass are
broadcast, ``PASS_QUERIES`` queries at a time, about; each task returns its k + 1 best a query.

Scores are exact: float arithmetic is used where every partial sum stays below 2^53, else 64-bit integers without pruning
(scores beyond 64 bits wrap). Of rows with equal vectors in a shard only the k + 1 smallest ids can be among the best, so
only they are kept. Defined results: vectors that are null or have null or non-finite components, and rows with a null id,
take no part; vectors meet only vectors of their length; repeated rows are rows of their own, of which a query leaves out
one, itself; query rows equal in id and vector are one query; an empty table gives no rows; only the two named columns count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.workspace import Workspace, bounded_batches

#: Rows of a shard, of a leaf of its tree, of a block of queries, and queries that are broadcast at once, about.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES, PASS_QUERIES = 16_384, 256, 1_024, 65_536
_EXACT = float(1 << 53)
_SHARDS = "dim int, ids binary, vectors binary, starts array<int>, ends array<int>, lefts array<int>, centres binary, radii array<double>"
_BLOCKS = "dim int, block long, ids binary, vectors binary, kth binary"
_FOUND = "block long, place int, query_id long, vec_id long, score long, own boolean"


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, q): floor(scale * x) of each component of the vectors that are whole and finite."""
    x = F.col(vector_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    whole = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, finite))
    return whole.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("q"))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, length by length."""
    ids, q = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes, flat = np.diff(q.offsets.to_numpy()), q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), ids[rows].astype(np.int64), flat[starts[rows][:, None] + np.arange(dim)]


def _gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of at most ``rows`` vectors of one length."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, ids, vectors in _by_dim(batch):
            if dim in held:
                ids, vectors = (np.concatenate(x) for x in zip(held.pop(dim), (ids, vectors), strict=True))
            while len(ids) >= rows:
                yield dim, ids[:rows], vectors[:rows]
                ids, vectors = ids[rows:], vectors[rows:]
            held[dim] = ids, vectors
    for dim, (ids, vectors) in held.items():
        if len(ids):
            yield dim, ids, vectors


def _least_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest ids of each distinct vector."""
    order = np.lexsort((ids, *vectors.T))
    if vectors.shape[1]:
        new = np.concatenate(([True], (np.diff(vectors[order], axis=0) != 0).any(1)))
    else:
        new = np.arange(len(ids)) == 0
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return order[np.arange(len(ids)) - first < most]


def _tree(vectors: np.ndarray) -> tuple[np.ndarray, list[int], list[int], list[int], np.ndarray, list[float]]:
    """Order of the rows, and the nodes: first and last row, left child (the right one follows it; -1: a leaf), centre, radius."""
    x = vectors.astype(np.float64)
    order, starts, ends, lefts, centres, radii = np.arange(len(x)), [0], [len(x)], [-1], [], []
    node = 0
    while node < len(starts):
        rows = order[starts[node] : ends[node]]
        own = x[rows]
        centre = own.mean(0)
        far = ((own - centre) ** 2).sum(1)
        centres.append(centre)
        radii.append(float(np.sqrt(far.max())) * (1 + 1e-9))
        if len(rows) > LEAF_ROWS and far.max() > 0:
            a = own[far.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            half = len(rows) // 2
            order[starts[node] : ends[node]] = rows[np.argpartition(own @ (b - a), half)]
            lefts[node] = len(starts)
            middle = starts[node] + half
            starts += [starts[node], middle]
            ends += [middle, ends[node]]
            lefts += [-1, -1]
        node += 1
    return order, starts, ends, lefts, np.array(centres), radii


def _pack_shards(batches: Iterable[pa.RecordBatch], most: int, rows: int) -> Iterator[pa.RecordBatch]:
    for dim, ids, vectors in _gathered(batches, rows):
        keep = _least_copies(ids, vectors, most)
        ids, vectors = ids[keep], vectors[keep]
        order, starts, ends, lefts, centres, radii = _tree(vectors)
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([dim], pa.int32()), "ids": [ids[order].tobytes()], "vectors": [vectors[order].tobytes()],
                **{k: pa.array([v], pa.list_(pa.int32())) for k, v in (("starts", starts), ("ends", ends), ("lefts", lefts))},
                "centres": [centres.tobytes()], "radii": [radii],
            }
        )


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if _length(a) * _length(b) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _length(a: np.ndarray) -> float:
    return float(np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0)))


def _pack_blocks(batches: Iterable[pa.RecordBatch], k: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the kth score of each query among the others, which no result is below."""
    for number, (dim, ids, vectors) in enumerate(_gathered(batches, rows)):
        kth = np.full(len(ids), np.iinfo(np.int64).min)
        if len(ids) > k:
            scores = _product(vectors, vectors)
            np.fill_diagonal(scores, np.iinfo(np.int64).min)
            kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        yield pa.RecordBatch.from_pydict(
            {"dim": pa.array([dim], pa.int32()), "block": [(TaskContext.get().partitionId() << 32) + number], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "kth": [kth.tobytes()]}
        )


class _Best:
    """The k + 1 best of each query of a block so far."""

    def __init__(self, ids: bytes, vectors: bytes, kth: bytes, dim: int, k: int):
        self.ids, self.k = np.frombuffer(ids, np.int64), k
        self.vectors = np.frombuffer(vectors, np.int64).reshape(len(self.ids), dim)
        self.exact = self.vectors.astype(np.float64)
        self.lengths = np.sqrt((self.exact**2).sum(1))
        self.kth = np.frombuffer(kth, np.int64).copy()
        shape = len(self.ids), k + 1
        self.found, self.scores, self.own, self.full = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(len(self.ids), int)

    def add(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray, scores: np.ndarray) -> None:
        hits = scores >= self.kth[who][:, None]
        for row in np.flatnonzero(hits.any(1)):
            q, new = who[row], np.flatnonzero(hits[row])
            n = self.full[q]
            all_ids, all_scores = np.concatenate((self.found[q, :n], ids[new])), np.concatenate((self.scores[q, :n], scores[row, new]))
            own = np.concatenate((self.own[q, :n], (ids[new] == self.ids[q]) & (vectors[new] == self.vectors[q]).all(1)))
            top = np.lexsort((~own, all_ids, -all_scores))[: self.k + 1]
            n = self.full[q] = len(top)
            self.found[q, :n], self.scores[q, :n], self.own[q, :n] = all_ids[top], all_scores[top], own[top]
            if n > self.k:
                self.kth[q] = max(self.kth[q], self.scores[q, self.k])

    def visit(self, shard: dict) -> None:
        ids = np.frombuffer(shard["ids"], np.int64)
        vectors = np.frombuffer(shard["vectors"], np.int64).reshape(len(ids), shard["dim"])
        exact = self.lengths.max(initial=0) * _length(vectors) < _EXACT
        if not exact:
            self.add(np.arange(len(self.ids)), ids, vectors, self.vectors @ vectors.T)
            return
        centres, radii = np.frombuffer(shard["centres"], np.float64).reshape(len(shard["radii"]), shard["dim"]), shard["radii"]
        as_float = vectors.astype(np.float64)
        bound = lambda node, who: self.exact[who] @ centres[node] + self.lengths[who] * radii[node] + 0.5
        everyone = np.arange(len(self.ids))
        bounds = bound(0, everyone)
        queue = [(-bounds.max(), 0, everyone, bounds)]
        while queue:
            _, node, who, bounds = heappop(queue)
            near = bounds >= self.kth[who]
            who = who[near]
            if not len(who):
                continue
            if (left := shard["lefts"][node]) < 0:
                rows = slice(shard["starts"][node], shard["ends"][node])
                self.add(who, ids[rows], vectors[rows], (self.exact[who] @ as_float[rows].T).astype(np.int64))
            else:
                for child in (left, left + 1):
                    bounds = bound(child, who)
                    heappush(queue, (-bounds.max(), child, who, bounds))


def _search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What each block of the pass finds in all shards of the task."""
    best: dict[int, _Best] = {}
    for batch in batches:
        for pair in batch.to_pylist():
            if (block := pair["block"]) not in best:
                best[block] = _Best(pair["block_ids"], pair["block_vectors"], pair["kth"], pair["dim"], k)
            best[block].visit(pair)
    for block, b in best.items():
        place, at = np.nonzero(np.arange(b.k + 1) < b.full[:, None])
        yield pa.RecordBatch.from_pydict(
            {"block": np.full(len(place), block), "place": place.astype(np.int32), "query_id": b.ids[place], "vec_id": b.found[place, at], "score": b.scores[place, at], "own": b.own[place, at]}
        )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with all other rows, ties to the smaller id.

    ``vectors`` (id, q) as ``quantise`` gives them; ``is_query`` picks the queries among them.
    """
    work = Workspace(vectors.sparkSession)
    vectors = bounded_batches(vectors)
    shards = work.write(vectors.mapInArrow(lambda b: _pack_shards(b, k + 1, shard_rows), _SHARDS), "shards")
    queries = work.write(vectors.filter(is_query).distinct(), "queries")
    n = queries.count()
    dealt = queries.repartition(-(-n // block_queries) or 1, "id")
    blocks = work.write(dealt.mapInArrow(lambda b: _pack_blocks(b, k, block_queries), _BLOCKS), "blocks")
    passes = -(-n // pass_queries) or 1
    for p in range(passes):
        some = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(passes)) == p).withColumnsRenamed({"ids": "block_ids", "vectors": "block_vectors"})
        work.write(shards.join(F.broadcast(some), "dim").mapInArrow(lambda b: _search(b, k), _FOUND), f"found/pass={p}")
    work.delete("shards", "queries", "blocks")
    found = vectors.sparkSession.read.schema(_FOUND).parquet(f"{work.root}/found/pass=*")
    best = lambda *own: F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id", *own))
    first = found.withColumn("rank", best(F.desc("own"))).filter(F.col("rank") <= k + 1)
    mine = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("block", "place"))
    others = first.withColumn("mine", mine).filter(F.col("mine").isNull() | (F.col("rank") != F.col("mine")))
    ranked = others.withColumn("rank", (F.col("rank") - F.when(F.col("rank") > F.col("mine"), 1).otherwise(0)).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
