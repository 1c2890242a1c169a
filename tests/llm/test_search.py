"""Exact searches against brute force, and their odd inputs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import lexical, topk

VECTORS = "vec_id long, embedding array<float>"


def brute_top_k(rows, k):
    """Over (id, q) rows: every row is a candidate but one copy of the query."""
    want = []
    for query, q in {(i, tuple(q)) for i, q in rows if i % 50 == 0}:
        others = [(i, tuple(x)) for i, x in rows]
        others.remove((query, q))
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), i) for i, x in others if len(x) == len(q))
        want += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(want)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k_equals_brute_force(spark, clustered):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 6)) + (8 * rng.normal(size=(10, 6))[rng.integers(0, 10, 1500)] if clustered else 0)
    x[200:500] = x[7]  # one very common vector, the best of some queries
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows += rows[:3] + [(50, rows[3][1])]  # repeated rows, an id with two vectors
    vectors = topk.quantise(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = topk.top_k(vectors, F.col("id") % 50 == 0, 5, shard_rows=300, block_queries=7, pass_queries=14)
    assert found(got) == brute_top_k(vectors.collect(), 5)


def test_a_node_is_left_below_the_kth_score():
    rng = np.random.default_rng(5)
    vectors = np.sort(rng.integers(-1000, 1000, (4096, 1)), axis=0)
    batch = next(topk._pack_shards(iter([_batch(range(4096), vectors)]), 6, 4096)).to_pylist()[0]
    best = topk._Best(np.array([0]).tobytes(), np.array([[900]]).tobytes(), np.array([np.iinfo(np.int64).min]).tobytes(), 1, 5)
    visits = []
    add = best.add
    best.add = lambda who, ids, *rest: (visits.append(len(ids)), add(who, ids, *rest))
    best.visit(batch)
    assert len(batch["lefts"]) > 8 and sum(visits) < 1024


def _batch(ids, vectors):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "q": pa.array([list(map(int, v)) for v in vectors], pa.list_(pa.int64()))})


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, []), (100, []), (None, [1.0, 2.0]), (50, [-0.001, 3.0]), (7, [1.0, 2.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("clash")).withColumn("q", F.lit("clash")).withColumn("rank", F.lit(1))
    vectors = topk.quantise(df)
    got = found(topk.top_k(vectors, F.col("id") % 50 == 0))
    assert got == brute_top_k(vectors.collect(), 5)
    assert (0, 2, 0, 256 * 256 + 512 * 512) in got and (100, 1, 6, 0) in got and [r for r in got if r[0] == 50][0] == (50, 1, 0, -256 + 768 * 512)
    assert topk.top_k(topk.quantise(df.limit(0)), F.col("id") % 50 == 0).collect() == []


def test_top_k_of_large_components_is_exact(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 1_000_003) for j in range(4)]) for i in range(120)]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found(topk.top_k(vectors, F.col("id") % 50 == 0)) == brute_top_k(vectors.collect(), 5)


def terms_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def brute_search(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total, df = len(counts), sum(x[2] for x in counts), Counter(t for _, c, _ in counts for t in c)
    want = []
    for item, text in set(items):
        scored = []
        for i, c, size in counts:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        want += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(want, key=str)


def searched(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_equals_brute_force(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert len(want) > 50
    assert searched(lexical.search(docs, items)) == want
    assert searched(lexical.search(docs, items, pass_items=4, postings=500)) == want


def test_search_odd_rows(spark, odd, none):
    rows = [(1, "same words here"), (1, "same words here"), (1, "other"), (2, None), (3, " .,"), (None, "Été naïve"), (4, "absent"), (5, "lorem " * 3000 + "x" * 30000)]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("terms", F.lit("clash")).withColumn("item", F.lit("clash"))
    got = searched(lexical.search(odd, items))
    want = brute_search([(r.doc_id, r.text) for r in odd.collect()], rows, 10)
    assert got == want and {None, 1, 5} == {r[0] for r in got}
    assert lexical.search(none, items).collect() == [] and lexical.search(odd, items.limit(0)).collect() == []


def test_hot_strata_and_copies(spark):
    """A third of the documents are equal, another third has one length."""
    rows = [(i, "alpha beta gamma" if i % 3 == 0 else f"alpha {'beta' if i % 7 else 'delta'} w{i}" if i % 3 == 1 else "beta " * (i % 50) + f"w{i} delta") for i in range(900)]
    items = [(0, "alpha beta"), (1, "delta w1 w4"), (2, "gamma"), (3, "beta delta")]
    got = lexical.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), postings=200)
    assert searched(got) == brute_search(rows, items, 10)
