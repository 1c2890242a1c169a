"""The Jaccard join against a search of all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm import jaccard, workspace
from ledgerline.llm.shingles import ShingleHasher
from ledgerline.llm.workspace import Workspace, components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_components(table, k, percent):
    sets = [plain_set(t, k) for _, t in table]
    parent = list(range(len(table)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for own in holders.values():
        for i in own:
            for j in own:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(table):
        r = root(i)
        least[r] = doc if least.get(r) is None else least[r] if doc is None else min(least[r], doc)
    return sorted(((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(table, sets, strict=True))), key=str)


def made_table(seed, hot=60):
    """Exact and near copies, a passage in many documents, short documents and chains of edits."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base, table = text(40), text(90), []
    for i in range(150):
        table.append(passage + text(rng.randrange(1, 60)) if i % 3 == 0 else text(rng.randrange(1, 80)))
    for _ in range(hot):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        table.append(t)
    chain = text(100)
    for _ in range(15):
        chain = list(chain)
        chain[rng.randrange(100)] = rng.choice(words)
        table += [chain, [w.upper() for w in chain]]
    table += [passage, [*passage, "x"], ["a"], ["A"], ["a", "b"], ["a", "b", "c"], ["B", "a"], []]
    rng.shuffle(table)
    return [(i, " ".join(t)) for i, t in enumerate(table)]


@pytest.mark.parametrize(("seed", "counters", "few"), [(1, 1 << 12, 1_000_000), (2, 16, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, counters, few):
    monkeypatch.setattr(jaccard, "MIN_COUNTERS", counters)
    monkeypatch.setattr(jaccard, "MAX_COUNTERS", counters)
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", few)  # few: keys of many rows are joined apart
    table = made_table(seed)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_rows(df, hot=8).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(table, 4, 85)


def test_components_of_documents(docs):
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str) == plain_components(table, 4, 85)


def test_odd_tables(odd, none):
    table = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.jaccard_components(odd).collect()), key=str) == plain_components(table, 4, 85)
    assert jaccard.jaccard_components(none).count() == 0


def test_keep_first(odd, none, docs):
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect() if r.doc_id != 4) == sorted([("1", ""), ("2", ""), ("None", "some text without an id"), ("3", " \n\t "), ("5", "same words here"), ("5", "other words here"), ("7", "Été çà Éİ ﬁ \U0001f600 naïve")])
    assert jaccard.keep_first(none).count() == 0
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {c for d, n, c in plain_components(table, 5, 80) if n}
    assert {r.doc_id for r in jaccard.keep_first(docs).collect()} == want


def test_hasher_chunks_agree(monkeypatch):
    words = [str(i % 977).encode() for i in range(5000)]
    whole = ShingleHasher(4).distinct(words)
    monkeypatch.setattr("ledgerline.llm.shingles._CHUNK_WORDS", 64)
    assert np.array_equal(whole, ShingleHasher(4).distinct(words))
    assert len(whole) == len({tuple(words[i : i + 4]) for i in range(4997)})


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark), "t").collect()))
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert got == parent


def test_maps_of_long_documents(spark):
    """Long documents that share a passage are told apart by their bit maps, and maps of two lengths lose no link."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 3000)
    edge = int(jaccard.MAP_LOAD * 64 * jaccard.MAP_LONGS)
    near = rng.integers(-(1 << 62), 1 << 62, edge + 60)
    sets = [base, np.concatenate([base[:100], rng.integers(-(1 << 62), 1 << 62, 2900)]), np.append(base[150:], rng.integers(0, 9, 1)), near, near[:-100], near[80:]]
    maps = spark.createDataFrame([(i, len(s), jaccard._bit_map(s).tolist()) for i, s in enumerate(sets)], "unit long, n long, map array<long>")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)], "a long, b long")
    linked = {(a, b) for a in range(6) for b in range(a + 1, 6) if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    assert {len(jaccard._bit_map(s)) for s in sets} == {16, 32, 64, 128}
    thin = {tuple(r) for r in jaccard._thin(pairs, maps, 85).collect()}
    assert linked == {(0, 2), (3, 4), (3, 5)}
    assert linked <= thin <= linked | {(4, 5)}  # these two are linked but for a few shingles
