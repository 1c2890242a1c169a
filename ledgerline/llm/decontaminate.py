"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test items' windows (``window`` consecutive words, or the whole of a shorter item) are the
patterns. Documents are searched in jumps: the last ``BLOCK`` words under the window give a shift, a
shift of 0 gives a bucket of patterns by suffix hash, and those are compared word by word. Patterns of
one length form one machine, so that short items don't shorten the jumps of the others.

The patterns are sent to the executors in blocks of at most ``max_words`` benchmark words; a larger
benchmark takes several passes in the same stage, each adding to what the row has so far. Null texts
have no words; an item without words has no window; a null item id counts as an empty string, and
items that repeat an id count once. Each document row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.words import alnum_words, slices
from ledgerline.llm.workspace import bounded_batches, unused

WINDOW = 10
BLOCK = 2
#: Benchmark words that one pass holds in memory at most, about; each stands for a window.
MAX_WORDS = 200_000


class WuManber:
    """Finds word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.step = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        self.items = patterns
        for p in patterns:
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.step), length - end)
            self.buckets[p[length - self.block :]].append(p)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(first word, pattern) of every occurrence."""
        m, block, step, shift = self.length, self.block, self.step, self.shift
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            jump = shift.get(key, step)
            if jump:
                end += jump
                continue
            seen = tuple(words[end - m : end])
            for p in self.buckets[key]:
                if p == seen:
                    yield end - m, p
                    break  # equal patterns are one
            end += 1


def machines(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """A machine for each pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = alnum_words(text)
        m = min(window, len(words))
        if m:
            for i in range(len(words) - m + 1):
                by_length[m][tuple(words[i : i + m])].add(item)
    return [WuManber(dict(p), m) for m, p in sorted(by_length.items())]


def find_hits(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges (end exclusive) inside occurrences, and the items with one."""
    found, items = [], set()
    for s in searchers:
        for at, pattern in s.search(words):
            found.append((at, at + s.length))
            items |= s.items[pattern]
    return merge(found), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, max_words: int = MAX_WORDS) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's rows in blocks of about ``max_words`` words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).head()[0] or 0
    n = max(1, -(-int(total) // max_words))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.toLocalIterator()]


def search_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> tuple[DataFrame, list[str]]:
    """The columns of ``docs`` with the number of words, hits (flat word ranges) and items, and the names of these three; no shuffle."""
    spark = docs.sparkSession
    own = n_words, found, matched = unused(docs, "n_words", "hits", "items")
    state = [T.StructField(n_words, T.LongType()), T.StructField(found, T.ArrayType(T.LongType())), T.StructField(matched, T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *state])
    out = bounded_batches(docs).select("*", F.lit(None).cast("long").alias(n_words), F.array().cast("array<long>").alias(found), F.array().cast("array<string>").alias(matched))
    for rows in benchmark_blocks(benchmark, max_words):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searchers = machines(sent.value, window)
            for b in slices(batches, "text"):
                counts, hits, names = [], [], []
                for text, old, had in zip(b.column("text"), b.column(found).to_pylist(), b.column(matched).to_pylist(), strict=True):
                    words = alnum_words(text.as_py())
                    ranges, items = find_hits(words, searchers)
                    counts.append(len(words))
                    hits.append([x for r in merge([*ranges, *zip(old[::2], old[1::2], strict=True)]) for x in r])
                    names.append(sorted(items.union(had)))
                cols = [*b.columns[: b.num_columns - 3], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        out = out.mapInArrow(run, schema)
    return out, own


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any occurrence of a test window, columns as they were."""
    found, own = search_benchmark(docs, benchmark, window)
    return found.filter(F.size(own[1]) == 0).drop(*own)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words hit, items found, their digest, and the word ranges."""
    found, (n_words, hits, items) = search_benchmark(docs.select("doc_id", "text"), benchmark, window)
    at = lambda i, k: F.element_at(hits, (2 * i + k).cast("int"))
    n = F.floor(F.size(hits) / 2).cast("int")
    hit = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, i: acc + at(i, 2) - at(i, 1))).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(hits) > 0).alias("contaminated"),
        F.col(hits).alias("hit_ranges"),
    )
