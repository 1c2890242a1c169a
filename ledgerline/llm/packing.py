"""Order-preserving packing of tokenised documents into windows by dynamic programming.

The documents of an input partition form one stream of ids, each document closed by an end id. Cuts may
fall at document ends (free), sentence ends (a small penalty, the document is truncated) or, in a
sentence of over ``INSIDE_EVERY`` ids, at such steps inside it (a larger one). The cheapest set of cuts,
padding plus penalties, comes from f(j) = penalty(j) + window - p(j) + min(f(i) + p(i)) over cuts i at
most a window before j; the minimum slides with a monotone queue, so a cut costs constant time.

The stream is solved in blocks of about ``block_tokens`` ids; what follows the cheapest cut near a block's
end stays for the next. No shuffle: a partition leaves one partly filled window. Sequence ids hold the partition's
number and so stay the same when a lost task runs again on the same files. Null text counts as empty
and gives only the end id. Repeated rows are packed each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.tokens import chunk_tokenizer, default_path, vocabulary
from ledgerline.llm.words import slices
from ledgerline.llm.workspace import bounded_batches

WINDOW = 2048
END_ID = 1
SENTENCE_PENALTY, INSIDE_PENALTY, INSIDE_EVERY = 16, 64, 64
BLOCK_TOKENS = 1 << 17
PARTITION_SHIFT = 40


@cache
def _sentence_ends(path: str) -> np.ndarray:
    """Whether an id ends a sentence: it spells full stops, exclamation or question marks at a word's end."""
    pieces = vocabulary(path)
    ends = np.zeros(max(pieces.values()) + 1, bool)
    for piece, i in pieces.items():
        ends[i] = piece.endswith("</w>") and bool(body := piece[:-4]) and not body.strip(".!?")
    return ends


def choose_cuts(places: list[int], penalties: list[int], window: int, last: bool = True) -> list[int]:
    """The cheapest cuts from place 0 to the last place, or, if more is to come, to one less than a window before it.

    Neighbouring places lie at most a window apart.
    """
    best, back = [0.0] * len(places), [0] * len(places)
    queue: deque[int] = deque()
    for j in range(1, len(places)):
        i, p = j - 1, places[j]
        value = best[i] + places[i]
        while queue and best[queue[-1]] + places[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
        while p - places[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        best[j], back[j] = penalties[j] + window - p + best[i] + places[i], i
    cuts, j = [], len(places) - 1
    if not last:
        j = min((i for i in range(len(places)) if places[-1] - places[i] < window), key=lambda i: (best[i], -i))
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Where the stream may be cut and what each cut costs."""
    price = np.full(len(ids) + 1, -1, np.int64)
    price[1:][sentence_ends[ids]] = SENTENCE_PENALTY
    price[doc_ends - 1] = -1  # before a document's end id: cut after it instead
    price[doc_ends] = price[0] = 0
    places = np.flatnonzero(price >= 0)
    gaps = np.diff(places)
    step = min(window, INSIDE_EVERY)
    for a, gap in zip(places[:-1][gaps > step].tolist(), gaps[gaps > step].tolist(), strict=True):
        price[np.arange(a + step, a + gap, step)] = INSIDE_PENALTY
    places = np.flatnonzero(price >= 0)
    return places.tolist(), price[places].tolist()


class Packer:
    """Turns a stream of documents into pieces (doc, start, length, doc tokens, sequence, offset, ids)."""

    def __init__(self, path: str, window: int, first_sequence: int):
        self.ends, self.window, self.sequence = _sentence_ends(path), window, first_sequence
        self.docs: list[tuple[object, bytes, int]] = []  # id, its ids, how many of them are packed
        self.waiting = 0

    def add(self, doc_id: object, ids: bytes) -> None:
        self.docs.append((doc_id, ids, 0))
        self.waiting += len(ids) // 4

    def pack(self, last: bool) -> Iterator[tuple]:
        if not self.waiting:
            return
        ids = np.frombuffer(b"".join(raw[4 * done :] for _, raw, done in self.docs), "<u4")
        ends = np.cumsum([len(raw) // 4 - done for _, raw, done in self.docs])
        cuts = choose_cuts(*cut_places(ids, ends, self.ends, self.window), self.window, last)
        k, start, done = 0, 0, self.docs[0][2]
        for cut in cuts:
            at = start
            while at < cut:
                stop = min(cut, int(ends[k]))
                doc_id, raw, _ = self.docs[k]
                n = stop - at
                yield doc_id, done, n, len(raw) // 4, self.sequence, at - start, raw[4 * done : 4 * (done + n)]
                at, done = stop, done + n
                if stop == ends[k]:
                    k += 1
                    done = self.docs[k][2] if k < len(self.docs) else 0
            self.sequence, start = self.sequence + 1, cut
        self.docs = self.docs[k:]
        if self.docs:
            self.docs[0] = (*self.docs[0][:2], done)
        self.waiting = len(ids) - start


def pack_documents(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 32-bit)."""
    path = path or default_path()
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in names), T.StructField("ids", T.BinaryType())])
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(path)
        packer = Packer(path, window, TaskContext.get().partitionId() << PARTITION_SHIFT)
        kind = None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            doc, *numbers, raw = [list(c) for c in zip(*packer.pack(last), strict=True)] or [[] for _ in range(7)]
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(doc, kind), *(pa.array(c, pa.int64()) for c in numbers), pa.array(raw, pa.binary())], ["doc_id", *names, "ids"])

        for b in slices(batches, "text", 1 << 20):
            kind = b.schema.field("doc_id").type
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), tokenizer.encode(b.column("text").to_pylist()), strict=True):
                packer.add(doc_id, raw + closing)
                if packer.waiting >= block_tokens:
                    yield from out(False)
        yield from out(True)

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def packing_digest(pieces: DataFrame) -> DataFrame:
    """``pack_documents`` rows with the ids' checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
