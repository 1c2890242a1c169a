"""Quality rules: base counts, then a linear-chain conditional random field over a document's lines.

Each line with a word is a step of the chain; Viterbi decoding marks it content or boilerplate, and
the share of words in content lines decides retention. The field is trained in numpy from document
labels (``quality`` 1: its lines count as content, 0: as boilerplate) on at most ``max_docs`` labelled
documents with all their lines, which a hash of the id picks; without usable labels the prior weights hold. Everything else covers every line of every row.

Null text has no words. Each input row gives one row, repeated rows included. Null labels are left
out; of several labels of one id the smallest counts, and so does the smallest of its texts. An empty text fails the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.words import slices
from ledgerline.llm.workspace import bounded_batches

_SPACE, _SYMBOLS, _DIGITS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"0123456789"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FEATURES = ("bias", "symbols", "bars", "capitals", "shouts", "digits", "unfinished", "short", "repeated", "monotone", "long_words")
#: Weights of content against boilerplate before any label is seen.
_PRIOR = np.array([2.0, -12.0, -8.0, -3.0, -3.0, -3.0, -0.5, -0.5, -1.0, -2.0, -1.0])
_PRIOR_MOVES = np.array([[0.5, -0.5], [-0.5, 0.5]])


@dataclass(frozen=True)
class LineField:
    """Weights of a line's features for content, and of each move between boilerplate (0) and content (1)."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, x: np.ndarray) -> list[int]:
        """Viterbi path over the lines of one document."""
        (bb, bc), (cb, cc) = self.moves.tolist()
        scores = (x @ self.weights).tolist()
        b, c, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_b, from_c = b + bc >= c + cc, b + bb >= c + cb
            back.append((0 if from_c else 1, 0 if from_b else 1))
            b, c = max(b + bb, c + cb), max(b + bc, c + cc) + s
        path = [int(c >= b)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def line_features(lines: list[bytes]) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word, and the number of those that repeat an earlier one."""
    rows, sizes, seen, repeats = [], [], set(), 0
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        count = lambda chars: n - len(line.translate(None, chars))  # noqa: B023, E731
        upper, lower = count(_UPPER), count(_LOWER)
        again = line in seen
        repeats += again
        seen.add(line)
        rows.append([
            1.0, count(_SYMBOLS) / n, min(1.0, 4 * line.count(b"|") / k), upper / max(1, upper + lower), min(1.0, 2 * line.count(b"!!") / k), count(_DIGITS) / n,
            0.0 if words[-1][-1:] in b".!?:;" else 1.0, 1.0 if k < 3 else 0.0, float(again), 1 - len(set(words)) / k if k >= 8 else 0.0, 1.0 if n > 16 * k else 0.0,
        ])
        sizes.append(k)
    return rows, sizes, repeats


def repeated_window_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of eight words that the list holds twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    with np.errstate(over="ignore"):
        h, p = np.fromiter(map(hash, words), np.int64, n).view(np.uint64), np.uint64(0x9E3779B97F4A7C15)
        for step in (1, 2, 4):  # doubles the window
            h = h[:-step] * p + h[step:]
            p = p * p
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    inside = np.zeros(n, bool)
    for k in range(window):
        inside[starts + k] = True
    return int(inside.sum())


def train_field(documents: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.5, pull: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient ascent with momentum, drawn to the prior; all documents at once.

    A document is its lines' features (a row a line) and its label. Lines lie by their place in the document and
    longer documents come first, so that those which have a line at a place are the first ones there and
    nothing is filled up to the longest.
    """
    w, moves = _PRIOR.copy(), _PRIOR_MOVES.copy()
    documents = sorted(((x, y) for x, y in documents if len(x)), key=lambda d: -len(d[0]))
    if len({y for _, y in documents}) < 2:
        return LineField(w, moves)
    sizes, y = np.array([len(x) for x, _ in documents]), np.array([y for _, y in documents])
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    starts = np.cumsum(active) - active
    doc = np.concatenate([np.arange(m) for m in active])
    place = np.repeat(np.arange(sizes[0]), active)
    x = np.concatenate([x for x, _ in documents])[(np.cumsum(sizes) - sizes)[doc] + place]
    ends = starts[sizes - 1] + np.arange(len(sizes))
    later = np.arange(active[0], len(doc))
    earlier = starts[place[later] - 1] + doc[later]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # both classes weigh the same
    share = (share / sizes)[doc]
    speed_w, speed_m = np.zeros_like(w), np.zeros_like(moves)
    for _ in range(rounds):
        s = x @ w
        a, b = np.zeros((len(doc), 2)), np.zeros((len(doc), 2))
        a[: active[0], 1] = s[: active[0]]
        for at, before, m in zip(starts[1:], starts[:-1], active[1:], strict=True):
            had = a[before : before + m]
            step = np.logaddexp(had[:, :1] + moves[0], had[:, 1:] + moves[1])
            step[:, 1] += s[at : at + m]
            a[at : at + m] = step
        for at, before, m in zip(starts[:0:-1], starts[-2::-1], active[:0:-1], strict=True):
            ahead = b[at : at + m].copy()
            ahead[:, 1] += s[at : at + m]
            b[before : before + m] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        z = np.logaddexp(a[ends, 0], a[ends, 1])[doc]
        grad_w = x.T @ (share * (y[doc] - np.exp(a[:, 1] + b[:, 1] - z)))
        grad_m = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                p = np.exp(a[earlier, i] + moves[i, j] + j * s[later] + b[later, j] - z[later])
                grad_m[i, j] = (share[later] * (((y == i) & (y == j))[doc[later]] - p)).sum()
        speed_w = 0.9 * speed_w + rate * (grad_w + pull * (_PRIOR - w))
        speed_m = 0.9 * speed_m + rate * (grad_m + pull * (_PRIOR_MOVES - moves))
        w, moves = w + speed_w, moves + speed_m
    return LineField(w, moves)


def fit_line_field(docs: DataFrame, labels: DataFrame, max_docs: int = 2000) -> LineField:
    """A field trained on all lines of a bounded, hash-picked sample of labelled documents, one text an id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            xs = [np.array(line_features(t.as_py().encode().split(b"\n"))[0]).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(xs, pa.binary())], ["doc_id", "quality", "x"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("quality", T.IntegerType()), T.StructField("x", T.BinaryType())])
    sample = bounded_batches(rows).mapInArrow(run, schema).orderBy("doc_id").collect()  # a row for each picked id at most
    return train_field([(np.frombuffer(r.x).reshape(-1, len(FEATURES)), r.quality) for r in sample])


def judge(text: str | None, field: LineField, min_words: int, max_repeat_percent: int, min_content: float) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    rows, sizes, repeats = line_features(raw.split(b"\n"))
    repeated = repeated_window_words(words)
    failed = n < min_words or 100 * repeated > max_repeat_percent * n
    share = sum(k for k, label in zip(sizes, field.decode(np.array(rows)), strict=True) if label) / n if rows else 0.0
    return n, chars, symbols, repeats, repeated, failed, not failed and share >= min_content, share


_REPORT = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("content_share", T.DoubleType())]


def quality_report(docs: DataFrame, field: LineField, min_words: int = 20, max_repeat_percent: int = 30, min_content: float = 0.5) -> DataFrame:
    """Counts and verdict for every document; no shuffle."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in _REPORT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [judge(t.as_py(), field, min_words, max_repeat_percent, min_content) for t in b.column("text")]
            cols = [pa.array(c, {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}[t]) for c, (_, t) in zip(zip(*rows, strict=True), _REPORT, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *(n for n, _ in _REPORT)])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, field: LineField, min_words: int = 20, max_repeat_percent: int = 30, min_content: float = 0.5) -> DataFrame:
    """The documents that pass, columns as they were; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array([judge(t.as_py(), field, min_words, max_repeat_percent, min_content)[6] for t in b.column("text")], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
