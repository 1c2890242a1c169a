"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits, checksum validation.

Every whole text goes once through the automaton; a regular expression is only tried at the place of
a keyword hit. Hexadecimal runs have no keyword, so the text's character classes are searched for 24
hexadecimal characters in a row instead. Token formats that embed a checksum (``github``, ``npm``:
CRC-32 in base 62; ``xprv``: base58 with a double SHA-256) are reported only if it holds.

Null text counts as empty. Each input row gives one row, repeated rows included; other columns are
ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.words import slices

BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm", "xprv")
KINDS = BASE_KINDS + CHECKED_KINDS

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_CRC_TOKEN = re.compile(rb"(?:gh[pousr]_|npm_)([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_XPRV = re.compile(rb"xprv([1-9A-HJ-NP-Za-km-z]{107})(?![0-9A-Za-z])")
_ANCHORS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
_HEX_CLASS = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_HEX_RUN = b"h" * 24
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in _ANCHORS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def crc_base62(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six base-62 digits, the check that ends such tokens."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.encode()


def base58_check(text: bytes) -> bool:
    """Whether the last four of the 82 bytes that ``text`` spells check the others."""
    n = 0
    for c in text.decode():
        n = n * 58 + _BASE58.index(c)
    if n >> (82 * 8):
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _near(kind: str, raw: bytes, at: int) -> int:
    """End of a secret of this kind that starts at this byte, 0 if what matches is too short, -1 without a match."""
    if kind == "assign":
        m = _ASSIGN.match(raw, at)
        return -1 if m is None else m.end() if len(m[1]) >= 6 else -m.end()
    if kind == "access":
        m = _ACCESS.match(raw, at)
        return -1 if m is None else m.end() if m.end() - at >= 20 else -m.end()
    if kind == "xprv":
        m = _XPRV.match(raw, at)
        return m.end() if m and base58_check(m[0]) else -1
    m = _CRC_TOKEN.match(raw, at)
    return m.end() if m and crc_base62(m[1][:30]) == m[1][30:] else -1


def _hex_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    classes, at = raw.translate(_HEX_CLASS), 0
    while (at := classes.find(_HEX_RUN, at)) >= 0:
        end = classes.find(b" ", at)
        end = len(raw) if end < 0 else end
        yield at, end
        at = end


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind in the order of KINDS."""
    if not text:
        return []
    raw = text.encode()
    found = [(a, b, "hex") for a, b in _hex_runs(raw)]
    hits = [(end - n + 1, kind) for end, (kind, n) in _automaton().iter(raw.lower().decode("latin-1"))]
    done: dict[str, int] = {}
    for at, kind in sorted(hits):
        if at < done.get(kind, 0):
            continue  # inside the kind's last match
        end = _near(kind, raw, at)
        if end != -1:
            done[kind] = abs(end)
            if end > 0:
                found.append((at, end, kind))
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    if len(raw) == len(text) or not found:
        return found
    place, at, n = {}, 0, 0
    for b in sorted({x for a, e, _ in found for x in (a, e)}):  # bytes to code points
        n += len(raw[at:b].decode())
        place[b], at = n, b
    return [(place[a], place[e], kind) for a, e, kind in found]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``secrets``, an array of (start, end, kind)."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("secrets", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t.as_py())] for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(rows, arrow)], [id_col, "secrets"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and span list of ``scan_secrets`` rows."""
    line = lambda kinds: F.array_join(F.transform(F.filter("secrets", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(line(BASE_KINDS), 256).alias("base_sha256"),
        line(KINDS).alias("spans"),
    )
