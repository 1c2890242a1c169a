"""Ids of a public word-BPE tokenizer for whole texts, with a cache of white-space chunks.

The tokenizer never merges across white space, so a text's ids are those of its chunks in order. That
holds as it is for characters up to U+024F (canonical composition and case folding leave chunk borders
alone there); a text with any other character, or other white space, goes to the tokenizer whole. A new
chunk's pieces are merged by the file's own merges in a faster merger; the tests hold its ids against
the tokenizer's.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property
from itertools import pairwise
from pathlib import Path

import numpy as np
import regex
import tiktoken

_PLAIN = re.compile("[^\n\r\t\x20-\x7e¡-ɏ]")
#: Chunks after which a worker begins a new table of those it remembers; it has the table before at hand and moves what is used again. Longer chunks are not remembered.
CACHE_CHUNKS, CACHE_CHARS = 100_000, 40


#: How the vocabulary's words are cut out of a chunk, as its file says.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Stands for the word end in merges; no byte of UTF-8.
_WORD_END = b"\xff"


def _merges(path: str) -> tuple[tiktoken.core.CoreBPE, np.ndarray]:
    """The file's merges as byte ranks, which give the same pieces much faster, and the id of each rank.

    A word's last byte and the word end merge before all else, as they are one symbol in the file.
    """
    model = json.loads(Path(path).read_text())["model"]
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    spell = lambda piece: bytes(byte[c] for c in piece.removesuffix("</w>")) + _WORD_END * piece.endswith("</w>")
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _WORD_END: 256 + b for b in range(255)}
    ids = {}
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        ranks.setdefault(spell(a + b), len(ranks) + 1)
    for piece, i in model["vocab"].items():
        if not piece.startswith("<|") and (r := ranks.get(spell(piece))) is not None:
            ids[r] = i
    table = np.zeros(max(ranks.values()) + 1, "<u4")
    table[list(ids)] = list(ids.values())
    return tiktoken.Encoding("merges", pat_str=r"[^\s]+", mergeable_ranks=ranks, special_tokens={})._core_bpe, table


class ChunkTokenizer:
    def __init__(self, path: str):
        self.path = path
        self.merges, self.ids = _merges(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """Of 40 MB; loaded at the first text that can't be cut into chunks."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _ask_chunks(self, chunks: list[str]) -> list[bytes]:
        if any("<|" in c for c in chunks):  # may hold a special token
            return self._ask(chunks)
        merge, find = self.merges.encode_single_piece, _PIECES.findall
        ranks: list[int] = []
        ends = [0]
        for c in map(str.lower, chunks):
            for piece in (c,) if c.isalpha() else find(c):
                ranks += merge(piece.encode() + _WORD_END)
            ends.append(4 * len(ranks))
        raw = self.ids[ranks].tobytes()
        return [raw[a:b] for a, b in pairwise(ends)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; none for null."""
        chunks = [None if t and _PLAIN.search(t) else (t or "").split() for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.before = {}, self.known
        new = set().union(*(c for c in chunks if c)).difference(self.known)
        self.known.update({k: self.before[k] for k in new if k in self.before})
        asked = [k for k in new if k not in self.known]
        self.known.update(zip(asked, self._ask_chunks(asked), strict=True))
        whole = iter(self._ask([t for t, c in zip(texts, chunks, strict=True) if c is None]))
        out = [next(whole) if c is None else b"".join(map(self.known.__getitem__, c)) for c in chunks]
        for long in (k for k in asked if len(k) > CACHE_CHARS):
            del self.known[long]
        return out


_MADE: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer of this file."""
    if path not in _MADE:
        _MADE[path] = ChunkTokenizer(path)
    return _MADE[path]


def vocabulary(path: str) -> dict[str, int]:
    """All pieces of the file and their ids."""
    file = json.loads(Path(path).read_text())
    return file["model"]["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
