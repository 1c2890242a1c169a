"""Sets of word shingles as 64-bit hashes, computed a text at a time with numpy."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
#: Words hashed at once, so that a very long text needs no table of its own length.
_CHUNK_WORDS = 50_000


def _splitmix(n: int, state: int) -> list[int]:
    out = []
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return out


class ShingleHasher:
    """Hashes word windows as spans of the blank-joined text: a polynomial in random byte values, then mixed."""

    def __init__(self, size: int, seed: int = 1):
        *values, base = _splitmix(257, seed)
        self.size, self.values, base = size, np.array(values, np.uint64), base | 1
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            while len(self.powers) < n:
                k = len(self.powers)
                self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, k, 1 << 64))])
                self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(pow(self.inverse, k, 1 << 64))])

    def _spans(self, words: list[bytes], size: int) -> np.ndarray:
        raw = np.frombuffer(b" ".join(words), np.uint8)
        n = len(raw)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.values[raw] * self.powers[:n], out=sums[1:])
            blanks = np.flatnonzero(raw == 32)
            starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [n]])
            starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
            h = (sums[ends] - sums[starts]) * self.inverses[starts]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return (h ^ (h >> np.uint64(32))).view(np.int64)

    def spans(self, words: list[bytes]) -> list[np.ndarray]:
        """Hashes of all shingles, in parts; of the whole list if it is shorter than one."""
        size = min(self.size, len(words))
        return [self._spans(words[i : i + _CHUNK_WORDS + size - 1], size) for i in range(0, len(words) - size + 1, _CHUNK_WORDS)] if words else []

    def distinct(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        if not words:
            return np.empty(0, np.int64)
        parts = self.spans(words)
        return np.unique(np.concatenate(parts) if len(parts) > 1 else parts[0])
