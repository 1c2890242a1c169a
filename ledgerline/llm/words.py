"""Byte-level word helpers shared by the text operators.

Both word rules of the contracts are ASCII rules, so they are applied to UTF-8 bytes: bytes methods
fold and split ASCII only, and no byte of a multi-byte character is below 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: A-Z folded, 0-9, a-z and every byte of a non-ASCII character kept, the rest a space.
_ALNUM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, case kept."""
    return text.encode().split() if text else []


def lower_blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return text.encode().translate(_ALNUM).split() if text else []


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of ``column``, so that long texts don't pile up.

    At the end Arrow gives back the memory it has kept, as the worker lives on.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()
