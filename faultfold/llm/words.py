"""Words of an Arrow text column, found and hashed in its UTF-8 bytes without Python strings.

A word is a run of characters other than space and ``\\t`` to ``\\r``. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from faultfold.functions.spans import mixed, span_hashes

__all__ = ["CHUNK_BYTES", "LOWER", "Words", "mixed", "per_row", "split_words", "utf8", "word_chunks"]

#: Bytes handled at once. A longer text is handled alone; working memory is about 40 times this.
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, CHUNK_BYTES) + 1, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


@dataclass
class Words:
    """``data`` holds the bytes, ``offsets`` where texts begin, and each word has a start, an end and its text's row."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, which equal words alone have; ``lower`` maps A-Z to a-z first."""
        return span_hashes(LOWER[self.data] if lower else self.data, self.start, self.end)

    def prefix_hashes(self) -> np.ndarray:
        """Sums for :meth:`window_hashes`, whose hashes are good enough for features, not for telling texts apart."""
        codes = _BYTE[self.data]
        codes *= powers(_BASE, len(codes))[: len(codes)]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        return sums

    def window_hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the bytes from ``start`` to ``end``; equal bytes have equal hashes wherever they are."""
        return (sums[end] - sums[start]) * powers(_INVERSE, len(self.data))[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~WHITE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first] = solid[first]
    ends[last] = solid[last]
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1)


def word_chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Consecutive rows of ``column`` from a first to before a last, with their words, :data:`CHUNK_BYTES` at a time."""
    if not len(column):
        return
    data, offsets = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
        part = offsets[lo : hi + 1]
        yield lo, hi, split_words(data[part[0] : part[-1]], part - part[0])
        lo = hi


def per_row(values: np.ndarray, first: np.ndarray, add=np.add) -> np.ndarray:
    """``values`` of words reduced by text; 0 for texts without words. ``first`` as by :meth:`Words.first`."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = add.reduceat(values, first[:-1][full])
    return out
