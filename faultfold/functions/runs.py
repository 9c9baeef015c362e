"""Runs of characters of a text that may be one of very many words.

A word is found through three fixed-size tables, whatever the number of words: the lengths that words have,
a bitmap of their first bytes, and a bitmap of hashes of whole words. All runs that pass are returned, and a few that
are no words; the caller joins them with the words by equality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.spans import first_bytes, lanes, mixed, span_hashes

#: Bits of the bitmaps: of first bytes, and of whole words.
START_BITS, WORD_BITS = 16, 20
#: Bytes at a word's start that are looked at first.
START = 4
#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 20


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _start_slots(view: np.ndarray, size: int) -> np.ndarray:
    return _slot(mixed(first_bytes(view, size) + np.uint64(size)), START_BITS)


class Finder:
    """The tables, and what they let pass of a text."""

    def __init__(self, lengths: list[int], starts: list[int], words: list[int]):
        """Lengths in bytes, and the set bits of both bitmaps."""
        self.lengths = sorted(lengths)
        self.starts, self.words = np.zeros(1 << START_BITS, bool), np.zeros(1 << WORD_BITS, bool)
        self.starts[starts], self.words[words] = True, True

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, starts and ends of runs that may be words."""
        view = lanes(data)[: len(data)]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        left = offsets[1:][row] - np.arange(len(data))
        found = []
        for size in sorted({min(n, START) for n in self.lengths if n}):
            at = np.flatnonzero(self.starts[_start_slots(view, size)] & (left >= size))
            for length in self.lengths:
                if min(length, START) == size:
                    here = at[left[at] >= length]
                    hashes = span_hashes(data, here, here + length, view=view)
                    here = here[self.words[_slot(hashes, WORD_BITS)]]
                    found.append(np.stack([row[here], here, here + length]))
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The distinct runs of each text. The empty run is in every text."""
        data, offsets = _utf8(texts)
        out: list[set[str]] = [{""} if 0 in self.lengths else set() for _ in range(len(texts))]
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
            part = offsets[lo : hi + 1]
            bytes_ = data[part[0] : part[-1]]
            raw = bytes_.tobytes()
            for row, start, end in zip(*(c.tolist() for c in self._chunk(bytes_, part - part[0]))):
                try:
                    out[lo + row].add(raw[start:end].decode())
                except UnicodeDecodeError:
                    pass  # it begins or ends inside a character, so it is no word
            lo = hi
        valid = texts.is_valid().to_pylist()
        return pa.array([list(runs) if v else None for runs, v in zip(out, valid)], pa.list_(pa.string()))


def _tables(words: pa.Array) -> pa.Array:
    """Length and both slots of each word."""
    data, offsets = _utf8(words)
    length = np.diff(offsets)
    view = lanes(data)
    start = np.zeros(len(words), np.int64)
    for size in range(1, START + 1):
        mine = np.flatnonzero(np.minimum(length, START) == size)
        start[mine] = _start_slots(view[offsets[mine]], size)
    word = _slot(span_hashes(data, offsets[:-1], offsets[1:]), WORD_BITS)
    return pa.StructArray.from_arrays(
        [pa.array(length, pa.int64()), pa.array(start, pa.int64()), pa.array(word, pa.int64())],
        ["length", "start", "word"],
    )


def finder(words: DataFrame) -> Finder:
    """The tables for the one column of ``words``. What reaches the driver is a row of 64 bits of a bitmap each, and
    the lengths: some thousand rows however many words there are."""
    slots = F.arrow_udf(_tables, "struct<length:bigint,start:bigint,word:bigint>")
    each = words.select(slots(F.col(words.columns[0])).alias("t")).select("t.*")
    lengths = [r[0] for r in each.select("length").distinct().collect()]

    def set_bits(name: str) -> list[int]:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(name), F.lit(64)).cast("int"))
        rows = each.groupBy((F.floor(F.col(name) / 64)).alias("block")).agg(F.bit_or(bit).alias("bits")).collect()
        return [r.block * 64 + k for r in rows for k in range(64) if r.bits >> k & 1]

    return Finder(lengths, set_bits("start"), set_bits("word"))


def possible_words(text: Column, found: Finder) -> Column:
    """``array<string>``: the runs of ``text`` that may be words."""
    return F.arrow_udf(lambda texts: found(texts), "array<string>")(text)
