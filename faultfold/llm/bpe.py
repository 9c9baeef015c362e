"""Byte-level BPE, encoded with a queue of merges and decoded from the vocabulary.

Encoding a piece of text keeps its symbols in a doubly linked list and the possible merges in a priority
queue ordered by rank and then place. A popped merge whose two symbols have changed meanwhile is stale
and skipped. Each worker remembers the ids of recent pieces in two generations of bounded size.

Decoding concatenates the vocabulary strings of the ids and reads their characters as bytes; bytes that
are no UTF-8 become replacement characters. Null text counts as empty and has no ids. Special tokens in
a text are encoded as themselves. In a list of ids, null and ids the vocabulary does not have decode to nothing.

Repeated rows and rows with a null ``doc_id`` are each encoded by themselves; of merges of equal rank the leftmost goes first.
A text is held whole with its ids, a long piece of it with its symbols and queue, about 300 bytes a character. An empty
table gives an empty one. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import bounded_batches

#: Entries of one generation of the memory.
MEMORY = 250_000
#: Longest piece that is remembered, in characters.
LONG = 48

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: The same for texts whose characters all lie below 256, as classes that the faster standard module knows.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_below_256 = re.compile(
    PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]")
    .replace(r"\p{L}", f"[{_L}]")
    .replace(r"\p{N}", f"[{_N}]")
    .replace(r"\s", f"[{_S}]")
    .replace(r"\S", f"[^{_S}]")
).findall
_any = regex.compile(PATTERN).findall


def pieces(text: str) -> list[str]:
    """The stretches of a text that are merged on their own."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _any(text)
    return _below_256(text)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Memory:
    """A dictionary that forgets: the older of two generations goes when the newer is full."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class ByteBpe:
    """Encoder and decoder of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        characters = byte_characters()
        self.byte_ids = [vocabulary[c] for c in characters]
        self.wide = max(vocabulary.values()) + 1
        self.merges = {}
        for rank, merge in enumerate(merges):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault(
                vocabulary[left] * self.wide + vocabulary[right], (rank, vocabulary[left + right])
            )
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.at_special = regex.compile("|".join(regex.escape(t) for t in self.special) or r"(?!)")
        value = {c: b for b, c in enumerate(characters)}
        self.strings = {i: bytes(value[c] for c in token) for token, i in vocabulary.items()}
        self.strings |= {i: token.encode() for token, i in self.special.items()}
        self.memory = Memory(MEMORY)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        ids, merges, wide = self.byte_ids, self.merges.get, self.wide
        symbols = [ids[b] for b in data]
        n = len(symbols)
        if n < 2:
            return tuple(symbols)
        queue, left = [], symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if found := merges(left * wide + right):
                queue.append((found[0], i - 1, found[1]))
            left = right
        heapify(queue)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i, merged = heappop(queue)
            j = following[i]
            left = symbols[i]
            if left < 0 or j >= n:
                continue
            found = merges(left * wide + symbols[j])
            if not found or found[0] != rank:
                continue  # stale: a neighbour was merged since
            symbols[i], symbols[j] = merged, -1
            after = following[i] = following[j]
            if after < n:
                before[after] = i
                if found := merges(merged * wide + symbols[after]):
                    heappush(queue, (found[0], i, found[1]))
            back = before[i]
            if back >= 0 and (found := merges(symbols[back] * wide + merged)):
                heappush(queue, (found[0], back, found[1]))
        return tuple([s for s in symbols if s >= 0])

    def _plain(self, text: str, out: list[int]) -> None:
        memory = self.memory
        new, old = memory.new, memory.old
        for piece in pieces(text):
            ids = new.get(piece)
            if ids is None:
                ids = old.get(piece) or self.merge(piece.encode())
                if len(piece) <= LONG:
                    memory.put(piece, ids)
                    new, old = memory.new, memory.old
            out.extend(ids)

    def plain(self, text: str) -> list[int]:
        """The ids of a text in which the strings of special tokens are plain text."""
        out: list[int] = []
        self._plain(text, out)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for special in self.at_special.finditer(text):
            self._plain(text[at : special.start()], out)
            out.append(self.special[special.group()])
            at = special.end()
        self._plain(text[at:], out)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.strings.get(i, b"") for i in ids]).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """One instance for each worker and file, kept with its memory from task to task."""
    return ByteBpe(path)


def encode(documents: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` of every whole text, and ``decoded``, the text read back from the ids, if asked for."""
    bounded_batches(documents.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                columns, names = [part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                if decoded:
                    columns, names = [*columns, pa.array([bpe.decode(i) for i in ids], pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
