"""Alignment of two tokenizers' tokens, in Arrow.

Each text is encoded as space + text by a byte-level BPE file (A) and by a sentencepiece model (B), which adds
the space itself. A token's bytes are its vocabulary string's; running sums of their lengths within a
document give the byte offset at which each token ends. Ends that both have, found by a hash join on
(document, end), cut the tokens into groups, and link each A token to each B token that ends there.

The steps: a batch's token lists are flattened next to the index of their document, ends are segmented running
sums, links come from the join and are counted by (document, A id, B id) inside the batch. Documents are written with their counted links
and lie in stacks of about :data:`STACK_BYTES` of text, in the order of reading. A stack sends each id pair once with its count; Spark adds
these up, finds each B id's highest count, and tells every stack the totals of its own pairs. So a pair that all
documents have costs one row a stack, and no table of all pairs is held anywhere.

Texts that are null or empty, or whose joined tokens of A or B are not the bytes of space + text, have no
tokens. Special tokens in a text are plain text. Rows that repeat an id are documents of their own; null ids take part.
Ties between highest counts all count as highest. A very long text is one row of a batch of its own. Further
columns are ignored, whatever their names. Without documents the result is empty.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm import bpe
from faultfold.llm.common import bounded_batches, dropped, written

#: Bytes of text encoded at once, and of a stack.
CHUNK_BYTES, STACK_BYTES = 1 << 20, 4 << 20
#: Bits of the byte offset within a document.
PLACE_BITS = 40


#: Segments remembered by a worker in each of two generations, and the longest of them.
MEMORY, LONG = 250_000, 48

# A segment begins with its white space; no piece of the model reaches from other characters into white space.
_segments = re.compile(" +[^ ]*").findall
#: White space as long as this goes to the merges of :mod:`bpe`, as the pattern would recurse too deep.
_long_space = re.compile(r"\s{1000}").search


class Tokenizers:
    """Both tokenizers, and each one's token bytes and decimal ids by id.

    A's vocabulary has its merges in the order of its ids, so tiktoken gives the same ids as its own library, several times
    faster. B's model changes no character, so the segments of a text are encoded one by one and remembered.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        self.bpe = bpe.ByteBpe(path_a)
        strings = {i: b for i, b in self.bpe.strings.items() if i not in self.bpe.special.values()}
        self.a = None
        if [i for _, i in sorted(self.bpe.merges.values())] == sorted(set(strings) - set(self.bpe.byte_ids)):
            ranks = {b: i for i, b in strings.items()}
            self.a = Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = pa.array([strings.get(i, b"") for i in range(self.bpe.wide)], pa.large_binary())
        self.b = SentencePieceProcessor(model_file=path_b)
        size_b = self.b.get_piece_size()
        self.bytes_b = pa.array([self._piece(i) for i in range(size_b)], pa.large_binary())
        self.decimals = pa.array([str(i) for i in range(max(self.bpe.wide, size_b))], pa.string())
        self.whole = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(size_b)) or self.b.encode(
            "ﬁ ½  é"
        ) != [i for part in ("ﬁ", "½", " é") for i in self.b.encode(part)]
        self.space = self.b.piece_to_id("▁")
        self.memory = bpe.Memory(MEMORY)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode_a(self, spelled: str) -> list[int]:
        if self.a is not None and not _long_space(spelled):
            return self.a.encode_ordinary(spelled)
        return self.bpe.plain(spelled)

    def _encode_b(self, spelled: list[str]) -> list[list[int]]:
        """The ids of texts that begin with the space that B adds. What is new in any of them is encoded in one call."""
        if self.whole:
            return self.b.encode([t[1:] for t in spelled], num_threads=1)
        memory, segments = self.memory, [_segments(t) for t in spelled]
        parts = [list(map(memory.new.get, own)) for own in segments]
        found = {x: memory.old.get(x) for own, ids in zip(segments, parts) if None in ids for x, i in zip(own, ids) if i is None}
        fresh = [x for x, ids in found.items() if ids is None]
        if fresh:
            found.update(zip(fresh, self.b.encode([x[1:] for x in fresh], num_threads=1)))
        if " " in found:
            found[" "] = [self.space]
        out = []
        for own, ids in zip(segments, parts):
            if None in ids:
                ids = [found[x] if i is None else i for x, i in zip(own, ids)]
            out.append(list(chain.from_iterable(ids)))
        for x, ids in found.items():
            if len(x) <= LONG:
                memory.put(x, ids)
        return out

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """The token ids of each text, empty where a text has no tokens."""
        spelled = [" " + t if t else "" for t in texts]
        a = pa.array([self._encode_a(t) if t else [] for t in spelled], _IDS)
        b = pa.array(self._encode_b(spelled), _IDS)
        spelled = pa.array(spelled, pa.large_string())
        good = _spells(a, self.bytes_a, spelled) & _spells(b, self.bytes_b, spelled)
        if good.all():
            return a, b
        nothing = pa.scalar([], _IDS)
        return pc.if_else(pa.array(good), a, nothing), pc.if_else(pa.array(good), b, nothing)


_IDS = pa.large_list(pa.int32())


def _spells(ids: pa.ListArray, strings: pa.Array, texts: pa.Array) -> np.ndarray:
    """Whether the joined bytes of each row's tokens are the bytes of its text."""
    joined = strings.take(ids.flatten())
    ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
    ends = ends[np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]]
    wanted = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    have, want = memoryview(joined.buffers()[2] or b""), memoryview(texts.buffers()[2] or b"")
    return np.array(
        [
            have[ends[i] : ends[i + 1]] == want[wanted[i] : wanted[i + 1]]
            for i in range(len(ids))
        ],
        bool,
    )


@lru_cache(maxsize=2)
def loaded(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _ended(ids: pa.ListArray, strings: pa.Array, name: str) -> pa.Table:
    """``at, <name>``: each token with its document and the byte offset where it ends there, as one number."""
    flat = ids.flatten()
    parent = pc.cast(pc.list_parent_indices(ids), pa.int64())
    running = pc.cumulative_sum(pc.cast(pc.binary_length(strings.take(flat)), pa.int64()))
    first = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids)]
    base = np.concatenate([[0], running.to_numpy()])[first]
    end = pc.subtract(running, pa.array(base).take(parent))
    return pa.table({"at": pc.add(pc.shift_left(parent, pa.scalar(PLACE_BITS, pa.int64())), end), name: flat})


def _group_strings(tokens: pa.Table, name: str, cuts: np.ndarray, decimals: pa.Array) -> pa.Array:
    """The ids of each group, joined by commas."""
    group = np.searchsorted(cuts, tokens["at"].to_numpy())
    offsets = np.searchsorted(group, np.arange(len(cuts) + 1))
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), decimals.take(tokens[name].combine_chunks()))
    return pc.binary_join(listed, ",")


def _aligned(texts: list[str], tools: Tokenizers) -> pa.Table:
    """Counts, groups and counted links of each text."""
    ids_a, ids_b = tools.encode(texts)
    a, b = _ended(ids_a, tools.bytes_a, "a"), _ended(ids_b, tools.bytes_b, "b")
    links = a.join(b, keys="at", join_type="inner", use_threads=False)
    at = np.sort(links["at"].to_numpy())
    cuts = at[np.append(True, at[1:] != at[:-1])[: len(at)]]
    document = cuts >> PLACE_BITS
    links = links.append_column("document", pc.shift_right(links["at"], pa.scalar(PLACE_BITS, pa.int64())))
    groups = pc.binary_join_element_wise(
        _group_strings(a, "a", cuts, tools.decimals), _group_strings(b, "b", cuts, tools.decimals), "|"
    )
    rows = np.arange(len(texts) + 1)
    by_document = pa.ListArray.from_arrays(pa.array(np.searchsorted(document, rows), pa.int32()), groups)
    counted = links.group_by(["document", "a", "b"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by("document")
    triples = np.stack([counted[c].to_numpy().astype("<i4") for c in ("a", "b", "count_all")], 1)
    first = np.searchsorted(counted["document"].to_numpy(), rows)
    return pa.table(
        {
            "n_a": pc.cast(pc.list_value_length(ids_a), pa.int64()),
            "n_b": pc.cast(pc.list_value_length(ids_b), pa.int64()),
            "n_groups": np.diff(np.searchsorted(document, rows)),
            "n_links": np.bincount(at >> PLACE_BITS, minlength=len(texts)),
            "groups": pc.cast(pc.binary_join(by_document, ";"), pa.string()),
            "pairs": pa.array([triples[x:y].tobytes() for x, y in zip(first, first[1:])], pa.binary()),
        }
    )


def align(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, stack, n_a, n_b, n_groups, n_links, groups, pairs`` of every whole text.

    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``; ``pairs`` holds the distinct linked ids and their
    number as 32-bit triples. ``stack`` is what :func:`with_counts` gathers counts by.
    """
    bounded_batches(documents.sparkSession)

    def run(batches):
        tools, size = loaded(path_a, path_b), 0
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            part = batch.column(2)
            at = 0
            while at < len(texts):
                to, held = at + 1, len(texts[at])
                while to < len(texts) and held + len(texts[to]) <= CHUNK_BYTES // 4:
                    held += len(texts[to])
                    to += 1
                stack = (part[at].as_py() << 32) + size // STACK_BYTES
                size += sum(len(t.encode()) for t in texts[at:to])
                rows = _aligned(texts[at:to], tools)
                rows = rows.add_column(0, "doc_id", batch.column(0).slice(at, to - at))
                rows = rows.add_column(1, "stack", pa.array(np.full(to - at, stack)))
                yield from rows.combine_chunks().to_batches()
                at = to

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(
        run,
        "doc_id long, stack long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary",
    )


def _pair_table(column) -> pa.Table:
    """``row, a, b, n`` from packed pairs."""
    raw = column.to_pylist()
    triples = np.frombuffer(b"".join(raw), "<i4").reshape(-1, 3)
    row = np.repeat(np.arange(len(raw)), [len(r) // 12 for r in raw])
    return pa.table({"row": row, "a": triples[:, 0], "b": triples[:, 1], "n": triples[:, 2].astype(np.int64)})


def _stack_counts(batches):
    """``stack, a, b, n``: the pairs of a batch's stacks with their number."""
    for batch in batches:
        if batch.num_rows:
            pairs = _pair_table(batch.column(1))
            pairs = pairs.append_column("stack", batch.column(0).take(pairs["row"].combine_chunks()))
            counts = pairs.group_by(["stack", "a", "b"], use_threads=False).aggregate([("n", "sum")])
            counts = counts.select(["stack", "a", "b", "n_sum"]).rename_columns(["stack", "a", "b", "n"])
            yield from counts.combine_chunks().to_batches()


def _told(columns: list[str]):
    """A stack's documents with the sums over their links."""

    def run(key, documents, totals):
        pairs = _pair_table(documents.column("pairs"))
        known = pairs.join(totals.select(["a", "b", "total", "best"]), keys=["a", "b"], use_threads=False)
        known = known.append_column("counted", pc.multiply(known["n"], known["total"]))
        known = known.append_column("n_best", pc.multiply(known["n"], pc.cast(known["best"], pa.int64())))
        sums = known.group_by("row", use_threads=False).aggregate([("n_best", "sum"), ("counted", "sum")])
        out = np.zeros((2, documents.num_rows), np.int64)
        out[0, sums["row"].to_numpy()], out[1, sums["row"].to_numpy()] = (
            sums["n_best_sum"].to_numpy(),
            sums["counted_sum"].to_numpy(),
        )
        return documents.select(columns).append_column("n_best", pa.array(out[0])).append_column(
            "count_sum", pa.array(out[1])
        )

    return run


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, total, best``: links of each id pair in all documents, and whether no pair of the B id has more."""
    counts = rows.select("stack", "pairs").mapInArrow(_stack_counts, "stack long, a int, b int, n long")
    return _totals(counts)


def _totals(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("a", "b").agg(F.sum("n").alias("total"))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame) -> DataFrame:
    """Rows of :func:`align`, with any columns added or dropped but ``stack`` and ``pairs``, and with ``n_best``
    and ``count_sum`` in place of these two."""
    rows = written(rows, "alignment")
    counts = rows.select("stack", "pairs").mapInArrow(_stack_counts, "stack long, a int, b int, n long")
    counts = written(counts, "pair-counts")
    totals = written(_totals(counts), "pair-totals")
    told = counts.select("stack", "a", "b").distinct().join(totals, ["a", "b"])
    told = written(told.select("stack", "a", "b", "total", "best"), "pairs-told")
    columns = [c for c in rows.columns if c not in ("stack", "pairs")]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in columns) + ", n_best long, count_sum long"
    dropped(counts)
    dropped(totals)
    return rows.groupBy("stack").cogroup(told.groupBy("stack")).applyInArrow(_told(columns), schema)
