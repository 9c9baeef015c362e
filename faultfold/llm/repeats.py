"""Removal of repeated passages by fixed-block anchors.

A window is ``window`` consecutive words of one document; every word covered by a window whose words also
start anywhere else, in the same document or another, is removed. All windows are judged on the input.

1. Each document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words, so every window
   holds a whole one. All documents are probed with every rolling run of that many words. Documents lie in
   stacks of about :data:`STACK_BYTES` of text by their hash; a stack sends each distinct run once, with the
   mark whether it is a reference block there. An anchor is a run that is a reference block somewhere and
   occurs twice or more; the stacks that hold it are told.
2. Around its anchors a stack extends hits to all windows that hold one, and sends each distinct window once.
   Equal windows meet there: those that occur twice or more are the pieces of the maximal exact repeats, and
   the stacks that hold them are told.
3. Documents with such windows lose the words they cover.

What stacks send is packed by buckets of the hash, of about :data:`BUCKET_RUNS` runs each; so there are more
buckets of more input, never larger ones. No pair of occurrences is ever formed, and a passage that a
third of all documents share costs one entry a stack. Within its bucket a run is known by 32 bits: others that share them cost a
needless comparison. Windows are compared by two independent hashes of 64 bits, made from hashes of whole words.

Words are runs of characters other than space and ``\t`` to ``\r``, unchanged. Null and empty texts have none
and give an empty text. Texts below ``window`` words stay whole. Rows that repeat an id are documents of their own, so exact
copies of ``window`` words or more lose everything; null ids take part. A very long text lies in one task, with
arrays of about 40 times its bytes. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import bounded_batches, dropped, written
from faultfold.llm.spans import ranges, span_hashes, window_hashes
from faultfold.llm.words import Words, word_chunks

WINDOW = 35
STACK_BYTES = 8 << 20
#: Runs of a bucket, and bytes of text that are reckoned to hold a word.
BUCKET_RUNS, WORD_BYTES = 1 << 20, 6
#: Marks of a run in a stack.
REFERENCE, SEVERAL = 1, 2


def _within(words: Words, size: int) -> np.ndarray:
    """Whether ``size`` words from each place on lie in one text."""
    n = len(words.row) - size + 1
    return words.row[:n] == words.row[size - 1 :] if n > 0 else np.zeros(0, bool)


def _runs(words: Words, size: int, window: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of ``size`` words, of texts with ``window`` words at least."""
    long = words.counts() >= window
    place = np.flatnonzero(_within(words, size))
    place = place[long[words.row[place]]]
    return place, window_hashes(span_hashes(words.data, words.start, words.end, seed), size)[place]


def _distinct(hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, with all its marks."""
    order = np.argsort(hashes)
    hashes, marks = hashes[order], marks[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    if not len(first):
        return hashes, marks
    several = np.diff(np.append(first, len(hashes))) > 1
    return hashes[first], np.bitwise_or.reduceat(marks, first) | np.where(several, SEVERAL, 0).astype(np.int8)


def _buckets(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted hashes, and where each one's begin."""
    bucket = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    return np.unique(bucket, return_index=True)


def _slices(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Values from each of ``first`` to before the next, as bytes."""
    return pa.array([part.tobytes() for part in np.split(values, first[1:])] if len(first) else [], pa.binary())


def _probes(window: int, bits: int):
    """The distinct runs of a stack by bucket."""
    size = (window + 1) // 2

    def run(key, table):
        hashes, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
        for _, _, words in word_chunks(table.column("text")):
            place, found = _runs(words, size, window)
            hashes.append(found >> np.uint64(32 - bits))
            marks.append(np.where((place - words.first()[words.row[place]]) % size == 0, REFERENCE, 0).astype(np.int8))
        found, mark = _distinct(np.concatenate(hashes), np.concatenate(marks))
        buckets, first = np.unique(found >> np.uint64(32), return_index=True)
        return pa.table(
            [
                pa.array(buckets.astype(np.int64)),
                pa.array(np.full(len(first), key[0].as_py())),
                _slices(found.astype("<u4"), first),
                _slices(mark, first),
            ],
            names=["bucket", "stack", "runs", "marks"],
        )

    return run


def _anchors(key, table):
    """The runs of a bucket that are a reference block somewhere and occur twice or more, by the stacks that hold them."""
    raw = table.column("runs").to_pylist()
    runs = np.frombuffer(b"".join(raw), "<u4")
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.int8)
    row = np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw])
    order = np.argsort(runs, kind="stable")
    first = np.flatnonzero(np.append(True, runs[order][1:] != runs[order][:-1])[: len(order)])
    n = np.diff(np.append(first, len(order)))
    met = np.bitwise_or.reduceat(marks[order], first)
    anchor = (met & REFERENCE > 0) & ((n > 1) | (met & SEVERAL > 0))
    held = np.sort(order[np.repeat(anchor, n)])  # in the order of rows again
    rows, start = np.unique(row[held], return_index=True)
    return pa.table(
        [
            table.column("stack").combine_chunks().take(pa.array(rows)),
            pa.array(np.full(len(rows), key[0].as_py())),
            _slices(runs[held], start),
        ],
        names=["stack", "bucket", "runs"],
    )


def _kept_text(words: Words, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    start, end, row = words.start[kept], words.end[kept], words.row[kept]
    more = np.append(row[1:] == row[:-1], False)[: len(row)]
    # The byte after a word that another one follows is white space, which becomes the space between them.
    data = np.append(words.data, np.uint8(32))
    data[end[more]] = 32
    taken = ranges(start, end + more)
    size = np.bincount(row, weights=end + more - start, minlength=words.rows).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = pa.Array.from_buffers(
        pa.large_string(), words.rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[taken]))]
    )
    return out.cast(pa.string())


def _candidates(window: int, bits: int):
    """Documents of a stack: those without a window around an anchor are done, the others keep their text and
    the places of such windows."""
    size = (window + 1) // 2
    spare = window - size + 1

    def run(key, documents, hits):
        told = [np.frombuffer(r, "<u4") for r in hits.column("runs").to_pylist()]
        above = np.repeat(hits.column("bucket").to_numpy().astype(np.uint64), [len(r) for r in told])
        known = np.sort((above << np.uint64(32)) | np.concatenate([*told, np.zeros(0, "<u4")]))
        columns = []
        for lo, hi, words in word_chunks(documents.column("text")):
            place, found = _runs(words, size, window)
            found >>= np.uint64(32 - bits)
            hit = np.zeros(len(words.start) + 1, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit[place[known[at] == found] + 1] = 1
            before = np.cumsum(hit)
            inside = np.flatnonzero(_within(words, window))
            inside = inside[before[inside + spare] > before[inside]]
            first = words.first()
            row = words.row[inside]
            offsets = np.searchsorted(row, np.arange(words.rows + 1))
            local = (inside - first[row]).astype("<i4")
            text = documents.column("text").slice(lo, hi - lo).combine_chunks()
            whole = np.diff(offsets) > 0
            joined = _kept_text(words, np.ones(len(words.start), bool))
            columns.append(
                pa.table(
                    [
                        documents.column("doc_id").slice(lo, hi - lo).combine_chunks(),
                        pa.array(np.full(hi - lo, key[0].as_py())),
                        pa.array(np.diff(first), pa.int64()),
                        pc.if_else(pa.array(whole), text.cast(pa.string()), joined),
                        pa.array([local[a:b].tobytes() if b > a else None for a, b in zip(offsets, offsets[1:])], pa.binary()),
                    ],
                    names=["doc_id", "stack", "n_words", "text", "places"],
                )
            )
        return pa.concat_tables(columns) if columns else _CANDIDATES.empty_table()

    return run


_CANDIDATES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("stack", pa.int64()),
        ("n_words", pa.int64()),
        ("text", pa.string()),
        ("places", pa.binary()),
    ]
)


def _marked_windows(column, places, window: int):
    """Rows, words, places of candidate windows and their two hashes, some rows at a time."""
    for lo, hi, words in word_chunks(column):
        local = [np.frombuffer(p, "<i4") for p in places[lo:hi]]
        at = np.concatenate(local) + np.repeat(words.first()[:-1], [len(p) for p in local])
        one, other = (
            window_hashes(span_hashes(words.data, words.start, words.end, seed), window)[at] for seed in (1, 2)
        )
        yield lo, hi, words, at, one, other


_PAIR = np.dtype([("one", "<u8"), ("other", "<u8")])


def _pairs(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = np.empty(len(one), _PAIR)
    out["one"], out["other"] = one, other
    return out


def _windows(window: int, bits: int):
    """The distinct candidate windows of a batch by stack and bucket, and whether they occur there more than once."""

    def run(batches):
        for batch in batches:
            stacks = batch.column(0).to_numpy()
            for lo, _, words, at, one, other in _marked_windows(batch.column(1), batch.column(2).to_pylist(), window):
                of_window = stacks[lo + words.row[at]]
                for stack in np.unique(of_window):
                    mine = of_window == stack
                    found, n = np.unique(_pairs(one[mine], other[mine]), return_counts=True)
                    buckets, first = _buckets(found["one"], bits)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(buckets.astype(np.int64)),
                            pa.array(np.full(len(first), stack), pa.int64()),
                            _slices(found, first),
                            _slices((n > 1).astype(np.int8), first),
                        ],
                        ["bucket", "stack", "windows", "several"],
                    )

    return run


def _repeated(key, table):
    """The windows of a bucket that occur twice or more, by the stacks that hold them."""
    raw = table.column("windows").to_pylist()
    windows = np.frombuffer(b"".join(raw), _PAIR)
    several = np.frombuffer(b"".join(table.column("several").to_pylist()), np.int8)
    row = np.repeat(np.arange(len(raw)), [len(r) // _PAIR.itemsize for r in raw])
    order = np.lexsort((windows["other"], windows["one"]))
    ordered = windows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(order)])
    n = np.diff(np.append(first, len(order)))
    again = (n > 1) | (np.maximum.reduceat(several[order], first) > 0)
    held = np.sort(order[np.repeat(again, n)])
    rows, start = np.unique(row[held], return_index=True)
    return pa.table(
        [table.column("stack").combine_chunks().take(pa.array(rows)), _slices(windows[held], start)],
        names=["stack", "windows"],
    )


def _removed(window: int):
    """The documents of a stack without the words that repeated windows cover."""

    def run(key, documents, repeated):
        known = np.unique(np.frombuffer(b"".join(repeated.column("windows").to_pylist()), _PAIR))
        out = []
        places = documents.column("places").to_pylist()
        for lo, hi, words, at, one, other in _marked_windows(documents.column("text"), places, window):
            found = _pairs(one, other)
            if len(known):
                near = np.minimum(np.searchsorted(known, found), len(known) - 1)
                at = at[known[near] == found]
            else:
                at = at[:0]
            covered = np.zeros(len(words.start) + 1, np.int64)
            covered[at] += 1
            np.subtract.at(covered, at + window, 1)
            kept = np.cumsum(covered)[:-1] == 0
            gone = np.bincount(words.row, weights=~kept, minlength=words.rows).astype(np.int64)
            out.append(
                pa.table(
                    [
                        documents.column("doc_id").slice(lo, hi - lo).combine_chunks(),
                        documents.column("n_words").slice(lo, hi - lo).combine_chunks(),
                        pa.array(gone),
                        _kept_text(words, kept),
                    ],
                    names=["doc_id", "n_words", "n_removed", "text"],
                )
            )
        return pa.concat_tables(out) if out else _RESULT.empty_table()

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the words left of each document, joined by one space."""
    bounded_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    size = documents.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    stacks = max(1, -(-size // STACK_BYTES))
    bits = min(32, (size // WORD_BYTES // BUCKET_RUNS).bit_length())
    stacked = documents.withColumn("stack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(stacks)))

    probes = stacked.groupBy("stack").applyInArrow(
        _probes(window, bits), "bucket long, stack long, runs binary, marks binary"
    )
    hits = probes.groupBy("bucket").applyInArrow(_anchors, "stack long, bucket long, runs binary")
    hits = written(hits, "anchors")
    found = stacked.groupBy("stack").cogroup(hits.groupBy("stack"))
    schema = "doc_id long, stack long, n_words long, text string, places binary"
    judged = written(found.applyInArrow(_candidates(window, bits), schema), "candidates")
    dropped(hits)

    open_rows = judged.where("places is not null")
    sent = open_rows.select("stack", "text", "places").mapInArrow(
        _windows(window, bits), "bucket long, stack long, windows binary, several binary"
    )
    repeated = sent.groupBy("bucket").applyInArrow(_repeated, "stack long, windows binary")
    repeated = written(repeated, "repeated")
    met = open_rows.groupBy("stack").cogroup(repeated.groupBy("stack"))
    cut = met.applyInArrow(_removed(window), "doc_id long, n_words long, n_removed long, text string")
    done = judged.where("places is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "text")
    return done.union(cut)
