"""Ranked lexical search in a length-stratified index.

Terms are runs of ASCII letters, ASCII digits and characters beyond ASCII, with A-Z in lower case. Of a
document with n terms only its normaliser ``m = 25 + (75 * n * N) div L`` enters a score, where N documents
hold a term and L terms are held in all. The steps:

1. One pass over all texts counts each document's terms and the frequency of the terms some item asks for.
2. Document frequencies are counted inside tasks and summed by Spark; they give each term its weight.
3. Each task indexes what it reads, about :data:`SHARD_BYTES` of postings at a time. Documents of equal m form
   a stratum; postings lie by term, stratum and tf. A term's impact is computed once for each tf of a
   stratum, and its greatest one there gives the stratum's bound for an item. An item visits strata in the
   order of their bounds until the k-th score found is above the next bound; the k-th score is carried on
   to the task's next shard. A task sends k documents an item, so hardly anything is shuffled, and no term
   or stratum is a key, however frequent it is.

Items are searched in blocks of about :data:`QUERY_BYTES` of text, each with its own passes, so what tasks
and the driver hold of the items is bounded. Scores are 64-bit integers.

Null and empty texts have no terms: such documents are not counted and such items find nothing. Rows that
repeat an id are documents or items of their own. A null ``doc_id`` comes after all others among equal
scores; items with a null id are searched too. Ties go to the smaller ``doc_id``. A very long text is one
row of numbers in memory. Further columns are ignored, whatever their names. Without documents or items
the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultfold.llm.common import bounded_batches, dropped, written
from faultfold.llm.spans import equal_spans, ranges, span_hashes
from faultfold.llm.words import CHUNK_BYTES, LOWER, split_words, utf8

#: Bytes of item texts searched together, and of postings indexed together.
QUERY_BYTES, SHARD_BYTES = 2 << 20, 32 << 20
#: Strata of an item's first visit; each further visit takes twice as many.
FIRST_VISIT = 8
#: Stands for a null document id: it sorts last.
NO_ID = np.iinfo(np.int64).max

_bytes = np.arange(256)
_IN_TERM = (_bytes >= 128) | ((_bytes | 32) >= 97) & ((_bytes | 32) <= 122) | (_bytes >= 48) & (_bytes <= 57)
#: Bytes of terms in lower case, all others as spaces.
_TERM_BYTES = np.where(_IN_TERM, LOWER, 32).astype(np.uint8)


def term_list(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return _TERM_BYTES[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


# -- postings ----------------------------------------------------------------------------------


class Vocabulary:
    """Finds the numbers of an item block's terms among the terms of texts."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        self.seed = 0
        while len(np.unique(hashes := span_hashes(self.data, starts, ends, self.seed))) < len(terms):
            self.seed += 1
        self.number = np.argsort(hashes)
        self.hashes, self.starts, self.lengths = hashes[self.number], starts, ends - starts

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the spans that are a term here, and the terms' numbers."""
        if not len(self.hashes) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = span_hashes(data, start, end, self.seed)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == hashes)
        number = self.number[place[at]]
        same = end[at] - start[at] == self.lengths[number]
        at, number = at[same], number[same]
        same = equal_spans(data, start[at], self.data, self.starts[number], self.lengths[number])
        return at[same], number[same]


def _chunks(column):
    """Consecutive rows with their terms, about :data:`CHUNK_BYTES` at a time."""
    data, offsets = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
        part = offsets[lo : hi + 1]
        yield lo, hi, split_words(_TERM_BYTES[data[part[0] : part[-1]]], part - part[0])
        lo = hi


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Slices of 32-bit ``values`` as binary rows."""
    raw = np.ascontiguousarray(values, "<i4")
    offsets = pa.py_buffer((first * 4).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, offsets, pa.py_buffer(raw)]).cast(pa.binary())


def _postings(terms: list[bytes]):
    def run(batches):
        vocabulary = Vocabulary(terms)
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi, words in _chunks(batch.column(1)):
                at, number = vocabulary.find(words.data, words.start, words.end)
                keys, counts = np.unique(words.row[at] * max(1, len(terms)) + number, return_counts=True)
                row, term = np.divmod(keys, max(1, len(terms)))
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(words.counts(), pa.int64()),
                        _packed(term, first),
                        _packed(counts, first),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return run


def _numbers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


def _frequencies(batches):
    """How many documents of a task hold each term."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        counts = np.bincount(_numbers(batch.column(0)), minlength=len(seen))
        counts[: len(seen)] += seen
        seen = counts
    term = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(seen[term], pa.int64())], ["term", "n"])


# -- the index ---------------------------------------------------------------------------------


class Strata:
    """Postings of some documents by term, stratum and tf, with each one's impact."""

    def __init__(self, doc, m, row, term, tf, n_terms: int):
        self.doc = doc
        levels, stratum = np.unique(m, return_inverse=True)
        self.n = len(levels)
        place = term * self.n + stratum[row]
        order = np.lexsort((tf, place))
        place, tf, self.row = place[order], tf[order], row[order]
        # Postings of one term, stratum and tf share an impact: it is computed at the first of them.
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (tf[1:] != tf[:-1])
        at = np.flatnonzero(new)
        once = (1_000_000_000 * tf[at]) // (1000 * tf[at] + 8 * levels[place[at] % self.n])
        self.impact = np.repeat(once, np.diff(np.append(at, len(place))))
        # A run is a term in a stratum; tf grows within it, so its last impact is its greatest.
        self.start = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        self.end = np.append(self.start[1:], len(place)).astype(np.int64)[: len(self.start)]
        self.greatest = self.impact[self.end - 1]
        run_term, self.stratum = np.divmod(place[self.start], self.n) if len(place) else (self.start, self.start)
        self.of_term = np.searchsorted(run_term, np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer ``best`` the documents of every stratum that may hold one of the k best."""
        low, high = self.of_term[terms], self.of_term[terms + 1]
        runs, weight = ranges(low, high), np.repeat(weights, high - low)
        bound = np.zeros(self.n, np.int64)
        np.add.at(bound, self.stratum[runs], weight * self.greatest[runs])
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.count_nonzero(bound))]
        at, size = 0, FIRST_VISIT
        while at < len(order) and bound[order[at]] >= best.least:
            visited = order[at : at + size]
            visited = visited[bound[visited] >= best.least]
            at, size = at + size, size * 2
            chosen = np.zeros(self.n, bool)
            chosen[visited] = True
            here = chosen[self.stratum[runs]]
            start, end = self.start[runs[here]], self.end[runs[here]]
            postings = ranges(start, end)
            score = np.zeros(len(self.doc), np.int64)
            np.add.at(score, self.row[postings], np.repeat(weight[here], end - start) * self.impact[postings])
            found = np.flatnonzero(score >= max(best.least, 1))
            best.offer(self.doc[found], score[found])


class Best:
    """The k documents of an item with the highest scores so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.doc, self.score, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def offer(self, doc: np.ndarray, score: np.ndarray) -> None:
        doc, score = np.concatenate([self.doc, doc]), np.concatenate([self.score, score])
        if len(doc) > 4 * self.k:
            enough = np.partition(score, len(score) - self.k)[len(score) - self.k]
            doc, score = doc[score >= enough], score[score >= enough]
        order = np.lexsort((doc, -score))[: self.k]
        self.doc, self.score = doc[order], score[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def _searched(items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, k: int):
    """Each item's k best documents of a task; ``items`` holds the numbers and weights of its terms."""

    def run(batches):
        best = [Best(k) for _ in items]
        held, size = [], 0

        def search():
            doc = np.concatenate([h[0] for h in held])
            m = np.concatenate([h[1] for h in held])
            term, tf = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            row = np.repeat(np.arange(len(doc)), np.concatenate([h[4] for h in held]))
            strata = Strata(doc, m, row, term, tf, n_terms)
            for (terms, weights), so_far in zip(items, best):
                strata.search(terms, weights, so_far)

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lengths = np.array([len(raw) // 4 for raw in batch.column(2).to_pylist()], np.int64)
            held.append(
                (ids, batch.column(1).to_numpy(), _numbers(batch.column(2)), _numbers(batch.column(3)), lengths)
            )
            size += 8 * int(lengths.sum())
            if size >= SHARD_BYTES:
                search()
                held, size = [], 0
        if held:
            search()
        doc = np.concatenate([b.doc for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best)), [len(b.doc) for b in best]), pa.int64()),
                pa.array(doc, pa.int64(), mask=doc == NO_ID),
                pa.array(np.concatenate([b.score for b in best]) if best else doc, pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )

    return run


# -- the search --------------------------------------------------------------------------------


def _weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search_block(documents: DataFrame, rows: list, k: int) -> DataFrame:
    spark = documents.sparkSession
    asked = [Counter(term_list(r.text)) for r in rows]
    terms = sorted({t for counts in asked for t in counts})
    number = {t: i for i, t in enumerate(terms)}
    postings = written(
        documents.mapInArrow(_postings(terms), "doc_id long, n long, terms binary, tfs binary"), "postings"
    )
    total = postings.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    counted = postings.select("terms").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n"))
    frequency = dict(counted.collect())  # at most one row for each term of the block
    weights = [_weight(total.docs, frequency.get(i, 0)) for i in range(len(terms))]
    items = [
        (
            np.array([number[t] for t in counts], np.int64),
            np.array([weights[number[t]] * c for t, c in counts.items()], np.int64),
        )
        for counts in asked
    ]
    m = F.lit(25) + F.expr(f"(75 * n * {total.docs}L) div {max(1, total.terms or 1)}L")
    found = (
        postings.where(F.length("terms") > 0)
        .select("doc_id", m.cast("long").alias("m"), "terms", "tfs")
        .mapInArrow(_searched(items, len(terms), k), "item long, doc_id long, score long")
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
    dropped(postings)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item long, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents, the best first."""
    bounded_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    items = items.select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("b")).first().b or 0
    blocks = -(-size // QUERY_BYTES)
    out = documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        # At most about QUERY_BYTES: blocks grow in number, not in size.
        out = out.unionByName(_search_block(documents, mine.collect(), k))
    return out
