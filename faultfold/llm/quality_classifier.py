"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document's features are its words, its pairs of neighbouring words and the byte windows of
:data:`GRAMS` lengths inside its words with one character of surrounding white space. Each is hashed to
one of :data:`BUCKETS` vectors; the document is their mean, and a softmax over the two labels gives the
score. Pairs are unordered and hashed by their difference, so that a word that follows itself has one
and the same feature whatever the word is. Training is numpy stochastic gradient descent on the driver
over at most :data:`TRAIN_ROWS` labelled documents, chosen by the hash of their ids.

As the softmax of two classes depends on one linear function of the mean, scoring needs a single number
per bucket: the vector's product with the difference of the output rows.

Null and empty texts get the score of the bias alone. If no labelled row can be used the score is 0.5;
if all have one label it is the smoothed share of label 1. Null labels are left out of training;
rows with a null id are scored, not held out, and never used for training. Repeated rows are scored alike; a document
with several labels is trained on with each. A score equal to the threshold is predicted 1. Very long texts are scored whole,
with about 40 times their bytes in memory. An empty table gives an empty one. Scores ignore further columns, whatever
their names; :func:`accepted` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import bounded_batches, sampled
from faultfold.llm.words import Words, mixed, per_row, word_chunks

BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4)
TRAIN_ROWS, EPOCHS, RATE, THRESHOLD = 2000, 8, 4.0, 0.7


@dataclass(frozen=True)
class Model:
    """A value for each bucket, and the bias: the log-odds of label 1 are the mean value plus the bias."""

    values: np.ndarray
    bias: float


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(kind)) >> np.uint64(48)).astype(np.int64)


def features(words: Words):
    """For each kind of feature, its buckets and the row of each."""
    sums = words.prefix_hashes()
    hashes = mixed(words.window_hashes(sums, words.start, words.end))
    yield _buckets(hashes, 1), words.row
    at = np.flatnonzero(words.row[1:] == words.row[:-1])
    yield _buckets(hashes[at] ^ hashes[at + 1], 2), words.row[at]
    # A window may begin one byte before a word and end one byte behind it, inside the same text.
    low = np.maximum(words.start - 1, words.offsets[words.row])
    high = np.minimum(words.end + 1, words.offsets[words.row + 1])
    for size in GRAMS:
        n = np.maximum(high - low - size + 1, 0)
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first - low, n)
        yield _buckets(words.window_hashes(sums, at, at + size), 2 + size), np.repeat(words.row, n)


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Embeddings and output weights by stochastic gradient descent, one document at a time."""
    ones = sum(labels)
    if not 0 < ones < len(labels):
        share = (ones + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    inputs: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, words in word_chunks(pa.array(texts, pa.large_string())):
        kinds = list(features(words))
        bucket, row = np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds])
        order = np.argsort(row, kind="stable")
        bucket, ends = bucket[order], np.cumsum(np.bincount(row, minlength=words.rows))
        for a, b in zip(np.append(0, ends[:-1]), ends):
            kept, count = np.unique(bucket[a:b], return_counts=True)
            inputs.append((kept, (count / max(1, b - a)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    output, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(inputs)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(inputs)):
            kept, weight = inputs[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            mean = weight @ vectors[kept]
            logits = output @ mean + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[i]] -= 1
            back = error @ output
            output -= rate * np.outer(error, mean)
            bias -= 0.1 * rate * error
            vectors[kept] -= (rate * weight)[:, None] * back
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def score(words: Words, model: Model) -> np.ndarray:
    total, count = np.zeros(words.rows), np.zeros(words.rows)
    for bucket, row in features(words):
        total += np.bincount(row, model.values[bucket], words.rows)
        count += np.bincount(row, minlength=words.rows)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.bias, -40, 40)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents that are not held out; at most :data:`TRAIN_ROWS` reach the driver."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int"))
    chosen = sampled(known.where(~held_out()), "doc_id", TRAIN_ROWS)
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("text", "ascending")])
    )
    return train(rows.column("text").to_pylist(), rows.column("quality").to_pylist())


def score_documents(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, in one scan without a shuffle."""
    bounded_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi, words in word_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(score(words, model))], ["doc_id", "score"]
                )

    scored = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score the threshold or more."""
    bounded_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for lo, hi, words in word_chunks(batch.column(place)):
                yield batch.slice(lo, hi - lo).filter(pa.array(score(words, model) >= threshold))

    return documents.mapInArrow(run, documents.schema)
