"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; policies are versioned sets of rules applied to the stored bits, so changing a policy, comparing
versions or asking what a rule costs never reads a text again.

Words are runs of characters other than space and ``\\t`` to ``\\r``. A null text has none and fails
``few_words``. Repeated rows and rows with a null id are each judged by themselves; ties do not occur. Very long texts are
judged whole, with about 40 times their bytes in memory. An empty table has an empty ledger. :func:`ledger` ignores further
columns, :func:`passing` keeps them, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultfold.llm.common import bounded_batches
from faultfold.llm.spans import equal_spans, mixed, span_hashes
from faultfold.llm.words import Words, per_row, word_chunks

MEASUREMENTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_letters",
    "n_capitals",
    "n_shouts",
)


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails``, a SQL condition on the measurements, holds."""

    bit: int
    name: str
    fails: str


#: A bit is never given to another rule, so that old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(5, "capitals", "100 * n_capitals > 50 * n_letters"),
    Rule(6, "shouts", "10 * n_shouts > n_words"),
)

#: Rules by policy version.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: tuple(rule.name for rule in RULES),
}
BASE, CURRENT = 1, 2

_SYMBOL, _CAPITAL, _LETTER, _LEAD = (np.zeros(256, np.uint8) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_CAPITAL[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_LEAD[:] = (np.arange(256) & 0xC0) != 0x80


def _bytes_per_row(words: Words, marked: np.ndarray) -> np.ndarray:
    return per_row(marked.astype(np.int64), words.offsets)


def _duplicate_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier line, by text. Lines of one hash are compared."""
    breaks = np.flatnonzero(words.data == 10)
    begins = np.unique(np.concatenate([words.offsets[:-1], breaks + 1]))
    line = np.unique(np.searchsorted(begins, words.start, side="right") - 1)
    start = begins[line]
    stop = np.minimum(np.append(begins, len(words.data))[line + 1], len(words.data))
    stop = np.where(words.data[stop - 1] == 10, stop - 1, stop)
    row = np.searchsorted(words.offsets, start, side="right") - 1
    lines = np.bincount(row, minlength=words.rows)
    hashes = span_hashes(words.data, start, stop)
    order = np.lexsort((start, hashes, row))
    hashes, row, start, length = hashes[order], row[order], start[order], (stop - start)[order]
    near = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]) & (length[1:] == length[:-1])) + 1
    same = near[equal_spans(words.data, start[near], words.data, start[near - 1], length[near])]
    return lines, np.bincount(row[same], minlength=words.rows)


def _repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words in a window of three words that occurs twice or more in its text."""
    n = len(hashes)
    covered = np.zeros(n, np.int64)
    at = np.flatnonzero(words.row[: n - 2] == words.row[2:]) if n > 2 else np.zeros(0, np.int64)
    if len(at):
        step = np.uint64(0xD6E8FEB86659FD93)
        grams = (hashes[at] * step + hashes[at + 1]) * step + hashes[at + 2]
        grams = mixed(grams + words.row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = 1
    return per_row(covered, words.first())


def measure(words: Words) -> list[np.ndarray]:
    """The :data:`MEASUREMENTS` of each text."""
    data, hashes = words.data, words.hashes()
    solid = np.zeros(len(data) + 1, np.int8)
    solid[words.start] += 1
    solid[words.end] -= 1
    inside = np.cumsum(solid[:-1], dtype=np.int8)
    lines, duplicates = _duplicate_lines(words)
    return [
        words.counts(),
        _bytes_per_row(words, _LEAD[data] * inside),
        _bytes_per_row(words, _SYMBOL[data]),
        lines,
        duplicates,
        _repeated_words(words, hashes),
        _bytes_per_row(words, _LETTER[data]),
        _bytes_per_row(words, _CAPITAL[data]),
        _bytes_per_row(words, data == ord("!")),
    ]


#: Name of the column of measurements while they travel with a document's own columns.
_MEASURED = "measured by rules"


def _measured(batches):
    for batch in batches:
        place = batch.schema.get_field_index("text")
        for lo, hi, words in word_chunks(batch.column(place)):
            values = [pa.array(c, pa.int64()) for c in measure(words)]
            struct = pa.StructArray.from_arrays(values, list(MEASUREMENTS))
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(lo, hi - lo).columns, struct], [*batch.schema.names, _MEASURED]
            )


def _with_measurements(documents: DataFrame) -> DataFrame:
    bounded_batches(documents.sparkSession)
    fields = T.StructType([T.StructField(m, T.LongType()) for m in MEASUREMENTS])
    return documents.mapInArrow(_measured, T.StructType([*documents.schema.fields, T.StructField(_MEASURED, fields)]))


def _bits() -> Column:
    """Failure bits from the column of measurements."""
    total = F.lit(0).cast("long")
    for rule in RULES:
        fails = re.sub("|".join(MEASUREMENTS), lambda m: f"`{_MEASURED}`.{m[0]}", rule.fails)
        total = total.bitwiseOR(F.when(F.expr(fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(documents: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failure_bits`` of every document, in one scan without a shuffle."""
    rows = _with_measurements(documents.select(F.col("doc_id").cast("long"), "text"))
    return rows.select("doc_id", f"`{_MEASURED}`.*", _bits().alias("failure_bits"))


def passing(documents: DataFrame, version: int) -> DataFrame:
    """The rows of ``documents``, with all their columns, that fail no rule of the policy."""
    passes = _bits().bitwiseAND(F.lit(policy_mask(version))) == 0
    return _with_measurements(documents).where(passes).select(*[f"`{c}`" for c in documents.columns])


def policy_mask(version: int) -> int:
    return sum(1 << rule.bit for rule in RULES if rule.name in POLICIES[version])


def failed(version: int):
    """Whether a ledger row fails a rule of the policy."""
    return F.col("failure_bits").bitwiseAND(F.lit(policy_mask(version))) != 0


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """``rule, n_failed, n_only, n_documents``: what each rule of a policy rejects, and rejects alone.

    Rows are counted by their bits under the policy first, at most two to the number of rules.
    """
    mask = policy_mask(version)
    counts = rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [rule for rule in RULES if rule.name in POLICIES[version]]
    each = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules])
    )
    per_rule = counts.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return per_rule.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_documents"),
    )
