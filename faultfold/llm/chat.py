"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Nothing is known of its inside: to learn
where a turn lies in the output, the turns are rendered one prefix after the other and consecutive
outputs are compared. If an output begins with the one before, what it adds is the new turn's span; else
the template rewrites history, and the spans found so far are wrong. The text a loss is taken on is found
the same way: the turn is rendered twice more, with two texts of one different letter each. Where these
outputs differ is the place of the text; what follows the letter follows the text.

Of a template nothing else is assumed, so every prefix of the whole conversation is rendered; that work grows
with the square of its turns, and a task holds one conversation. A template may declare that it renders each
turn the same wherever it stands (an attribute ``context_free`` that is true). Its conversations are rendered
in segments of :data:`SEGMENT` turns, so the work grows with the turns and only one segment is held. The
declaration is checked: each turn is rendered alone too, and each segment's first turn behind the turn before.

Rows are ordered by turn, role and text. A null role or text counts as empty, rows with a null ``conv_id``
make one conversation, repeated rows are repeated turns. Conversations without rows do not exist, and an empty table gives
an empty one. A very long text is held whole, a few times over while its turn is rendered. Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import bounded_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns of a context-free template rendered together, and segments in an Arrow batch.
SEGMENT, HELD = 64, 32

_spans = pa.list_(pa.list_(pa.int64()))
SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("segment", pa.int64()),
        ("formatted", pa.string()),
        ("turn_spans", _spans),
        ("loss_spans", _spans),
    ]
)
DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)

OPEN, CLOSE, STOP = "<|turn|>", "<|text|>", "<|end|>"
#: What a text may not contain unescaped: the template's own marks and those of common formats.
CONTROL = (OPEN, CLOSE, STOP, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_MARK = "\\"
_control = re.compile("|".join(re.escape(c) for c in (_MARK, *sorted(CONTROL, key=len, reverse=True))))
_escaped = re.compile(re.escape(_MARK) + r"(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without control strings: a mark goes behind their first character, and marks are doubled."""
    return _control.sub(lambda m: _MARK * 2 if m[0] == _MARK else m[0][0] + _MARK + "-" + m[0][1:], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _MARK if m[1] == _MARK else "", text)


def turn_template(turns: list[Turn]) -> str:
    """Each turn as a mark, its role, a mark, its text and an end mark, with roles and texts escaped."""
    return "".join(f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{STOP}" for role, text in turns)


turn_template.context_free = True


def read_turns(formatted: str) -> list[Turn]:
    """The turns of what :func:`turn_template` wrote; anything else raises ``ValueError``."""
    turns = []
    for part in formatted.split(STOP)[:-1]:
        role, mark, text = part.partition(CLOSE)
        if not mark or not role.startswith(OPEN):
            raise ValueError(f"no turn: {part[:80]!r}")
        turns.append((unescape(role[len(OPEN) :]), unescape(text)))
    if not formatted.endswith(STOP) and formatted:
        raise ValueError("the last turn does not end")
    return turns


class RewritesHistory(ValueError):
    """Rendering a further turn changed what was rendered before."""


def spans(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The rendered text, each turn's span in it, and the span of each turn's own text."""
    before, whole, texts = template([]), [], []
    start = 0
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            raise RewritesHistory(f"turn {k} changes the text before it")
        whole.append((start, len(now)))
        probes = [template([*turns[:k], (role, letter)]) for letter in "AB"]
        texts.append(_text_span(*probes, now))
        before, start = now, len(now)
    return before, whole, texts


def _text_span(one: str, other: str, full: str) -> tuple[int, int]:
    """Where ``full`` has its last turn's text, from two outputs that differ in a text of one letter."""
    start = next((i for i, (a, b) in enumerate(zip(one, other)) if a != b), None)
    if start is None:
        return (len(full), len(full))  # the template leaves this turn's text out
    end = len(full) - (len(one) - start - 1)
    if full[:start] != one[:start] or end < start or full[end:] != one[start + 1 :]:
        raise RewritesHistory("what surrounds a text depends on the text")
    return (start, end)


def rewrites_history(template: Template, turns: list[Turn]) -> bool:
    try:
        spans(template, turns)
    except RewritesHistory:
        return True
    return False


def _conversations(batches, size: int | None) -> Iterator[tuple[int | None, list[Turn], bool]]:
    """Consecutive segments of at most ``size`` turns, with their conversation and whether they are its first."""
    key, held, first = None, [], True
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (conv != key or len(held) == size):
                yield key, held, first
                first, held = conv != key, []
            key = conv
            held.append((role or "", text or ""))
    if held:
        yield key, held, first


def format_conversations(conversations: DataFrame, template: Template = turn_template) -> DataFrame:
    """``conv_id, segment, formatted, turn_spans, loss_spans``: segments of up to :data:`SEGMENT` turns.

    If the template does not declare to be context-free, a conversation is one segment. ``turn_spans`` and
    ``loss_spans`` (of assistant texts) hold starts and ends in ``formatted``.
    """
    bounded_batches(conversations.sparkSession, 2048)

    def run(batches):
        segment, last, rows = 0, None, []
        free = getattr(template, "context_free", False)
        for conv, turns, first in _conversations(batches, SEGMENT if free else None):
            formatted, whole, texts = spans(template, turns)
            if free and any(template([turn]) != formatted[a:b] for turn, (a, b) in zip(turns, whole)):
                raise RewritesHistory("a turn is rendered differently alone")
            if not first:
                alone, joined = template(turns[:1]), template([last, turns[0]])
                if joined != template([last]) + alone:
                    raise RewritesHistory("a turn is rendered differently behind another")
            segment, last = 0 if first else segment + 1, turns[-1]
            loss = [list(span) for span, turn in zip(texts, turns) if turn[0] == "assistant"]
            rows.append((conv, segment, formatted, [list(s) for s in whole], loss))
            if len(rows) == HELD:
                yield _batch(rows, SEGMENTS)
                rows = []
        yield _batch(rows, SEGMENTS)

    rows = (
        conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return rows.mapInArrow(
        run,
        "conv_id long, segment long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>",
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from the formatted segments: counts and digests of turns and loss text.

    Segments must come in the order :func:`format_conversations` gives them; digests run over them, and no
    conversation is held whole.
    """

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for conv, segment, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if segment == 0:
                    if state:
                        done.append((key, *_closed(state)))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in loss:
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield _batch(done, DIGESTS)
        if state:
            yield _batch([(key, *_closed(state))], DIGESTS)

    return formatted.select("conv_id", "segment", "formatted", "loss_spans").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _closed(state):
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
