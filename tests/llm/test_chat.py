"""Chat formatting: round trips, spans, long conversations, templates that rewrite history."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from faultfold.llm import chat
from faultfold.llm.queries import QUERIES

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "-", "<", ">", "a", "A", "B", "é", "\n", "</s"]), max_size=6)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<s>"]), PIECES.map("".join)), max_size=5)


@given(TURNS)
def test_round_trip_and_spans(turns):
    formatted, whole, texts = chat.spans(chat.turn_template, turns)
    assert chat.read_turns(formatted) == turns
    for (role, text), (a, b), (x, y) in zip(turns, whole, texts):
        assert chat.read_turns(formatted[a:b]) == [(role, text)]
        assert chat.unescape(formatted[x:y]) == text
        assert not any(c in formatted[x:y] for c in chat.CONTROL)


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert not chat.rewrites_history(chat.turn_template, turns)
    assert chat.rewrites_history(lambda ts: f"{len(ts)}:" + chat.turn_template(ts), turns)
    assert chat.rewrites_history(lambda ts: chat.turn_template(ts[-1:]), turns)
    assert chat.rewrites_history(lambda ts: "".join(f"[{t}]{len(t)}" for _, t in ts), [("user", "abc")])


def plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[conv] = (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(),
        )
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_tables(spark, data, read):
    rows = [tuple(r) for r in read("conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert digests(QUERIES["op9_chat_format"](spark, data)) == plain(rows)


def test_long_conversations_nulls_ties_and_no_rows(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k} </s>") for k in range(3 * chat.SEGMENT + 1)]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (2, None, None, None), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df.withColumn("segment", df.turn))
    assert digests(chat.digests(formatted)) == plain(rows)
    assert formatted.where("conv_id = 1").count() == 4
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_other_templates_see_the_whole_conversation(spark):
    n = 2 * chat.SEGMENT + 5
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def numbered(turns):
        return "<s>" + "".join(f"{k}{turns[0][0]}:{chat.turn_template([turn])}" for k, turn in enumerate(turns))

    got = chat.format_conversations(df, numbered).collect()
    assert [(r.segment, r.formatted) for r in got] == [(0, numbered([(r[2], r[3]) for r in rows]))]
    assert [got[0].formatted[a:b] for a, b in got[0].loss_spans] == [r[3] for r in rows if r[2] == "assistant"]

    def recent(turns):
        return chat.turn_template(turns[-100:])

    def declared(turns):
        return numbered(turns)

    declared.context_free = True
    for template in (recent, declared):
        with pytest.raises(Exception, match="RewritesHistory"):
            chat.format_conversations(df, template).collect()
