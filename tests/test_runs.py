"""Rule tables of any size against a plain search."""

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from faultfold.functions import runs
from faultfold.operators.classify import classify_with_rule_table
from faultfold.schemas import RULE


def finder_of(words):
    tables = runs._tables(pa.array(words)).to_pylist() if words else []
    return runs.Finder(*[sorted({t[k] for t in tables}) for k in ("length", "start", "word")])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé日 ", max_size=6), max_size=8), st.lists(st.one_of(st.none(), st.text("abé日 ", max_size=30)), max_size=6))
def test_every_word_is_found(words, texts):
    found = finder_of(words)(pa.array(texts, pa.string())).to_pylist()
    for text, had in zip(texts, found):
        if text is None:
            assert had is None
        else:
            assert {w for w in words if w in text} <= set(had)
            assert all(h in text for h in had)


def test_long_words_and_chunks(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK_BYTES", 16)
    words = ["x" * 600, "needle", "é" * 9]
    texts = ["a" * 700 + "x" * 600, "", "no", "hay needle hay", "z" + "é" * 9]
    found = finder_of(words)(pa.array(texts)).to_pylist()
    assert [[w for w in words if w in f] for f in found] == [[words[0]], [], [], ["needle"], [words[2]]]


def test_rules_by_thousands(spark):
    rng = random.Random(2)
    rules = [(n, [f"code {rng.randrange(3000)} ", None, f"x{n}y"], f"c{n}", "low", "p", None) for n in range(1, 800)]
    rules += [(800, None, "none", "low", "p", "f"), (5, ["tie"], "b", "low", "p", "f"), (5, ["ti"], "a", "low", "p", "f")]
    lines = [f"failed with code {rng.randrange(3000)} at x{rng.randrange(2000)}y" for _ in range(500)]
    lines += ["a tie here", "nothing", "", None] * 2
    df = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(lines)], "k int, line string, rule_no string")
    got = classify_with_rule_table(df, spark.createDataFrame(rules, RULE), df.line)
    assert got.columns == ["k", "line", "rule_no", "classification", "severity", "component", "fingerprint"]
    for r in got.collect():
        hits = [(n, w, c) for n, words, c, *_ in rules for w in words or [] if w is not None and r.line and w in r.line]
        assert r.classification == (min(hits)[2] if hits else "unknown_error"), r.line
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "scalar-subquery" not in plan
