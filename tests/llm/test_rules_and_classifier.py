"""Quality rules against plain Python, and the classifier's held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from faultfold.llm import quality_classifier, quality_rules
from faultfold.llm.queries import QUERIES
from faultfold.llm.words import _BASE, _BYTE, word_chunks


def plain(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines, seen, repeated = 0, set(), 0
    for line in text.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, repeated, len(covered),
        len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text)), text.count("!"),
    )


def measured(texts):
    out = []
    for _, _, words in word_chunks(pa.array(texts, pa.string())):
        out += list(zip(*[c.tolist() for c in quality_rules.measure(words)]))
    return out


@given(st.lists(st.one_of(st.none(), st.text("aA é|#!\n\t\x0b日 ", max_size=60)), max_size=8))
def test_measurements(texts):
    assert measured(texts) == [plain(t) for t in texts]


def test_tables(spark, data, read):
    rows = QUERIES["op3_quality_rules"](spark, data).collect()
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, _, lines, repeats, *_ = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_policies_and_ablations(frame):
    clean = " ".join(f"word{k}" for k in range(60))
    texts = [clean, clean, "short", None, clean.upper(), "x# " * 60, "a b c " * 40, "# #"]
    rows = quality_rules.ledger(frame(texts))
    bits = {r.doc_id: r.failure_bits for r in rows.collect()}
    for version in quality_rules.POLICIES:
        mask = quality_rules.policy_mask(version)
        by_rule = {r.rule: r for r in quality_rules.ablations(rows, version).collect()}
        for rule in quality_rules.RULES:
            if rule.name in quality_rules.POLICIES[version]:
                own = 1 << rule.bit
                got = by_rule[rule.name]
                assert got.n_documents == len(texts)
                assert got.n_failed == sum(bool(b & own) for b in bits.values())
                assert got.n_only == sum(b & mask == own for b in bits.values())
    kept = quality_rules.passing(frame(texts), quality_rules.CURRENT)
    assert kept.columns == frame(texts).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, b in bits.items() if b == 0} == {1, 2}
    assert quality_rules.ledger(frame(["x"]).limit(0)).count() == 0


def test_held_out_documents_are_told_apart(spark, data, read):
    rows = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, data).collect()}
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [i for i in labels if rows[i].held_out]
    assert np.mean([rows[i].predicted == labels[i] for i in held]) > 0.9


def test_scores_do_not_depend_on_chunks():
    texts = ["good words here in a row", "BAD!! BAD!! BAD!!", "", None, "x"] * 3
    model = quality_classifier.train(["good words in a row"] * 10 + ["BAD!! BAD!!"] * 10, [1] * 10 + [0] * 10)
    alone = []
    for t in texts:
        (_, _, words), = word_chunks(pa.array([t], pa.string()))
        alone.append(float(quality_classifier.score(words, model)[0]))
    (_, _, words), = word_chunks(pa.array(texts, pa.string()))
    assert np.allclose(quality_classifier.score(words, model), alone)
    assert alone[0] > 0.7 > 0.3 > alone[1]


def test_labels_of_one_kind_or_none(frame, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(frame(["a", None, "b"]), none)
    rows = quality_classifier.score_documents(frame(["a", None], ids=[1, None]), model).collect()
    assert [(r.score, r.predicted, r.held_out) for r in rows] == [(0.5, 0, rows[0].held_out), (0.5, 0, False)]
    ones = spark.createDataFrame([(i, 1, None) for i in range(9)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(frame(["a"] * 8), ones)
    assert quality_classifier.score_documents(frame(["a"]), model).first().score > 0.8
    assert quality_classifier.accepted(frame(["a", None]), model).columns == frame(["a"]).columns


def test_lines_that_cancel_out_in_polynomials_are_not_equal(frame):
    line = ["a"]
    for _ in range(10):
        line += ["b" if c == "a" else "a" for c in line]
    one = "".join(line)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = {r.doc_id: r for r in quality_rules.ledger(frame([f"{one}\n{other}", f"{one}\n{one}\n{other}\n\n{one}", f"{one} {other} x {other} {one} x"])).collect()}
    assert [rows[k].n_dup_lines for k in (1, 2, 3)] == [0, 2, 0]
    assert rows[3].n_repeat_words == 0


def one_score(text, model):
    """The score of a text, feature by feature in whole numbers."""
    data, wide = (text or "").encode(), 1 << 64

    def mix(x):
        return int(quality_classifier.mixed(np.array([x % wide], np.uint64))[0])

    def hashed(part):
        return sum(int(_BYTE[b]) * pow(_BASE, k, wide) for k, b in enumerate(part)) % wide

    spans = [m.span() for m in re.finditer(rb"[^ \t-\r]+", data)]
    words = [mix(hashed(data[a:b])) for a, b in spans]
    buckets = [mix(w + 1) >> 48 for w in words] + [mix((a ^ b) + 2) >> 48 for a, b in zip(words, words[1:])]
    for a, b in spans:
        around = data[max(0, a - 1) : b + 1]
        for size in quality_classifier.GRAMS:
            for i in range(len(around) - size + 1):
                buckets.append(mix(hashed(around[i : i + size]) + 2 + size) >> 48)
    mean = sum(float(model.values[b]) for b in buckets) / max(1, len(buckets))
    return 1 / (1 + np.exp(-(mean + model.bias)))


def test_scores_against_brute_force(frame, read):
    texts = ["", None, " \n", "a", "aa  bb\taa", "é 日本 x!", "x x x x"]
    texts += [r.text[:400] for r in read("documents").orderBy("doc_id").limit(25).collect()]
    rng = np.random.default_rng(1)
    model = quality_classifier.Model(rng.normal(size=quality_classifier.BUCKETS).astype(np.float32), 0.3)
    rows = quality_classifier.score_documents(frame(texts), model).collect()
    assert np.allclose([r.score for r in rows], [one_score(t, model) for t in texts])
    kept = quality_classifier.accepted(frame(texts), model).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if r.predicted} and {r.kept for r in kept} == {"own"}
    assert quality_classifier.score_documents(frame(["x"]).limit(0), model).count() == 0
    long = quality_classifier.score_documents(frame(["word and 12 é! " * 150_000, "word and 12 é! "]), model).collect()
    assert abs(long[0].score - long[1].score) < 0.05
