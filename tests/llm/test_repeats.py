"""Removal of repeated passages against a dictionary of all windows."""

import random
import re
from collections import Counter

import pytest

from faultfold.llm import repeats
from faultfold.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(texts, window=35):
    seen = Counter(tuple(w[i : i + window]) for w in map(words, texts) for i in range(len(w) - window + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def removed(documents, window=35):
    rows = repeats.remove_repeats(documents, window)
    assert rows.columns == ["doc_id", "n_words", "n_removed", "text"]
    return {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, other = fresh(60), fresh(35)
    out = [None, "", " \t\n", fresh(34), fresh(200), "la " * 34, "la " * 35, "la " * 40, "none\xa0breaking space " * 30]
    out += [f"{fresh(k)}  {shared}\n{fresh(9)}" for k in range(25)]  # every offset against the blocks
    out += [f"{fresh(3)} {other}", f"{other} {fresh(50)} {other}", shared, shared, f"{other} {shared} {other}"]
    out += [f"{fresh(7)} {' '.join(shared.split()[:34])} x", " ".join(shared.split()[:35]), "Ünï çödé " * 50]
    few = ["a", "b"]
    out += [" ".join(rng.choices(few, k=rng.randint(30, 80))) for _ in range(20)]
    return out


@pytest.mark.parametrize("window", [35, 6, 1, 2])
def test_against_all_windows(frame, texts, window, monkeypatch):
    monkeypatch.setattr(repeats, "STACK_BYTES", 2000)
    monkeypatch.setattr(repeats, "BUCKET_RUNS", 700)
    got = removed(frame(texts).repartition(3), window)
    assert [got[i + 1] for i in range(len(texts))] == expected(texts, window)


def test_one_stack_and_repeated_ids(frame, texts):
    rows = repeats.remove_repeats(frame([*texts, texts[4]], ids=[*range(len(texts)), 4])).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in rows)
    assert got == sorted((i, *row) for i, row in zip([*range(len(texts)), 4], expected([*texts, texts[4]])))
    assert [r[2] for r in got if r[0] == 4] == [200, 200]


def test_null_ids_long_text_and_empty(frame):
    line = " ".join(f"t{k}" for k in range(50))
    got = repeats.remove_repeats(frame([line, line, "z " * 30], ids=[None, None, 7])).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.text) for r in got) == [(0, 50, ""), (0, 50, ""), (7, 0, "z " * 29 + "z")]
    long = " ".join(f"n{k}" for k in range(200_000))
    got = removed(frame([long, " ".join(f"n{k}" for k in range(100, 180))]))
    assert got[1][:2] == (200_000, 80) and got[2] == (80, 80, "")
    assert repeats.remove_repeats(frame(["x"]).limit(0)).count() == 0


def test_query(spark, data, read):
    import hashlib

    texts = {r.doc_id: r.text for r in read("documents").collect()}
    want = dict(zip(texts, expected(texts.values())))
    rows = QUERIES["op13_repeated_passages"](spark, data).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert got == {d: (n, g, hashlib.sha256(t.encode()).hexdigest()) for d, (n, g, t) in want.items()}
    assert any(g for _, g, _ in got.values())
