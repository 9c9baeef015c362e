"""Near-duplicate groups against all pairs of exact sets."""

import random
import re
from collections import defaultdict

import pytest

from faultfold.llm import near_dedup
from faultfold.llm.near_dedup import near_duplicates


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def expected(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_tables_match_all_pairs(spark, read, percent):
    rows = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    assert found(near_duplicates(read("documents"), percent)) == expected(rows, percent)


def test_chains_common_passages_and_small_blocks(frame, monkeypatch):
    """A chain of edits, unlinked texts around one passage, copies, and texts without five words."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(4000)]
    base = rng.sample(words, 120)
    texts = []
    for step in range(12):
        base = list(base)
        for place in rng.sample(range(120), 2):
            base[place] = rng.choice(words)
        texts.append(" ".join(base))
    passage = rng.sample(words, 70)
    texts += [" ".join(passage + rng.sample(words, 14 + k)) for k in range(20)]
    texts += [texts[0].upper(), texts[0], "one two", "ONE  two", "one", "", None, " \n\t"]
    rng.shuffle(texts)
    got = found(near_duplicates(frame(texts), 85))
    assert got == expected(list(enumerate(texts, 1)), 85)
    assert len({v[1] for v in got.values()}) < len(texts)


def test_null_ids_repeated_rows_and_no_rows(frame):
    text = "a b c d e f g h"
    got = near_duplicates(frame([text, text, text, text], ids=[None, 5, 5, 7]), 85).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [
        (0, None, True), (5, 5, True), (5, 5, True), (7, 5, False),
    ]
    assert near_duplicates(frame(["x"]).limit(0), 85).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    bounds = near_dedup.least_matches(85, 1e-6)
    n = near_dedup.HASHES
    assert bounds[-1] < 0.85 * n and bounds[-1] > 0.5 * n
    assert list(bounds) == sorted(bounds)
    assert near_dedup.least_matches(85, 1e-2)[-1] > bounds[-1]


def thue(n):
    out = ["a"]
    for _ in range(n):
        out += ["b" if c == "a" else "a" for c in out]
    return "".join(out)


def test_texts_that_cancel_out_in_polynomials_are_not_equal(frame):
    one = thue(10)
    other = one.translate(str.maketrans("ab", "ba"))
    assert len(one) == 1024
    got = found(near_duplicates(frame([one, other, one, f"{other} x", f"{one} x"]), 85))
    assert got == expected(list(enumerate([one, other, one, f"{other} x", f"{one} x"], 1)), 85)
    assert got[1][1] != got[2][1]


def test_a_pair_is_met_in_the_first_band_it_truly_shares():
    """An earlier band that agrees only in the low bits of its minima does not hide the bands that agree."""
    import numpy as np

    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 32, (1, near_dedup.HASHES), dtype=np.uint64).astype(np.uint32)
    other = one.copy()
    other[0, : near_dedup.BAND] ^= np.uint32(1 << 20)
    rows = []
    for k, made in enumerate((one, other)):
        keys = near_dedup.band_hashes(made)
        rows.append((7, 1, k == 0, k, k, made.astype(np.uint16).tobytes(), keys.tobytes()))
    bounds = near_dedup.least_matches(85, 1e-6)
    assert len(list(near_dedup._crossing(rows, bounds))) == 1
    first = [(7, 0, *row[2:]) for row in rows]
    assert not list(near_dedup._crossing(first, bounds))


def test_blocks_are_bounded_by_shingles(frame, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + rng.sample([f"w{k}" for k in range(900)], 12 + k % 5)) for k in range(30)]
    texts += [f"{t} tail" for t in texts[:10]]
    assert found(near_duplicates(frame(texts), 85)) == expected(list(enumerate(texts, 1)), 85)
