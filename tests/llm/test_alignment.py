"""Token alignment against a token-by-token version."""

import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from faultfold.llm import alignment, bpe
from faultfold.llm.queries import QUERIES, vocabulary

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

PATHS = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    None, "", " ", "a  b   c\n\n d\t e ", "x<|endoftext|> y</s><s>", "日本語 テキスト一二三", "it's we'll 12 34½ ²", "▁ x▁y",
    "🙂🙂 👍🏽 가 한", "İstanbul ΣΑΣ ΟΔΟΣ'S", "\x00\x7f\xad", "ab\x00cd", "a" * 3000, "long words here " * 3000, "<0x41> <unk>", "same", "same",
    "  two  ", "x" + " " * 3000 + "y\n" + "\n" * 2500, "\u00a0\u2003 wide", "ﬁ ½ é  ́x",
]


def token_bytes(texts):
    """Each text's ids and token bytes of both tokenizers, as the contract words it; none where they do not fit."""
    a = tokenizers.Tokenizer.from_file(vocabulary(PATHS[0]))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PATHS[1]))
    value = {c: i for i, c in enumerate(bpe.byte_characters())}
    out = []
    for text in texts:
        ids_a, ids_b, left, right = [], [], [], []
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            left = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
            for i in ids_b:
                piece = b.id_to_piece(i)
                right.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        if not b"".join(left) == b"".join(right) == (" " + text if text else "").encode():
            ids_a, ids_b, left, right = [], [], [], []
        out.append((ids_a, ids_b, left, right))
    return out


def ends(tokens):
    at, out = 0, []
    for token in tokens:
        at += len(token)
        out.append(at)
    return out


def expected(texts):
    rows, counts = [], Counter()
    for ids_a, ids_b, left, right in token_bytes(texts):
        ends_a, ends_b = ends(left), ends(right)
        at_end = defaultdict(list)
        for y, q in zip(ids_b, ends_b):
            at_end[q].append(y)
        links = [(x, y) for x, p in zip(ids_a, ends_a) for y in at_end[p]]
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            parts = [
                [str(i) for i in ids[bisect_right(at, low) : bisect_right(at, cut)]] for ids, at in ((ids_a, ends_a), (ids_b, ends_b))
            ]
            groups.append("|".join(",".join(p) for p in parts))
            low = cut
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (a, b, n, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), groups)
        for a, b, n, links, groups in rows
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def aligned(documents):
    return alignment.with_counts(alignment.align(documents, *map(vocabulary, PATHS)))


def test_against_tokens_one_by_one(frame, monkeypatch):
    texts = [t if t is None or len(t) < 10000 else t[:2000] for t in ODD]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in aligned(frame(texts).repartition(3)).collect()}
    assert [got[i + 1] for i in range(len(texts))] == expected(texts)


def test_rows_and_empty(frame):
    rows = aligned(frame(["one two", "one two", "three"], ids=[1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_a) for r in rows) == [(0, 1), (1, 2), (1, 2)]
    assert len({r.count_sum for r in rows if r.doc_id == 1}) == 1
    assert aligned(frame(["x"]).limit(0)).count() == 0
    long = aligned(frame(["many words of one long text " * 40000])).first()
    assert long.n_links == long.n_groups > 200000


def test_query(spark, data, read):
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    ids = sorted(texts)
    want = dict(zip(ids, expected([texts[i] for i in ids])))
    rows = QUERIES["op11_token_alignment"](spark, data).collect()
    assert len(rows) == len(ids)
    for r in rows:
        *numbers, groups = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_pair_counts(frame):
    rows = alignment.align(frame(["the cat the dog", "the cat"]), *map(vocabulary, PATHS))
    totals = alignment.pair_counts(rows)
    assert sorted(r.total for r in totals.collect())[-1] == 3
    assert totals.groupBy("b").agg(F.max(F.col("best").cast("int")).alias("m")).where("m = 0").isEmpty()


def test_segments_and_ranks_are_in_use():
    """The faster ways give what both libraries give, segment by segment remembered or not."""
    tools = alignment.Tokenizers(*map(vocabulary, PATHS))
    tools.memory = bpe.Memory(3)  # forgets while a text is read
    assert tools.a is not None and not tools.whole
    texts = [t for t in ODD if t]
    for _ in range(2):
        a, b = tools.encode(texts)
        for text, ids_a, ids_b, (want_a, want_b, *_) in zip(texts, a.to_pylist(), b.to_pylist(), token_bytes(texts)):
            assert (ids_a, ids_b) == (want_a, want_b), text[:40]
