"""BPE against the tokenizers library, and packing against its rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from faultfold.llm import bpe, packing
from faultfold.llm.queries import QUERIES, vocabulary

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "", " ", "a  b   c\n\n d\t e ", "x<|endoftext|> y<|endoftext|><|endoftext|>z", "日本語 テキスト一二三",
    "\xa0nb\xa0 x y", "it's we'll I'd 'S don't 're", "12 34½ ²", "a\x1c b\x1d\x1e c \x85 d", "é ́x",
    "🙂🙂 👍🏽", "İstanbul ΣΑΣ ΟΔΟΣ'S", "ﬁ ㎏", "가 한", "ªº µ ß ÿ ÀÖØ×÷", "x<|startoftext|>y", "a" * 300, "\x00\x7f\xad",
]


@pytest.fixture(scope="module")
def texts(read):
    return ODD + [r.text for r in read("documents").limit(60).collect()]


def test_encoding_matches_the_library(texts):
    path = vocabulary("byte_bpe_50k.json")
    own, library = bpe.ByteBpe(path), tokenizers.Tokenizer.from_file(path)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([own.byte_ids[0xC3]]) == "�"


def test_columns(frame):
    path = vocabulary("byte_bpe_50k.json")
    rows = bpe.encode(frame(["a b", None, ""], ids=[1, None, 1]), path)
    assert [len(r.ids) for r in rows.collect()] == [2, 0, 0]
    assert [r.text for r in bpe.decode(rows, path).collect()] == ["a b", "", ""]
    assert bpe.encode(frame(["x"]).limit(0), path).count() == 0
    library = tokenizers.Tokenizer.from_file(path)
    odd = rows.sparkSession.createDataFrame(
        [(1, [64, None, 10**6, 65], "x"), (None, None, "y"), (2, [], "z")], "doc_id long, ids array<int>, text string"
    )
    assert [r.text for r in bpe.decode(odd, path).collect()] == [library.decode([64, 65]), None, ""]


def test_long_texts_and_repeated_rows(frame):
    """One piece of very many letters, very many pieces, and rows that share an id."""
    path = vocabulary("byte_bpe_50k.json")
    texts = ["ab" * 20_000, "word 12 é! " * 20_000, "same", "same"]
    library = tokenizers.Tokenizer.from_file(path)
    rows = bpe.encode(frame(texts, ids=[1, 2, None, None]), path, decoded=True).collect()
    assert [r.ids for r in rows] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [r.decoded for r in rows] == texts
    packed = packing.pack(frame(texts[:2]), vocabulary("word_bpe_49k.json"), length=64).collect()
    check(packed, {1: texts[0], 2: texts[1]}, 64)


def test_memory_forgets():
    memory = bpe.Memory(2)
    for k in range(5):
        memory.put(k, str(k))
    assert memory.get(0) is None and memory.get(4) == "4" and len(memory.new) <= 2


def test_word_tokens_match_the_library(texts):
    path = vocabulary("word_bpe_49k.json")
    own, library = packing.WordTokenizer(path), tokenizers.Tokenizer.from_file(path)
    for text in texts:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text[:80]


def check(rows, documents, length=packing.LENGTH):
    library = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(documents)
    for i, pieces in by_doc.items():
        ids = np.array([*library.encode(documents[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        total += at
    assert len(by_sequence) * length - total < length
    return by_sequence


def test_packing_and_mixture(spark, data, read):
    documents = {r.doc_id: r for r in read("documents").collect()}
    sequences = check(QUERIES["op8_packing"](spark, data).collect(), {i: r.text for i, r in documents.items()})
    whole = defaultdict(int)
    for pieces in sequences.values():
        for r in pieces:
            whole[documents[r.doc_id].source] += r.length
    padded = len(sequences) * packing.LENGTH
    served = defaultdict(int)
    for w in range(len(sequences) - 1):
        for r in sequences[w]:
            served[documents[r.doc_id].source] += r.length
        for source, n in whole.items():
            assert abs(served[source] - (w + 1) * packing.LENGTH * n / padded) < 1  # the deficit


def test_small_sources_nulls_and_no_rows(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(0, 40), rng.choice(["big", "big", "mid", None, f"s{i}"])) for i in range(200)]
    rows += [(900, None, "big"), (901, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df.repartition(5), vocabulary("word_bpe_49k.json"), length=64).collect()
    check(got, {i: t for i, t, _ in rows}, 64)
    assert packing.pack(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0
