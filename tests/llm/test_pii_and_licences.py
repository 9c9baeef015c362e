"""Personal data against the rules as one pattern each; licence scan against the same model in Python."""

import random
import re
import textwrap

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from faultfold.llm import licences, pii
from faultfold.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXT = st.lists(
    st.sampled_from([*"0123456789.@+-_ ()ab%é\n", "4111111111111111", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+49 30 123456"]),
    max_size=30,
).map("".join)


@given(TEXT)
def test_rules(text):
    assert pii.rule_spans(text) == plain(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    tagger = pii.fresh(1, 4)
    rows, tags = pii.training_windows(["mail a@b.com or +1 202 555 0175 and 4111 1111 1111 1111 " * 4], 4, rng)

    def loss():
        scores = pii.emissions(tagger, rows)[0].astype(float)
        a, n = scores[0], rows.shape[1]
        for t in range(1, len(scores)):
            a = pii._sum_exp(a[:, :, None] + tagger.moves, 1) + scores[t]
        own = sum(scores[t][np.arange(n), tags[t]] for t in range(len(scores)))
        own = own + sum(tagger.moves[tags[t - 1], tags[t]] for t in range(1, len(scores)))
        return float((pii._sum_exp(a, 1) - own).mean())

    for weights, by in zip(tagger.weights(), pii.gradient(tagger, rows, tags)):
        at = np.unravel_index(np.abs(by).argmax(), by.shape)
        was = weights[at]
        weights[at] = was + 1e-2
        high = loss()
        weights[at] = was - 1e-2
        low = loss()
        weights[at] = was
        assert (high - low) / 2e-2 == pytest.approx(float(by[at]), rel=0.02)


@pytest.fixture(scope="module")
def tagger(read):
    return pii.train([r.text for r in read("documents").where("text rlike '[0-9@]'").collect()])


def test_tagger_finds_held_out_spans(tagger):
    rng = np.random.default_rng(99)
    right = total = 0
    for _ in range(150):
        kind, put = pii.example(rng)
        before = "the of and that " * int(rng.integers(1, 30))
        text = f"{before}{put} tion ere"
        tags, = pii.tag_texts(tagger, [text])
        total += 1
        right += (kind, len(before), len(before) + len(put)) in pii.read_spans(tags)
    assert right / total > 0.75


def test_tagger_adds_what_the_rules_miss(tagger):
    text = "call 12 (202) 555-0175 soon"
    found = pii.added_spans(text, pii.rule_spans(text), [("phone", 8, 22), ("phone", 5, 22), ("card", 8, 22)])
    assert found == [("phone", 8, 22)]
    assert pii.added_spans("a@b.com", [("email", 0, 7)], [("email", 0, 7)]) == []


def test_tagger_adds_exact_spans_to_held_out_documents(read):
    """Local numbers put into documents that the tagger was not trained on are added exactly, and nothing else is."""
    texts = sorted(r.text for r in read("documents").where("text rlike '[0-9@]'").collect())
    model = pii.train(texts[::2])
    rng, right, total, false = np.random.default_rng(17), 0, 0, 0
    untouched = texts[1::2] + [r.text for r in read("documents").where("not text rlike '[0-9@]'").limit(60).collect()]
    for text, tags in zip(untouched, pii.tag_texts(model, untouched)):
        base = pii.rule_spans(text)
        shaped = {(a, b) for _, a, b in pii._shaped(text)}
        false += sum((a, b) not in shaped for _, a, b in pii.added_spans(text, base, pii.read_spans(tags)))
        words = [m.end() for m in re.finditer(r"\S+ ", text)]
        if not words:
            continue
        at = int(rng.choice(words))
        a, b, c = (pii._number(rng, n) for n in (3, 3, 4))
        put = str(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]))
        told = f"{text[:at]}{put} {text[at:]}"
        tags, = pii.tag_texts(model, [told])
        total += 1
        right += ("phone", at, at + len(put)) in pii.added_spans(told, pii.rule_spans(told), pii.read_spans(tags))
    print(right, total, false)
    assert right >= 0.8 * total and total > 50 and not false


def test_numbers_that_are_part_of_others_are_not_added():
    text = "x (512) 102-9552 1265-905-6252 265-905-62521 265-905-6252-77 id7265-905-6252 265-905-6252."
    spans = [(m.start(), m.end()) for m in re.finditer(r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}", text)]
    found = pii.added_spans(text, [], [("card", a, b) for a, b in spans] + [("phone", 3, 16)])
    assert [text[a:b] for _, a, b in found] == ["(512) 102-9552", "265-905-6252"] and {k for k, *_ in found} == {"phone"}
    assert pii.added_spans("x (512) 102-9552", [], [("phone", 3, 16)]) == [("phone", 2, 16)]


def test_joined_windows_are_decoded_as_one():
    """The path over joined windows is the best of the whole sequence, of whatever length its neighbours are."""
    rng = np.random.default_rng(4)
    scores, moves = rng.normal(size=(9, 5, 3)), rng.normal(size=(3, 3))
    lengths = np.array([9, 1, 4, 7, 9])
    got = pii.viterbi(scores, moves, lengths)
    for j, n in enumerate(lengths):
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1)
        value = sum(scores[t, j, paths[t]] for t in range(n)) + sum(moves[paths[t - 1], paths[t]] for t in range(1, n))
        assert got[:n, j].tolist() == paths[:, value.argmax()].tolist()


def test_windows_are_joined(tagger):
    """Tags do not depend on where windows begin, beyond their margins, and long texts are whole."""
    text = "ere " * 500 + "mail sam@site.org or 10.20.30.40 " + "tion " * 500
    tags, = pii.tag_texts(tagger, [text])
    assert len(tags) == len(text)
    short = text[1900:2200]
    near, = pii.tag_texts(tagger, [short])
    assert {(k, a + 1900, b + 1900) for k, a, b in pii.read_spans(near)} == set(pii.read_spans(tags))


def test_read_spans_and_redaction():
    tags = pii.tagged([("email", 2, 5), ("email", 5, 7), ("ip", 9, 10)], 10)
    assert pii.read_spans(tags) == [("email", 2, 5), ("email", 5, 7), ("ip", 9, 10)]
    assert pii.redacted("xx a@b.cc +1 23", [("phone", 10, 15), ("email", 3, 9), ("card", 11, 15)]) == "xx [EMAIL] [PHONE]"
    assert pii.read_spans(np.zeros(0, np.int8)) == []


def test_tables(spark, data, read):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in read("documents").collect()}
    rows = QUERIES["op2_pii"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in PATTERNS]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))


def test_null_texts_and_no_rows(frame, tagger):
    rows = pii.find(frame([None, "", "a@b.cc"], ids=[None, 1, 1]), tagger).collect()
    assert [(r.doc_id, r.spans) for r in rows] == [(None, ""), (1, ""), (1, "email:0:6")]
    clean = pii.find(frame([None, "to a@b.cc"]), tagger, replace=True)
    assert clean.columns == frame([""]).columns and [r.text for r in clean.collect()] == [None, "to [EMAIL]"]
    assert pii.find(frame(["x"]).limit(0), tagger).count() == 0


# -- licences ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(read):
    return licences.fit(read("documents"))


def test_templates_and_decoys(model):
    for family, templates in licences.TEMPLATES.items():
        for template in templates:
            assert model.predict(template)[0] == family, template
            assert licences.similarity(template, family) == 1
    for decoy in licences.DECOYS:
        name, _ = model.predict(decoy)
        assert name == licences.UNKNOWN or licences.similarity(decoy, name) < licences.SIMILAR


def expected(model, text):
    families, confirmed, n = set(), set(), 0
    for paragraph in (text or "").split("\n"):
        name, _ = model.predict(paragraph)
        if name != licences.UNKNOWN:
            n += 1
            families.add(name)
            if licences.similarity(paragraph, name) >= licences.SIMILAR:
                confirmed.add(name)
    return ",".join(sorted(families)), ",".join(sorted(confirmed)), n


def test_scan_matches_the_model(read, model, frame):
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    for r in licences.scan(read("documents"), model).collect():
        assert (r.licences, r.confirmed, r.n_paragraphs) == expected(model, texts[r.doc_id])
    odd = [None, "", "\n\n", "x\nReleased under the MIT License.\nAll rights reserved.", "Über GNU General Public License, version 3"]
    for r in licences.scan(frame(odd), model).collect():
        assert (r.licences, r.confirmed, r.n_paragraphs) == expected(model, odd[r.doc_id - 1])
    assert licences.scan(frame(["x"]).limit(0), model).count() == 0
    long = ["software and the sea " * 60_000 + "\nReleased under the MIT License.", "a b\n" * 100_000]
    assert [(r.licences, r.confirmed) for r in licences.scan(frame(long), model).orderBy("doc_id").collect()] == [("mit", "mit"), ("", "")]
    shared = licences.scan(frame(["Released under the MIT License.", "x", "y"], ids=[None, None, 1]), model).collect()
    assert sorted((r.doc_id or 0, r.licences) for r in shared) == [(0, "mit"), (0, "mit"), (1, "")]


@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_notices_are_confirmed(model, frame, mark):
    families = ("agpl-3.0", "apache-2.0", "bsd", "gpl-3.0", "lgpl", "mit")
    notices = [max(licences.TEMPLATES[f], key=len) for f in families]
    texts = [
        "\n".join([f"{mark}Copyright 2020 A", mark, *(mark + line for line in textwrap.wrap(n, width)), mark, "int x;"])
        for n in notices
        for width in (28, 76)
    ]
    got = {r.doc_id: r for r in licences.scan(frame([*texts, "\n\n".join(texts)]), model).collect()}
    for k in range(len(texts)):
        assert got[k + 1].confirmed == families[k // 2], (texts[k], got[k + 1])
        assert families[k // 2] in got[k + 1].licences.split(",") and got[k + 1].n_paragraphs >= 1
    assert got[len(texts) + 1].confirmed == ",".join(families)


def test_main_path_is_native(read, model):
    plan = licences.scan(read("documents"), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_notice_is_without_an_anchor():
    for own in (s for sets in licences._template_sets().values() for s in sets):
        trigrams = [g.split() for g in own if len(g.split()) == 3]
        assert sum(not set(g) & set(licences.anchors()) for g in trigrams) < licences.SIMILAR * max(1, len(trigrams))


def notices_of(texts):
    """Wrapped notices, one text and template at a time, word by word."""
    grams = {}
    for family, number, gram in licences.template_grams():
        grams.setdefault((family, number), set()).add(gram)
    found = set()
    for doc, text in enumerate(texts, 1):
        tokens = [(w, n) for n, line in enumerate((text or "").split("\n")) for w in licences.words(line)]
        three = [tokens[i : i + 3] for i in range(len(tokens) - 2)]
        every = []
        for (family, _), own in grams.items():
            if any(len(g.split()) != 3 for g in own):
                continue
            hits = [(i, " ".join(w for w, _ in t), t[0][1] if t[0][1] == t[2][1] else -1) for i, t in enumerate(three)]
            runs = []
            for hit in (h for h in hits if h[1] in own):
                if not runs or hit[0] - runs[-1][-1][0] > len(own):
                    runs.append([])
                runs[-1].append(hit)
            for run in runs:
                lines = {n: {g for _, g, m in run if m == n} for _, _, n in run if n >= 0}
                share = len({g for _, g, _ in run}) / len(own)
                alone = max([len(g) for g in lines.values()], default=0) / len(own)
                if share >= licences.SIMILAR:
                    every.append((run[0][0], run[-1][0], family, share, alone))
        for low, high, family, share, alone in every:
            beaten = any(
                f != family and s > share and 2 * (min(high, h) - max(low, b) + 3) > min(high - low, h - b) + 3
                for b, h, f, s, _ in every
            )
            if alone < licences.SIMILAR and not beaten:
                found.add((doc, family, round(share, 9)))
    return found


def test_wrapped_notices_against_brute_force(frame):
    """Templates cut at random places, with words lost and prose between, some of them broken over lines."""
    draw = random.Random(4)
    templates = [t for own in licences.TEMPLATES.values() for t in own]
    texts = [None, "", "\n"]
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            kept = [w for w in draw.choice(templates).split() if draw.random() > 0.1]
            parts.append(textwrap.fill(" ".join(kept[draw.randrange(3) :]), draw.choice([12, 30, 76, 500])))
            parts.append("the general state of the software and the sea" if draw.random() < 0.3 else "x")
        texts.append("\n".join(parts) if draw.random() < 0.5 else " ".join(parts).upper())
    got = {(r.doc_id, r.family, round(r.similarity, 9)) for r in licences.wrapped_notices(frame(texts)).collect()}
    assert got == notices_of(texts) and len({f for _, f, _ in got}) > 6
