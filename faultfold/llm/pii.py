"""Personal data: rules for four kinds of spans, and a character-level tagger that adds to them.

The tagger is a bidirectional LSTM over character classes with a linear-chain CRF, written and trained in
numpy. Its labelled spans are what patterns find in at most :data:`SAMPLE` documents, chosen by the hash
of their ids, local telephone numbers included, and written examples in further formats put into the same texts, next to
numbers that are nobody's (dates, prices, versions). Windows of :data:`WIDTH` characters overlap by :data:`OVERLAP`;
every character takes its scores from the window it is most central in, and the scores of windows that join are
decoded as one sequence, so that windows neither cut spans nor disagree.

Every kind needs a digit or an ``@``. A window without one cannot hold a span, so it is not decoded.

A tagged span is added if it is one of the kinds by their checks, the tagged kind first, begins and ends where its
characters do, and overlaps no span of the rules; those all stay. Null text counts as empty and has no
spans. Repeated rows and rows with null ids are searched one by one; ties do not occur; an empty table has an empty result, and a
tagger without texts is trained on examples alone. Very long texts are searched whole, with about 40 bytes a character in
memory where they hold digits throughout. Further columns are ignored, or kept where texts are replaced, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import bounded_batches, sampled

KINDS = ("email", "ip", "card", "phone")
WIDTH, OVERLAP = 128, 48
SAMPLE, STEPS, BATCH, HIDDEN = 400, 400, 48, 18
Span = tuple[str, int, int]


# -- rules -------------------------------------------------------------------------------------

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails at its start fails inside too, so each run is tried once.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]")
_local_phone = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """An e-mail address begins as far left of its ``@`` as its characters and the address before it allow."""
    end, at = 0, text.find("@")
    while at >= 0:
        if found := _domain.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in _local:
                start -= 1
            if start < at:
                end = found.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = "".join(_digits.findall(s))
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(s: str) -> bool:
    return 9 <= len(_digits.findall(s)) <= 15


def rule_spans(text: str, checked: bool = True) -> list[Span]:
    """The leftmost matches of each kind that do not overlap, without those that fail their check."""
    spans = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern, check in (("ip", _ip, _is_ip), ("card", _card, _is_card), ("phone", _phone, _is_phone)):
        if kind == "phone" and "+" not in text:
            continue
        for found in pattern.finditer(text):
            if not checked or check(found[0]):
                spans.append((kind, found.start(), found.end()))
    return spans


def passes(kind: str, text: str) -> bool:
    """The check of a tagged span."""
    if kind == "email":
        at = text.find("@")
        return at > 0 and bool(_domain.fullmatch(text, at + 1)) and set(text[:at]) <= _local
    if kind == "ip":
        return bool(_ip.fullmatch(text)) and _is_ip(text)
    if kind == "card":
        return bool(_card.fullmatch(text)) and _is_card(text)
    return bool(_local_phone.fullmatch(text)) or (bool(_phone.fullmatch(text)) and _is_phone(text))


# -- the tagger --------------------------------------------------------------------------------

_CLASS = np.full(128, 1, np.uint8)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 \n\t.,;:!?@+-_()[]{}<>/\\|#$%&*='\"~^`"):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = _k + 4
CLASSES = int(_CLASS.max()) + 1
TAGS = 1 + 2 * len(KINDS)
_ACTIVE = np.zeros(CLASSES, bool)
_ACTIVE[_CLASS[[ord(c) for c in "0123456789@"]]] = True


def classes(text: str) -> np.ndarray:
    """Padding is 0, other ASCII 1, other letters 2, other characters 3; letters do not differ by case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CLASS[np.minimum(points, 127)]
    wide = points > 127
    out[wide] = np.where(points[wide] < 0x2000, 2, 3)
    return out


@dataclass
class Tagger:
    """Weights of both directions (inputs, recurrent), of the output, and the CRF's transitions.

    The gates are in the order input, forget, output, candidate, and use one tanh: a logistic
    function is a tanh of half its argument.
    """

    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.output, self.bias, self.moves]


def fresh(seed: int = 5, hidden: int = HIDDEN) -> Tagger:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    inputs = [normal(CLASSES, 4 * hidden, scale=0.3) for _ in range(2)]
    for w in inputs:
        w[:, hidden : 2 * hidden] += 1
    recurrent = [normal(hidden, 4 * hidden, scale=hidden**-0.5 / 2) for _ in range(2)]
    return Tagger(
        inputs, recurrent, normal(2 * hidden, TAGS, scale=0.2), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)
    )


def _run(inputs, recurrent, rows: np.ndarray, keep: bool):
    """One direction over class rows (time first): hidden states, and what the way back needs."""
    steps, n = rows.shape
    hidden = len(recurrent)
    half = np.full(4 * hidden, 0.5, np.float32)
    half[3 * hidden :] = 1
    inputs, recurrent = inputs * half, recurrent * half
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    states, kept = np.empty((steps, n, hidden), np.float32), []
    for t in range(steps):
        gates = inputs[rows[t]]
        gates += h @ recurrent
        np.tanh(gates, out=gates)
        gates[:, : 3 * hidden] *= 0.5
        gates[:, : 3 * hidden] += 0.5
        i, f, o, g = (gates[:, k * hidden : (k + 1) * hidden] for k in range(4))
        before = c
        c = f * before + i * g
        bent = np.tanh(c)
        if keep:
            kept.append((gates, before, bent, h))
        h = o * bent
        states[t] = h
    return states, kept


def emissions(tagger: Tagger, rows: np.ndarray, keep: bool = False):
    """Scores of each tag at each place (time first)."""
    ahead, kept_a = _run(tagger.inputs[0], tagger.recurrent[0], rows, keep)
    back, kept_b = _run(tagger.inputs[1], tagger.recurrent[1], rows[::-1], keep)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    return states @ tagger.output + tagger.bias, (states, kept_a, kept_b)


def viterbi(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The best tag sequence of each column, of which the first ``lengths`` places count."""
    steps, n, tags = scores.shape
    lengths = np.full(n, steps) if lengths is None else lengths
    best, came, last = scores[0].copy(), np.zeros((steps, n, tags), np.int8), np.zeros(n, np.int64)
    for t in range(1, steps + 1):
        ended = lengths == t
        if ended.any():
            last[ended] = best[ended].argmax(1)
        if t < steps:
            ways = best[:, :, None] + moves[None]
            came[t] = ways.argmax(1)
            best = ways.max(1) + scores[t]
    out, tag, column = np.zeros((steps, n), np.int8), last, np.arange(n)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        out[t, inside] = tag[inside]
        tag = np.where(inside, came[t, column, tag], tag)
    return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _crf_gradient(scores, moves, tags):
    """Gradients of the negative log-likelihood by scores and by transitions."""
    steps, n, _ = scores.shape
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = _sum_exp(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        back[t] = _sum_exp(moves + (back[t + 1] + scores[t + 1])[:, None, :], 2)
    total = _sum_exp(ahead[-1], 1)
    by_score = np.exp(ahead + back - total[None, :, None])
    both = ahead[:-1, :, :, None] + moves
    both += (scores[1:] + back[1:] - total[None, :, None])[:, :, None, :]
    by_move = np.exp(both, out=both).sum((0, 1))
    np.subtract.at(by_move, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    place, column = np.indices(tags.shape)
    by_score[place, column, tags] -= 1
    return by_score / n, by_move / n


def _run_back(inputs, recurrent, rows, kept, by_state):
    """Gradients of one direction by backpropagation through time."""
    hidden = len(recurrent)
    back = np.ascontiguousarray(recurrent.T)
    by_h = np.zeros_like(by_state[0])
    by_c = np.zeros_like(by_h)
    by_gates = np.empty((len(rows), *by_h.shape[:1], 4 * hidden), by_h.dtype)
    for t in range(len(rows) - 1, -1, -1):
        gates, before, bent, _ = kept[t]
        i, f, o, g = (gates[:, k * hidden : (k + 1) * hidden] for k in range(4))
        by_h = by_h + by_state[t]
        by_c = by_c + by_h * o * (1 - bent * bent)
        here = by_gates[t]
        np.multiply(by_c, g, out=here[:, :hidden])
        np.multiply(by_c, before, out=here[:, hidden : 2 * hidden])
        np.multiply(by_h, bent, out=here[:, 2 * hidden : 3 * hidden])
        soft = gates[:, : 3 * hidden]
        here[:, : 3 * hidden] *= soft * (1 - soft)
        np.multiply(by_c, i * (1 - g * g), out=here[:, 3 * hidden :])
        by_h, by_c = here @ back, by_c * f
    flat = by_gates.reshape(-1, 4 * hidden)
    by_recurrent = np.stack([h for *_, h in kept]).reshape(-1, hidden).T @ flat
    order = np.argsort(rows.ravel(), kind="stable")
    found, first = np.unique(rows.ravel()[order], return_index=True)
    by_inputs = np.zeros_like(inputs)
    by_inputs[found] = np.add.reduceat(flat[order], first)
    return by_inputs, by_recurrent


def gradient(tagger: Tagger, rows: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    scores, (states, kept_a, kept_b) = emissions(tagger, rows, keep=True)
    by_score, by_move = _crf_gradient(scores, tagger.moves, tags)
    flat = by_score.reshape(-1, TAGS)
    by_state = by_score @ tagger.output.T
    hidden = len(tagger.recurrent[0])
    first = _run_back(tagger.inputs[0], tagger.recurrent[0], rows, kept_a, by_state[:, :, :hidden])
    second = _run_back(tagger.inputs[1], tagger.recurrent[1], rows[::-1], kept_b, by_state[::-1, :, hidden:])
    by_output = states.reshape(-1, 2 * hidden).T @ flat
    return [first[0], second[0], first[1], second[1], by_output, flat.sum(0), by_move]


# -- training ----------------------------------------------------------------------------------


def _number(rng, n: int) -> str:
    return "".join(rng.choice(list("0123456789"), n))


def _card_number(rng) -> str:
    head = "4" + _number(rng, 14)
    return head + next(d for d in "0123456789" if luhn(head + d))


def example(rng, kind: str | None = None) -> tuple[str, str]:
    """A written example of a kind, in one of several formats."""
    kind = kind or KINDS[rng.integers(len(KINDS))]
    if kind == "email":
        name, place = ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(2))
        middle = rng.choice([".", "_", "+", ""]) + rng.choice(["", "7", "mail"])
        return kind, f"{name}{middle}@{place}{rng.choice(['.com', '.org', '.example.net', '.de'])}"
    if kind == "ip":
        return kind, ".".join(str(rng.integers(256)) for _ in range(4))
    if kind == "card":
        number, gap = _card_number(rng), rng.choice(["", " ", "-"])
        return kind, gap.join(number[k : k + 4] for k in range(0, 16, 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    if rng.integers(4):
        return kind, str(rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"]))
    return kind, str(rng.choice([f"+1 ({a}) {b}-{c}", f"+{_number(rng, 2)} {a} {b} {c}", f"+{a}{b}{c}"]))


def no_example(rng) -> str:
    """A number that is nobody's."""
    two, three, four = (_number(rng, n) for n in (2, 3, 4))
    forms = [
        f"20{two}-0{two[0]}-1{two[1]}", f"{two}:{two}", f"{three}.{two}", f"{two[0]},{three},{three}", f"v{two[0]}.{two[1]}.{two}",
        f"{three}-{two}-{four}", f"{four}", f"{four}{four}", f"{two}.{two}.20{two}", f"({four})", f"{three}-{four}", f"no. {three}",
    ]
    return str(rng.choice(forms))


def tagged(spans: list[Span], n: int) -> np.ndarray:
    """Tags of a text: 0 outside, then first and further characters of each kind. Earlier spans win."""
    tags = np.zeros(n, np.int8)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 * KINDS.index(kind) + 2
            tags[a] -= 1
    return tags


def _shaped(text: str) -> list[Span]:
    """What is labelled in a text, the kind that wins first."""
    spans = [s for s in rule_spans(text, checked=False) if s[0] != "card" or s[2] - s[1] >= 13]
    local = [("phone", m.start(), m.end()) for m in _local_phone.finditer(text) if _stands_alone(text, *m.span())]
    order = {"email": 0, "phone": 1, "ip": 2, "card": 3}
    return sorted(spans + local, key=lambda s: (order[s[0]], s[1]))


def _put(rng, text: str, label: np.ndarray) -> tuple[str, np.ndarray]:
    """The text with an example or a number that is none put in between its words."""
    if rng.integers(4):
        kind, put = example(rng, "phone" if rng.integers(5) < 2 else None)
        mid = tagged([(kind, 0, len(put))], len(put))
    else:
        put = no_example(rng)
        mid = np.zeros(len(put), np.int8)
    free = np.flatnonzero(label == 0)
    spaces = [int(k) for k in free if k < len(text) and text[k].isspace()]
    if spaces and rng.integers(5):
        at = spaces[rng.integers(len(spaces))]
    else:
        at = int(free[rng.integers(len(free))]) if len(free) else 0
    before, behind = rng.choice([" ", " ", ": ", "\n", "(", "### "]), rng.choice([" ", " ", ". ", "\n", ")", "***", ", "])
    gaps = [np.zeros(len(g), np.int8) for g in (before, behind)]
    return text[:at] + before + put + behind + text[at:], np.concatenate([label[:at], gaps[0], mid, gaps[1], label[at:]])


def training_windows(texts: list[str], n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Class and tag windows, time first: near spans, anywhere, and with written examples put in.

    Numbers shaped like cards are tagged whether or not their check digit is right: that is no matter of
    characters, and checked afterwards.
    """
    rows, tags = np.zeros((n, WIDTH), np.uint8), np.zeros((n, WIDTH), np.int64)
    spans: dict[int, list[Span]] = {}
    for i in range(n):
        k = int(rng.integers(len(texts)))
        text = texts[k]
        if k not in spans:
            spans[k] = _shaped(text)
        own = spans[k]
        if own and i % 3 == 0:
            rare = KINDS[rng.integers(len(KINDS))]
            near = [s for s in own if s[0] == rare] or own
            _, a, _ = near[rng.integers(len(near))]
            start = max(0, a - int(rng.integers(0, WIDTH - 30)))
        else:
            start = int(rng.integers(max(1, len(text) - WIDTH // 2)))
        label = tagged(own, len(text))[start : start + WIDTH]
        text = text[start : start + WIDTH]
        for _ in range(int(rng.integers(1, 3)) if i % 3 else 0):
            text, label = _put(rng, text, label)
        cut = int(rng.integers(max(1, len(text) - WIDTH + 1)))
        text, label = text[cut : cut + WIDTH], label[cut : cut + WIDTH]
        rows[i, : len(text)], tags[i, : len(text)] = classes(text), label
    return rows.T.copy(), tags.T.copy()


def train(texts: list[str], steps: int = STEPS, seed: int = 5) -> Tagger:
    """A tagger fitted with Adam to windows of the texts; without texts, to written examples alone."""
    rng, tagger = np.random.default_rng(seed), fresh(seed)
    texts = [t for t in texts if t] or [" "]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in tagger.weights()]
    for step in range(1, steps + 1):
        rows, tags = training_windows(texts, BATCH, rng)
        rate = 0.025 * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, (m, v) in zip(tagger.weights(), gradient(tagger, rows, tags), moments):
            g = np.clip(g, -5, 5)
            m += 0.1 * (g - m)
            v += 0.005 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-7)
    return tagger


# -- search ------------------------------------------------------------------------------------


def tag_texts(tagger: Tagger, texts: list[str], width: int = WIDTH, overlap: int = OVERLAP) -> list[np.ndarray]:
    """The tags of whole texts. Windows that join are scored one by one, each character by the one it is most central in,
    and decoded together."""
    coded = [classes(t) for t in texts]
    out = [np.zeros(len(c), np.int8) for c in coded]
    stride, margin = width - overlap, overlap // 2
    windows: list[tuple[int, int]] = []
    for k, c in enumerate(coded):
        places = np.flatnonzero(_ACTIVE[c])
        if not len(places):
            continue
        last = max(0, -(-(len(c) - width) // stride))
        # The windows that hold a place run from the first that reaches it to the last that begins before it.
        first = np.clip(-(-(places - width + 1) // stride), 0, last)
        final = np.minimum(places // stride, last)
        reach = np.concatenate([first, final, np.minimum(first + 1, final)])
        windows.extend((k, int(w)) for w in np.unique(reach))

    def part_of(k: int, w: int) -> tuple[int, int]:
        """The characters a window scores."""
        n = len(coded[k])
        return w * stride + margin if w else 0, n if w * stride + width >= n else w * stride + width - margin

    runs: list[list[tuple[int, int]]] = []
    for k, w in windows:
        if runs and runs[-1][-1] == (k, w - 1):
            runs[-1].append((k, w))
        else:
            runs.append([(k, w)])
    scores = [np.empty((part_of(*run[-1])[1] - part_of(*run[0])[0], TAGS), np.float32) for run in runs]
    home = [(r, part_of(*run[0])[0]) for r, run in enumerate(runs) for _ in run]
    for at in range(0, len(windows), 512):
        part = windows[at : at + 512]
        rows = np.zeros((width, len(part)), np.uint8)
        for j, (k, w) in enumerate(part):
            piece = coded[k][w * stride : w * stride + width]
            rows[: len(piece), j] = piece
        scored = emissions(tagger, rows)[0]
        for j, (k, w) in enumerate(part):
            low, high = part_of(k, w)
            r, base = home[at + j]
            scores[r][low - base : high - base] = scored[low - w * stride : high - w * stride, j]
    order = sorted(range(len(runs)), key=lambda r: len(scores[r]))
    while order:
        group = [order.pop()]
        most = 2 * len(scores[group[0]]) // 3
        while order and len(group) < 256 and len(scores[order[-1]]) >= most:
            group.append(order.pop())
        lengths = np.array([len(scores[r]) for r in group])
        padded = np.zeros((lengths[0], len(group), TAGS), np.float32)
        for j, r in enumerate(group):
            padded[: lengths[j], j] = scores[r]
        tags = viterbi(padded, tagger.moves, lengths)
        for j, r in enumerate(group):
            k, w = runs[r][0]
            low = part_of(k, w)[0]
            out[k][low : low + lengths[j]] = tags[: lengths[j], j]
    return out


def read_spans(tags: np.ndarray) -> list[Span]:
    """Spans of a text's tags: a kind's run, begun anew where a first tag follows."""
    spans, kind, start = [], -1, 0
    for i in [*np.flatnonzero(tags).tolist(), len(tags)]:
        here = (int(tags[i]) - 1) // 2 if i < len(tags) else -1
        if kind >= 0 and (i > end or here != kind or tags[i] % 2 == 1):
            spans.append((KINDS[kind], start, end))
            kind = -1
        if kind < 0 and here >= 0:
            kind, start = here, i
        end = i + 1
    return spans


def _stands_alone(text: str, a: int, b: int) -> bool:
    """Whether a span is no part of a longer number or word."""
    before, after = text[a - 1 : a], text[b : b + 1]
    if before.isalnum() or after.isalnum():
        return False
    joined = "-.+/"  # between digits these go on with a number
    return not (before in joined and before and text[a - 2 : a - 1].isdigit()) and not (
        after in joined and after and text[b + 1 : b + 2].isdigit()
    )


def added_spans(text: str, base: list[Span], proposed: list[Span]) -> list[Span]:
    """Proposed spans that are of a kind, stand alone and overlap no span of the rules or one before."""
    out: list[Span] = []
    for kind, a, b in proposed:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a and text[a - 1] == "(" and ")" in text[a:b] and "(" not in text[a:b]:
            a -= 1  # a parenthesis that the span closes belongs to it
        if a >= b or not _stands_alone(text, a, b) or any(x < b and a < y for _, x, y in base + out):
            continue
        kinds = [kind, *[other for other in KINDS if other != kind]]
        if found := next((k for k in kinds if passes(k, text[a:b])), None):
            out.append((found, a, b))
    return out


def written_spans(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in order)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def fit(documents: DataFrame, sample: int = SAMPLE) -> Tagger:
    """A tagger trained on at most ``sample`` documents that hold a digit or an ``@``."""
    rows = sampled(documents.where("text rlike '[0-9@]'"), "doc_id", sample).select("text")
    return train(sorted(rows.toArrow().column("text").to_pylist()))


def find(documents: DataFrame, tagger: Tagger, replace: bool = False) -> DataFrame:
    """``doc_id, base, spans`` as ``kind:start:end`` lists, of the rules and of all; one scan, no shuffle.

    With ``replace`` the result has every column of ``documents``, with ``text`` redacted, instead.
    """
    bounded_batches(documents.sparkSession)

    def searched(texts):
        base = [rule_spans(t) for t in texts]
        more = [
            added_spans(text, own, read_spans(tags))
            for text, own, tags in zip(texts, base, tag_texts(tagger, texts))
        ]
        return base, more

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                base, more = searched([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([written_spans(b) for b in base], pa.string()),
                        pa.array([written_spans(b + m) for b, m in zip(base, more)], pa.string()),
                    ],
                    ["doc_id", "base", "spans"],
                )

    def run_replace(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                place = part.schema.get_field_index("text")
                texts = part.column(place).to_pylist()
                base, more = searched([t or "" for t in texts])
                clean = [None if t is None else redacted(t, b + m) for t, b, m in zip(texts, base, more)]
                yield part.set_column(place, part.schema.field(place), pa.array(clean, part.schema.field(place).type))

    if replace:
        return documents.mapInArrow(run_replace, documents.schema)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, base string, spans string"
    )
