"""Main text of web pages by wrappers: union-free regular expressions over a host's token streams.

A page becomes a stream of tags and texts, nested by its tags as browsers nest them (unclosed paragraphs
and items end where the next begins). A wrapper is learned for each host: starting with one page, each
further page is aligned with it. Equal tags are merged and their contents aligned in turn; different texts
at one place become a text slot, equal ones stay constant. Where tags do not match, runs of equal tags or
of equal tag sequences up to :data:`PERIOD` long first become repeated groups; what is still on one side
only becomes optional. There are no alternatives, so the result is union-free. A wrapper of :data:`BASE` pages or more
takes in further ones where extraction would place them: they add evidence and optional elements, but fold nothing, so
one odd page does not undo what many have shown. Pages whose form is rare come last.

The wrapper then decides what the article is, from what the host's pages have shown at its places:

* An element is left out by its tag (menus, footers, scripts and the like), or by a class, role or id that is such a
  word as a whole or a known compound (``comment-list``, not ``share-prices``). Evidence comes first: an
  element that holds the only ``article`` or main element, or without these most of the text, stays
  (``layout sidebar-right``, a page in one form). In an article, a paragraph or another element of running text stays
  in spite of a class like ``notice`` unless the host says the same there on page after page; ids count for
  reader comments only, where some page of the host shows that the contents repeat as a group.
* Texts are the article inside ``article`` elements, else inside the main element. Without these they are the body but for
  texts that the host repeats at one place, if that place lies outside the varying block: the
  smallest element with :data:`MOST` of the varying text, from its first varying text (or the headings right before it) to its
  last. If less than :data:`VARYING` of a host's text varies, and a quarter on two pages, its pages are near copies and
  nothing is a repeated text.

Pages are aligned with their host's wrapper and give the texts of its article slots. What a page has
beyond the wrapper is judged by the same rules with what the page itself shows.

A host has a wrapper for each kind of its pages, by what marks their article. It is learned from all different pages of
that kind, in groups by the hash of the page whose wrappers are joined
:data:`FAN` at a time, so no task sees a large host whole and the result does not depend on partitions. Which texts
are repeated is counted over all pages of a kind: a text is left out only where it itself stands at such a
place of the wrapper, and only if it makes at least :data:`SAME` of the texts at that place and is on two
different pages or more. All pages are extracted. Null html counts as empty and has no text; a null or odd url belongs
to the host ``""``. Copies of a page are learned from once and extracted one by one, ids may be null or repeat,
ties do not occur, and further columns are ignored, whatever their names. A very long page is one tree in one task; lists of
siblings are aligned in linear time and memory beyond :data:`TABLE` comparisons.
"""

from __future__ import annotations

import html as references
import hashlib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import bounded_batches, written

PERIOD, SAME = 3, 0.9
#: Pages that are aligned with each other before a wrapper only takes in further ones.
BASE = 12
#: Share of the varying text that the varying block holds, and share of all text that must vary.
MOST, VARYING = 0.8, 0.1
#: Largest table of comparisons for a longest common subsequence.
TABLE = 1 << 16
#: Pages and characters of folded pages that one group learns from, and wrappers that are joined at a time.
GROUP, GROUP_CHARS, FAN = 256, 1 << 24, 16

# Elements by their role in a page, and words of class names, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead title tr".split())
SIBLINGS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "thead": ("tr", "td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"),
    "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
ASIDE_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea input iframe object embed svg "
    "canvas audio video dialog menu map datalist search title noembed noframes xmp".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription comment comments discussion disqus respond replies "
    "reply share sharing social related recommended widget pagination pager login signup search contentinfo "
    "complementary alert alertdialog dialog".split()
)
#: Words that make a known compound with an aside word, as in comment-list or site-footer.
COMPOUND = frozenset(
    "area areas article articles bar block blocks box btn button buttons container form global icon icons items left link "
    "links list panel posts primary right secondary section site slot thread top unit widget widgets wrap wrapper".split()
)
#: Their ids are often made from their titles.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 hgroup section".split())
MAIN_WORDS = frozenset(["main", "articlebody"])
#: Of reader comments; the first ones mean nothing else.
TALK_WORDS = frozenset("comment comments disqus respond replies discussion".split())
ONLY_TALK = frozenset("comment comments disqus respond".split())
#: Never part of an article, whatever the element.
STRONG_WORDS = TALK_WORDS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs consent cookie cookies gdpr "
    "newsletter pager pagination promo promotion share sharing social sponsor sponsored subscribe subscription".split()
)
#: Elements of running text.
RUNNING = frozenset(
    "a abbr b blockquote caption cite code dd dt em figcaption figure font h1 h2 h3 h4 h5 h6 i li mark p pre q small "
    "span strong sub sup td th time tr u".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A form is left out too, but for what it holds.
HARD_TAGS = ASIDE_TAGS - {"form"}
#: Tags that wrappers tell apart, with custom elements. Others, as in ``vector<int>``, are one, or each would be a node.
KNOWN = BLOCK | RUNNING | VOID | RAW | ASIDE_TAGS | frozenset(
    "acronym applet bdi bdo big blink colgroup data del dfn frame frameset ins kbd label marquee math meter nobr output picture "
    "progress rp rt ruby s samp slot strike tt var".split()
)

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_attribute = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_word = re.compile(r"[A-Za-z]+")


def nested(steps):
    """A function from a generator function that yields its inner calls, as ``f.steps(...)``, for their results.

    The calls are kept in a list, so pages may be nested to any depth.
    """

    @wraps(steps)
    def run(*args):
        calls, result = [steps(*args)], None
        while calls:
            try:
                inner = calls[-1].send(result)
            except StopIteration as end:
                calls.pop()
                result = end.value
            else:
                calls.append(inner)
                result = None
        return result

    run.steps = steps
    return run


# -- pages as trees ----------------------------------------------------------------------------


@dataclass
class Element:
    """A tag with its role words and contents: elements and texts."""

    tag: str
    words: tuple[str, ...] = ()
    inside: list = field(default_factory=list)

    @property
    def key(self) -> str:
        tag = self.tag if self.tag in KNOWN or "-" in self.tag or self.tag == "#page" else "?"
        return tag + "".join("." + w for w in self.words)


def _role(token: str) -> str | None:
    """The aside word that a whole class, id or role stands for: itself, or one of a known compound."""
    parts = _word.findall(token.lower())
    if parts and all(w in ASIDE_WORDS or w in COMPOUND for w in parts):
        return next((w for w in parts if w in ASIDE_WORDS), None)
    return None


def _words(tag: str, raw: str) -> tuple[str, ...]:
    """The words of class, id and role that say what an element is for; those of ids begin with ``#``.

    Ids of headings say nothing; those of sections (``?``) may be made from their titles too.
    """
    if not raw or raw.isspace():
        return ()
    found = set()
    for name, *values in _attribute.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            value = "".join(values)
            roles = filter(None, map(_role, value.split()))
            if name != "id":
                found.update(roles)
            elif tag not in TITLED:
                found.update("#" + w for w in roles)
            elif tag == "section":
                found.update("?" + w for w in roles if w in TALK_WORDS)
            found.update(w for w in value.lower().split() if w in MAIN_WORDS and name in ("role", "itemprop"))
        elif name == "hidden":
            found.add("hidden")
    return tuple(sorted(found))


def parse(page: str) -> Element:
    """A page's tags and texts as a tree. What an unclosed tag at the end has begun is left out."""
    root = Element("#page")
    stack = [root]
    held: Counter[str] = Counter()

    def text(raw):
        if raw:
            inside = stack[-1].inside
            if inside and isinstance(inside[-1], str):
                inside[-1] += raw
            else:
                inside.append(raw)

    at, n = 0, len(page)
    while at < n:
        found = _token.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            for k in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if stack[k].tag == tag:
                    _close(stack, held, k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline tag does not close the block around it
            continue
        _close_for(stack, held, tag)
        element = Element(tag, _words(tag, found[3]))
        stack[-1].inside.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            element.inside.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        else:
            stack.append(element)
            held[tag] += 1
    return root


def _close(stack: list[Element], held: Counter[str], k: int) -> None:
    """End the elements from ``k`` on; ``held`` counts the open elements of each tag."""
    for element in stack[k:]:
        held[element.tag] -= 1
    del stack[k:]


def _close_for(stack: list[Element], held: Counter[str], tag: str) -> None:
    """End the paragraphs, items and cells that the start of ``tag`` ends."""
    ended = SIBLINGS.get(tag, ())
    if not (held["p"] and tag in ENDS_P or any(held[t] for t in ended)):
        return
    for k in range(len(stack) - 1, 0, -1):
        open_tag = stack[k].tag
        if open_tag in ended or (open_tag == "p" and tag in ENDS_P):
            _close(stack, held, k)
            if not ended:
                break  # a paragraph has no other paragraph open in it
        elif open_tag in SCOPE.get(tag, ()) or open_tag in ("table", "html", "body"):
            break
        elif open_tag in BLOCK and not ended:
            break


# -- wrappers ----------------------------------------------------------------------------------


@dataclass
class Node:
    """A wrapper's element: its key, whether it is optional or repeated, and its contents in order.

    A text slot has the key ``#text``; ``text`` is the hash of the one that most pages had there, with ``votes`` more
    pages than all others, ``pages`` how many held the slot, ``size`` its characters on all of them, and ``mixed`` says
    that a page had different texts there. ``again`` counts the pages that had more of a node than the wrapper. A repeated
    group of several elements has the key ``#group``.
    """

    key: str
    optional: bool = False
    repeated: bool = False
    text: int | None = None
    inside: list[Node] = field(default_factory=list)
    pages: int = 1
    votes: int = 1
    size: int = 0
    mixed: bool = False
    again: int = 0

    @property
    def tag(self) -> str:
        return self.key.split(".", 1)[0]

    @property
    def varies(self) -> bool:
        """Whether fewer than nine of ten pages share the text of a slot, as far as several had one."""
        return self.pages < 2 or self.text is None or 5 * self.votes < 4 * self.pages


def _as_node(element: Element) -> Node:
    """An element beyond the wrapper; what it holds is folded only where its words ask for it."""
    return Node(element.key, inside=fold(element) if "." in element.key else [])


@nested
def fold(element: Element) -> list[Node]:
    """The contents of an element as wrapper nodes."""
    nodes = []
    for item in element.inside:
        if isinstance(item, str):
            if not item.isspace():
                nodes.append(Node("#text", text=text_hash(item), size=len(" ".join(item.split()))))
        else:
            inside = [] if item.tag in HARD_TAGS else (yield fold.steps(item))
            nodes.append(Node(item.key, inside=inside))
    return nodes


def _shape(nodes: list[Node]) -> tuple:
    return tuple(n.key for n in nodes)


@nested
def _squares(nodes: list[Node]) -> list[Node]:
    """Neighbouring equal sequences of up to PERIOD elements become one repeated group."""
    for period in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(nodes):
            group, n = nodes[i : i + period], 1
            shape = _shape(group)
            plain = len(group) == period and not any(k in ("#text", "#group") for k in shape)
            plain = plain and (period == 1 or not any(g.repeated for g in group))
            while plain and _shape(nodes[i + n * period : i + (n + 1) * period]) == shape:
                n += 1
            if n == 1:
                out.append(nodes[i])
                i += 1
                continue
            merged = group
            for k in range(1, n):
                again = nodes[i + k * period : i + (k + 1) * period]
                pairs, merged = zip(merged, again), []
                for a, b in pairs:
                    merged.append((yield merge.steps(a, b, True)))
            if period == 1:
                merged[0].repeated = True
                out.append(merged[0])
            else:
                out.append(Node("#group", repeated=True, inside=merged))
            i += n * period
        nodes = out
    return nodes


@nested
def merge(one: Node, other: Node, same_page: bool = False) -> Node:
    """One node that covers two with the same key, of different pages or of the same."""
    text, votes, mixed = one.text, one.votes + other.votes, one.mixed or other.mixed
    if one.text != other.text:
        mixed, votes = mixed or same_page, abs(one.votes - other.votes)
        text = max((one, other), key=lambda n: n.votes).text
    elif same_page:
        votes = max(one.votes, other.votes)
    if mixed or not votes:
        text, votes = None, 0
    return Node(
        one.key,
        one.optional or other.optional,
        one.repeated or other.repeated,
        text,
        (yield align.steps(one.inside, other.inside, same_page)),
        max(one.pages, other.pages) if same_page else one.pages + other.pages,
        votes,
        one.size + other.size,
        mixed,
        one.again + other.again,
    )


def _matches(one: list[Node], other: list[Node]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of keys, as index pairs. Equal ends are matched first."""
    n, m, low = len(one), len(other), 0
    while low < min(n, m) and one[low].key == other[low].key:
        low += 1
    tail = 0
    while tail < min(n, m) - low and one[n - 1 - tail].key == other[m - 1 - tail].key:
        tail += 1
    a, b = one[low : n - tail], other[low : m - tail]
    pairs = [(k, k) for k in range(low)]
    if len(a) * len(b) > TABLE:
        pairs += [(low + i, low + j) for i, j in _next_matches(a, b)]
        return pairs + [(n - k, m - k) for k in range(tail, 0, -1)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            same = a[i].key == b[j].key
            best[i][j] = best[i + 1][j + 1] + 1 if same else max(best[i + 1][j], best[i][j + 1])
    i, j = 0, 0
    while i < len(a) and j < len(b):
        if a[i].key == b[j].key:
            pairs.append((low + i, low + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs + [(n - k, m - k) for k in range(tail, 0, -1)]


def _next_matches(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """A common subsequence of long lists, in linear time: each element meets the next equal one, unless that is further
    away than the other list's next element is from its own."""
    place: dict[str, list[int]] = {}
    for j, node in enumerate(b):
        place.setdefault(node.key, []).append(j)
    pairs, j = [], 0
    for i, node in enumerate(a):
        places = place.get(node.key, ())
        k = bisect_left(places, j)
        if k < len(places) and places[k] - j <= max(PERIOD, len(b) - len(a) + i - j + PERIOD):
            pairs.append((i, places[k]))
            j = places[k] + 1
    return pairs


@nested
def align(one: list[Node], other: list[Node], same_page: bool = False) -> list[Node]:
    """One list that covers two: matched nodes are merged; on a mismatch, repeats are folded and the rest is optional."""
    if _shape(one) == _shape(other):
        merged = []
        for a, b in zip(one, other):
            merged.append((yield merge.steps(a, b, same_page)))
        return merged
    one, other = (yield _squares.steps(one)), (yield _squares.steps(other))
    out, i, j = [], 0, 0
    for a, b in [*_matches(one, other), (len(one), len(other))]:
        for node in (*one[i:a], *other[j:b]):
            node.optional = True
            out.append(node)
        if a < len(one):
            out.append((yield merge.steps(one[a], other[b], same_page)))
        i, j = a + 1, b + 1
    return (yield _squares.steps(out))


def _next_place(places: list[int] | None, at: int) -> int | None:
    """The first of the places of a key from ``at`` on, or the first of all."""
    if not places:
        return None
    k = bisect_left(places, at)
    return places[k if k < len(places) else 0]


def _ungrouped(nodes: list[Node]) -> list[Node]:
    """The nodes with the members of groups in the place of the groups, each repeated."""
    if not any(n.key == "#group" for n in nodes):
        return nodes
    out = []
    for node in nodes:
        for member in node.inside if node.key == "#group" else ():
            member.repeated = True
        out += node.inside if node.key == "#group" else [node]
    return out


@nested
def absorb(one: list[Node], other: list[Node]) -> list[Node]:
    """The nodes of a wrapper of many pages with what others show at the places where extraction looks for them.

    Only keys that the wrapper has not at all become nodes of their own, so its size is bounded by its base and its keys.
    """
    out, other = list(_ungrouped(one)), _ungrouped(other)
    places: dict[str, list[int]] = {}
    for k, node in enumerate(out):
        places.setdefault(node.key, []).append(k)
    added: dict[str, tuple[int, Node]] = {}
    met, at = set(), 0
    for node in other:
        k = _next_place(places.get(node.key), at)
        if k is not None:
            out[k] = yield take_in.steps(out[k], node)
            out[k].again += node.pages if k in met and not out[k].repeated else 0
            met.add(k)
            at = k if out[k].repeated else k + 1
        elif node.key in added:
            where, first = added[node.key]
            first = yield take_in.steps(first, node)
            first.again += node.pages
            added[node.key] = where, first
        else:
            node.optional = True
            added[node.key] = at, node
    for k, node in enumerate(out):
        node.optional = node.optional or k not in met
    for where, node in reversed(sorted(added.values(), key=lambda a: a[0])):
        out.insert(where, node)
    return out


@nested
def take_in(one: Node, other: Node) -> Node:
    """A node of many pages with the evidence of another one. A slot that is mixed on one side has no vote from there."""
    votes, text = one.votes + other.votes, one.text
    if one.text != other.text:
        votes, text = abs(one.votes - other.votes), max((one, other), key=lambda n: n.votes).text
    return Node(
        one.key,
        one.optional or other.optional,
        one.repeated,
        text if votes else None,
        (yield absorb.steps(one.inside, other.inside)),
        one.pages + other.pages,
        votes,
        one.size + other.size,
        one.mixed and other.mixed,
        one.again + other.again + (other.pages if other.repeated and not one.repeated else 0),
    )


def learned(pages: Iterable[list[Node]], base: int = BASE) -> list[Node]:
    """The wrapper of folded pages: the first ``base`` are aligned, the others taken in."""
    wrapper: list[Node] | None = None
    for n, nodes in enumerate(pages):
        wrapper = nodes if wrapper is None else align(wrapper, nodes) if n < base else absorb(wrapper, nodes)
    return wrapper or []


def infer(pages: list[str], base: int = BASE) -> list[Node]:
    """The wrapper of a host's pages."""
    return learned((fold(parse(page)) for page in pages), base)


def packed(nodes: list[Node]) -> str:
    """Nodes as JSON, in the order of the page, each with its depth."""
    listed: list[tuple] = []
    left = [(n, 0) for n in reversed(nodes)]
    while left:
        n, depth = left.pop()
        row = (depth, n.key, n.text, n.size, n.pages, n.votes, n.optional, n.repeated, n.mixed, n.again)
        listed.append(row[:2] if row[2:] == _PLAIN else row[:4] if row[4:] == _PLAIN[2:] else row)
        left.extend((m, depth + 1) for m in reversed(n.inside))
    return json.dumps(listed, ensure_ascii=False, separators=(",", ":"))


_PLAIN = (None, 0, 1, 1, False, False, False, 0)


def unpacked(raw: str) -> list[Node]:
    levels: list[list[Node]] = [[]]
    for depth, key, *rest in json.loads(raw):
        text, size, pages, votes, optional, repeated, mixed, again = (*rest, *_PLAIN[len(rest) :])
        node = Node(key, optional, repeated, text, [], pages, votes, size, mixed, again)
        del levels[depth + 1 :]
        levels[depth].append(node)
        levels.append(node.inside)
    return levels[0]


_NO_FORM = RUNNING | VOID | HARD_TAGS | {"#text", "?"}


def form(nodes: list[Node]) -> int:
    """A hash of a page's form: its elements but for those of running text and those left out by their tag."""
    digest = hashlib.blake2b(digest_size=8)
    left = [(n, 0) for n in reversed(nodes)]
    while left:
        node, depth = left.pop()
        if node.tag not in _NO_FORM:
            digest.update(f"{depth} {node.key}\n".encode("utf-8", "replace"))
        left.extend((n, depth + 1) for n in reversed(node.inside))
    return int.from_bytes(digest.digest(), signed=True)


# -- which slots are the article ---------------------------------------------------------------


def _repeats(node: Node, only_talk: bool) -> bool:
    """Whether the contents of a node repeat as a group: as elements that hold others, or as an article in the article."""
    for child in (node, *node.inside):
        alike: Counter[str] = Counter()
        for inner in child.inside:
            members = inner.inside if inner.key == "#group" else [inner]
            if any(m.tag == "article" for m in members):
                return True
            for m in members:
                if m.key != "#text" and (m.tag not in RUNNING or (only_talk and m.tag == "li")):
                    alike[m.key] += 2 if inner.repeated or inner.again else 1
        if any(n > 1 for n in alike.values()):
            return True
    return False


def _left_out(node: Node, inside_main: bool) -> bool:
    """Whether an element is no part of the article, by its tag, its words and what it was seen to hold."""
    if "." not in node.key and node.key not in ASIDE_TAGS and node.key != "header":
        return False
    tag, *words = node.key.split(".")
    if tag in ASIDE_TAGS or "hidden" in words:
        return True
    if tag == "header":
        return not inside_main
    if tag in ("html", "body"):
        return False
    ids = {w[1:] for w in words if w[0] in "#?"}
    if ids & TALK_WORDS and _repeats(node, bool(ids & ONLY_TALK)):
        return True
    if not inside_main and any(w[0] == "#" for w in words):
        return True
    named = ASIDE_WORDS.intersection(words)
    if inside_main and tag in RUNNING:
        named &= STRONG_WORDS
    return bool(named)


def _may_stay(node: Node) -> bool:
    """Whether an element is left out by such words only that what it holds can prove wrong."""
    tag, *words = node.key.split(".")
    return tag not in HARD_TAGS and "hidden" not in words and not STRONG_WORDS & {w.lstrip("#?") for w in words}


def _is_main(key: str, kind: str) -> bool:
    tag, *words = key.split(".")
    return tag == "article" if kind == "article" else tag == "main" or any(w in MAIN_WORDS for w in words)


def _paths(nodes: list[Node], kind: str, through: bool) -> set[int]:
    """The ids of the elements around the marks of a kind, and of the marks; ``through`` also looks into elements
    that are left out by their words."""
    found: set[int] = set()
    left: list[tuple[Node, tuple]] = [(n, ()) for n in nodes]
    while left:
        node, path = left.pop()
        if _left_out(node, False) and not (through and _may_stay(node)):
            continue
        here = (id(node), path)
        if _is_main(node.key, kind):
            while here:
                found.add(here[0])
                here = here[1]
        else:
            left.extend((n, here) for n in node.inside)
    return found


def marks(nodes: list[Node]) -> tuple[str, set[int]]:
    """What marks the article of a page or wrapper, and the ids of the elements around the marks."""
    for through in (False, True):
        for kind in ("article", "main"):
            if found := _paths(nodes, kind, through):
                return kind, found
    return "body", set()


def _marked(nodes: list[Node], kind: str) -> bool:
    return any(_paths(nodes, kind, through) for through in (False, True))


@dataclass(frozen=True)
class Wrapper:
    """A wrapper with its decisions: what marks the article, the nodes of the page, and by the number of a text slot the
    hash of the text that may be left out there."""

    kind: str
    nodes: Level
    constants: dict[int, int]


class Level:
    """The nodes of an element's contents, found by their key: key, whether it is kept, whether it is repeated,
    contents, number. Members of repeated groups are in the place of the groups."""

    def __init__(self):
        self.nodes: list[tuple[str, bool, bool, Level, int]] = []
        self.places: dict[str, list[int]] = {}

    def add(self, key: str, keep: bool, repeated: bool, inside: Level, number: int) -> None:
        self.places.setdefault(key, []).append(len(self.nodes))
        self.nodes.append((key, keep, repeated, inside, number))

    def find(self, key: str, at: int) -> int | None:
        """The next node with a key; a repeated node serves again, another one only once, unless none is left."""
        return _next_place(self.places.get(key), at)


def text_hash(text: str) -> int:
    """A 64-bit hash of a text, whatever its white space."""
    return int.from_bytes(hashlib.blake2b(" ".join(text.split()).encode("utf-8", "replace"), digest_size=8).digest(), signed=True)


def decided(nodes: list[Node], pages: int) -> str:
    """A wrapper with its decisions, as JSON; ``pages`` is how many different ones it was learned from."""
    kind, around = marks(nodes)
    size = _sizes(nodes, lambda n: n.size)
    total = sum(size.get(id(n), 0) for n in nodes)
    listed: list[list] = []
    slots: list[tuple[int, Node, tuple]] = []
    weak: list[int] = []
    left: list[tuple[Node, bool, int, tuple, bool]] = [(n, False, 0, (), False) for n in reversed(nodes)]
    while left:
        node, inside, depth, path, doubtful = left.pop()
        inside = inside or _is_main(node.key, kind)
        if node.key == "#text":
            if doubtful:
                weak.append(len(listed))
            slots.append((len(listed), node, path))
            listed.append([depth, "#text", inside or kind == "body", False])
            continue
        out = id(node) not in around and _left_out(node, inside)
        if out and kind == "body" and _may_stay(node):
            out = 2 * size.get(id(node), 0) <= total
        listed.append([depth, node.key, not out, node.repeated])
        if not out:
            words = ASIDE_WORDS.intersection(node.key.split(".")[1:])
            doubt = doubtful or (inside and node.tag in RUNNING and bool(words))
            left.extend((n, inside, depth + 1, (node, path), doubt) for n in reversed(node.inside))
    constants = {}
    if pages > 1:
        outside = _outside(nodes, slots, pages) if kind == "body" else set()
        constants = {k: n.text for k, n, _ in slots if (k in outside or k in weak) and not n.varies}
    return json.dumps([kind, listed, constants], ensure_ascii=False, separators=(",", ":"))


def _sizes(nodes: list[Node], of: Callable[[Node], int]) -> dict[int, int]:
    """By the id of every element, the sum of ``of`` over the text slots in it."""
    order, left = [], list(nodes)
    while left:
        node = left.pop()
        order.append(node)
        left.extend(node.inside)
    sums: dict[int, int] = {}
    for node in reversed(order):
        sums[id(node)] = of(node) if node.key == "#text" else sum(sums[id(n)] for n in node.inside)
    return sums


def _holds_parts(node: Node) -> bool:
    """Whether an element may be the block that a host's articles are in, and not one of their paragraphs."""
    often = node.repeated or node.again > (1 - SAME) * node.pages
    return not (node.key in ("#text", "#group") or often or node.tag in RUNNING)


def _outside(nodes: list[Node], slots: list[tuple[int, Node, tuple]], pages: int) -> set[int]:
    """The numbers of the kept text slots outside the varying block."""
    shown = {id(n) for _, n, _ in slots}
    varying = _sizes(nodes, lambda n: n.size if id(n) in shown and n.varies else 0)
    total = sum(varying[id(n)] for n in nodes)
    if not total or total < max(VARYING, 1 / pages**2) * sum(n.size for _, n, _ in slots):
        return set()
    block, inside = None, nodes
    while deeper := [n for n in inside if varying[id(n)] >= MOST * total and _holds_parts(n)]:
        block, inside = deeper[0], deeper[0].inside

    def around(path: tuple) -> Iterator[Node]:
        while path:
            yield path[0]
            path = path[1]

    within = [k for k, (_, n, path) in enumerate(slots) if block is None or any(a is block for a in around(path))]
    moving = [k for k in within if slots[k][1].varies]
    first, last = moving[0], moving[-1]
    while first > within[0] and any(a.tag in HEADINGS for a in around(slots[first - 1][2])):
        first -= 1
    return {number for k, (number, _, _) in enumerate(slots) if not first <= k <= last}


@lru_cache(maxsize=256)
def read_wrapper(raw: str) -> Wrapper:
    """A wrapper from its nodes in the order of the page, each with its depth; groups give way to their members."""
    kind, listed, constants = json.loads(raw)
    levels = [Level()]
    for number, (depth, key, keep, repeated) in enumerate(listed):
        del levels[depth + 1 :]
        inside = levels[depth] if key == "#group" else Level()
        if key != "#group":
            levels[depth].add(key, keep, repeated, inside, number)
        levels.append(inside)
    return Wrapper(kind, levels[0], {int(k): v for k, v in constants.items()})


# -- extraction --------------------------------------------------------------------------------


def extract(page: str, wrapper: Wrapper, constants: dict[int, int] | None = None, met: list | None = None) -> str:
    """:func:`extract_tree` of a page's html."""
    return extract_tree(parse(page), wrapper, constants, met)


def kind_for(tree: Element, kinds: Collection[str]) -> str:
    """Which of the kinds of pages that a host has wrappers for is a page's."""
    if len(kinds) == 1:
        return next(iter(kinds))
    return marks(fold(tree))[0] if kinds else "body"


def extract_tree(tree: Element, wrapper: Wrapper, constants: dict[int, int] | None = None, met: list | None = None) -> str:
    """The article's blocks, white space within them made single spaces, joined by two line ends.

    A page without the element that marks the wrapper's articles is read by a wrapper of its own. ``constants`` replaces
    the wrapper's; to ``met`` the places and hashes of the texts are added that constants may concern.
    """
    if wrapper.kind != "body" and not _marked(own := fold(tree), wrapper.kind):
        wrapper = read_wrapper.__wrapped__(decided(own, 1))
        constants = None
    if constants is None:
        constants = wrapper.constants
    blocks: list[str] = []
    part: list[str] = []

    def end_block():
        text = " ".join(references.unescape("".join(part)).split())
        part.clear()
        if text:
            blocks.append(text)

    @nested
    def walk(element, nodes, inside):
        """Texts of ``element``; ``nodes`` are the wrapper's for its contents, or None beyond the wrapper."""
        at = 0
        for item in element.inside:
            is_text = isinstance(item, str)
            key = "#text" if is_text else item.key
            slot = None
            if nodes is not None and not (is_text and item.isspace()):
                k = nodes.find(key, at)
                if k is not None:
                    slot = nodes.nodes[k]
                    at = k if slot[2] else k + 1
            if is_text:
                keep = slot[1] if slot else inside or wrapper.kind == "body"
                if keep and slot and slot[4] in wrapper.constants:
                    own_hash = text_hash(item)
                    keep = constants.get(slot[4]) != own_hash
                    if met is not None:
                        met.append((slot[4], own_hash))
                part.append(item if keep else " ")
                continue
            within = inside or _is_main(key, wrapper.kind)
            block = item.tag in BLOCK
            if block:
                end_block()
            if item.tag == "br":
                part.append(" ")
            elif slot[1] if slot else not _left_out(_as_node(item), within):
                yield walk.steps(item, slot[3] if slot else None, within)
            if block:
                end_block()

    walk(tree, wrapper.nodes, False)
    end_block()
    return "\n\n".join(blocks)


# -- Spark -------------------------------------------------------------------------------------


def host():
    """The host of ``url`` in lower case, or an empty string."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def folded(pages: DataFrame) -> DataFrame:
    """``host, kind, page, form, nodes``: every different page of a host, folded, by the hash of its html."""

    def run(batches):
        for batch in batches:
            out = []
            for host_name, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                nodes = fold(parse(text))
                out.append((host_name, marks(nodes)[0], page, form(nodes), packed(nodes)))
            columns = list(zip(*out)) or [()] * len(_FOLDED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOLDED)], schema=_FOLDED)

    rows = pages.where("html != ''").select(host().alias("host"), F.xxhash64("html").alias("page"), "html")
    return rows.mapInArrow(run, "host string, kind string, page long, form long, nodes string").dropDuplicates(["host", "page"])


def wrappers(pages: DataFrame, base: int = BASE) -> DataFrame:
    """``host, wrappers``: by the kind of page, the wrapper learned from all such pages of the host.

    The first ``base`` pages of a group are aligned, the others taken in.
    """
    rows = written(folded(pages), "folded")
    counts = rows.groupBy("host", "kind").agg(F.count("*").alias("pages"), F.sum(F.length("nodes")).alias("chars"))
    groups = F.ceil(F.greatest(F.col("pages") / GROUP, F.col("chars") / GROUP_CHARS))
    large = written(counts.select("host", "kind", groups.alias("groups")).where("groups > 1"), "large")
    most = large.agg(F.max("groups")).first()[0] or 1
    number = F.pmod("page", F.coalesce("groups", F.lit(1))).alias("number")
    parts = rows.join(F.broadcast(large), ["host", "kind"], "left").select("host", "kind", number, "page", "form", "nodes")

    def learn(key, group):
        pages, forms, nodes = (group.column(c).to_pylist() for c in ("page", "form", "nodes"))
        common = Counter(forms)
        order = sorted(range(len(pages)), key=lambda k: (common[forms[k]] < (1 - SAME) * len(pages), pages[k]))
        return _part(key, learned((unpacked(nodes[k]) for k in order), base), len(pages))

    def join(key, group):
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("number", "pages", "nodes"))))
        return _part(key, learned((unpacked(r[2]) for r in rows), 1), sum(r[1] for r in rows))

    parts = parts.groupBy("host", "kind", "number").applyInArrow(learn, _PART)
    while most > 1:
        parts = written(parts, "wrappers")
        upper = F.floor(F.col("number") / FAN)
        parts = parts.withColumn("upper", upper).groupBy("host", "kind", "upper").applyInArrow(join, _PART)
        most = -(-most // FAN)

    def decide(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("nodes", "pages"))
            raw = [decided(unpacked(nodes), n) for nodes, n in zip(*columns)]
            kept = [batch.column("host"), batch.column("kind"), pa.array(raw, pa.string())]
            yield pa.RecordBatch.from_arrays(kept, ["host", "kind", "wrapper"])

    return written(_by_kind(parts.mapInArrow(decide, "host string, kind string, wrapper string"), "wrapper", "wrappers"), "wrappers")


def _by_kind(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("kind", column))).alias(name))


_FOLDED = pa.schema(
    [("host", pa.string()), ("kind", pa.string()), ("page", pa.int64()), ("form", pa.int64()), ("nodes", pa.string())]
)
_PART = "host string, kind string, number long, pages long, nodes string"


def _part(key: tuple, nodes: list[Node], pages: int) -> pa.Table:
    host_name, kind, number = (k.as_py() for k in key)
    columns = {"host": [host_name], "kind": [kind], "number": [number], "pages": [pages], "nodes": [packed(nodes)]}
    return pa.table(columns)


_NONE = decided([], 0)
_MET = pa.schema(
    [
        ("host", pa.string()),
        ("kind", pa.string()),
        ("page", pa.int64()),
        ("place", pa.int32()),
        ("said", pa.int64()),
        ("n", pa.int64()),
    ]
)


def repeated_texts(rows: DataFrame) -> DataFrame:
    """``host, constants`` from ``host, html, wrappers``: by kind and place, the hash of the text that is repeated there.

    Only wrappers with places of repeated texts need it. Counts are added up by text and place, so no task sees a host
    whole; copies of a page count once. The result is bounded by the wrappers.
    """

    def run(batches):
        for batch in batches:
            out = []
            for host_name, page, by_kind in zip(*(c.to_pylist() for c in batch.columns)):
                met: list = []
                tree, by_kind = parse(page), dict(by_kind)
                kind = kind_for(tree, by_kind)
                extract_tree(tree, read_wrapper(by_kind.get(kind, _NONE)), {}, met)
                number = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=8).digest(), signed=True)
                out += [(host_name, kind, number, place, said, n) for (place, said), n in Counter(met).items()]
            columns = list(zip(*out)) or [()] * len(_MET)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MET)], schema=_MET)

    asked = rows.where("html is not null and exists(map_values(wrappers), w -> not endswith(w, ',{}]'))")
    met = asked.select("host", "html", "wrappers").mapInArrow(
        run, "host string, kind string, page long, place int, said long, n long"
    )
    texts = (
        met.groupBy("host", "kind", "place", "said", "page")
        .agg(F.max("n").alias("n"))
        .groupBy("host", "kind", "place", "said")
        .agg(F.count("*").alias("pages"), F.sum("n").alias("n"))
    )
    places = texts.groupBy("host", "kind", "place").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "pages", "said")).alias("top")
    )
    constant = places.where((F.col("top.n") >= SAME * F.col("all")) & (F.col("top.pages") > 1))
    said = F.map_from_entries(F.collect_list(F.struct("place", "top.said"))).alias("said")
    return written(_by_kind(constant.groupBy("host", "kind").agg(said), "said", "constants"), "constants")


def extract_pages(pages: DataFrame, base: int = BASE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    known = wrappers(pages, base)
    rows = pages.withColumn("host", host()).join(known, "host", "left")
    constants = repeated_texts(rows)
    rows = rows.join(constants, "host", "left").select("page_id", "url", "html", "wrappers", "constants")

    def text(page, by_kind, said):
        tree, by_kind = parse(page or ""), dict(by_kind or ())
        kind = kind_for(tree, by_kind)
        return extract_tree(tree, read_wrapper(by_kind.get(kind, _NONE)), dict(dict(said or ()).get(kind, ())))

    def run(batches):
        for batch in batches:
            texts = [text(*row) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
