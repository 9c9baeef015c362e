"""What wrappers decide from the evidence of a host's pages."""

import json
import random

import pytest

from faultfold.llm import html_wrapper as wrap


def extracted(spark, pages, host="http://a.example/x"):
    df = spark.createDataFrame([(k, host, p, "other") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    return [r.text for r in sorted(wrap.extract_pages(df).collect(), key=lambda r: r.page_id)]


def empty(page):
    return wrap.extract(page, wrap.read_wrapper(wrap.decided([], 0)))


STORY = "The council met on Monday to talk about the bridge, which has been closed since the flood of last spring. " * 2


def test_near_copies_keep_their_article(spark):
    def page(k):
        return f"<body><div><h1>Bridge</h1><p>{STORY}</p><p>printed at 10:0{k}</p></div></body>"

    for n in (2, 7):
        for k, text in enumerate(extracted(spark, [page(k) for k in range(n)])):
            assert text == f"Bridge\n\n{STORY.strip()}\n\nprinted at 10:0{k}"


def test_headings_between_varying_texts_stay(spark):
    def page(k):
        return (
            f"<body><div>Our site</div><div><h2>Introduction</h2><p>Story {k} {STORY}</p><h2>Conclusion</h2>"
            f"<p>So {k} it ends.</p></div><div>Call us</div></body>"
        )

    for k, text in enumerate(extracted(spark, [page(k) for k in range(40)])):
        assert text == f"Introduction\n\nStory {k} {STORY.strip()}\n\nConclusion\n\nSo {k} it ends."
    assert "Our site" in empty(page(1))  # without its host's wrapper


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='layout sidebar-right'><article><h1>T</h1><p>a</p></article><div class='sidebar'>s</div></div>", "T\n\na"),
        ("<form action='/x'><nav>n</nav><article><p>a</p><form>f</form></article></form>", "a"),
        (f"<form><div>{STORY}</div><p>More words here</p></form><form>q</form>", f"{STORY.strip()}\n\nMore words here"),
        (
            "<article><p>a</p><section id='comments'><article>Reader one</article><article>Reader two</article></section></article>",
            "a",
        ),
        ("<article><p>a</p><section id='comments'><article>Reader</article></section></article>", "a"),
        ("<article><p>a</p><p class='notice'>Take care with acid.</p><p>b</p></article>", "a\n\nTake care with acid.\n\nb"),
        ("<article><p>a</p><div class='notice'>We use cookies</div><p class='ad'>Buy</p></article>", "a"),
        ("<article><p>a</p><section id='discussion'><h2>Discussion</h2><p>b</p><p>c</p></section></article>", "a\n\nDiscussion\n\nb\n\nc"),
        ("<main><div class='overlay'><p>x</p></div><p>y</p></main>", "y"),
    ],
)
def test_one_page(spark, page, text):
    assert extracted(spark, [page]) == [text]
    assert extracted(spark, [page, page, page.replace("<p>a", "<p>a")]) == [text] * 3


def test_evidence_of_other_pages_decides(spark):
    """A page with a single comment, or a notice that is the same everywhere, is read as its host's other pages are."""

    def page(k):
        talk = "".join(f"<div><b>Reader {j}</b>said {k}.{j}</div>" for j in range(k % 4))
        warn = "Subscribers get our paper at home" if k != 5 else "Mind the acid in this recipe"
        return f"<article><h1>T{k}</h1><p>Words {k}</p><p class='notice'>{warn}</p><section id='comments'>{talk}</section></article>"

    pages = [page(k) for k in range(30)]
    for k, text in enumerate(extracted(spark, pages)):
        assert text == f"T{k}\n\nWords {k}" + ("\n\nMind the acid in this recipe" if k == 5 else "")
    assert "Reader 0" in empty(page(1))


@pytest.mark.parametrize("shown", [3, 77, 150, 298])
def test_every_page_of_a_host_is_evidence(spark, monkeypatch, shown):
    """One page of 300 shows that the comments repeat; the others have a single comment."""

    def page(k):
        talk = "".join(f"<div><b>Reader {j}</b>said {k}.{j}</div>" for j in range(3 if k == shown else 1))
        return f"<article><h1>T{k}</h1><p>Words {k}</p><section id='comments'>{talk}</section></article>"

    monkeypatch.setattr(wrap, "GROUP", 20)
    monkeypatch.setattr(wrap, "FAN", 3)
    assert extracted(spark, [page(k) for k in range(300)]) == [f"T{k}\n\nWords {k}" for k in range(300)]


def test_groups_of_pages_give_one_wrapper_despite_odd_pages(spark, monkeypatch):
    def page(k):
        if k % 50 == 7:
            return f"<body><div>New site</div><div><h1>T{k}</h1><p>Odd {k}</p></div></body>"
        body = "".join(f"<p>Story {k}.{j} {STORY}</p><h2>Part</h2>" for j in range(1 + k % 5))
        return f"<body><div>Our site</div><div><h1>Title {k}</h1>{body}<p>End {k}</p></div><div>Call us</div></body>"

    def text(k):
        if k % 50 == 7:
            return f"New site\n\nT{k}\n\nOdd {k}"
        parts = [b for j in range(1 + k % 5) for b in (f"Story {k}.{j} {STORY.strip()}", "Part")]
        return "\n\n".join([f"Title {k}", *parts, f"End {k}"])

    rows = [(k, "http://a.example/x", page(k % 200)) for k in range(400)]  # every page twice
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group, parts in ((1000, 1), (25, 3), (25, 7)):
        monkeypatch.setattr(wrap, "GROUP", group)
        monkeypatch.setattr(wrap, "FAN", 3)
        got = {r.page_id: r.text for r in wrap.extract_pages(df.repartition(parts)).collect()}
        assert got == {k: text(k % 200) for k in range(400)}


def test_a_page_with_an_article_does_not_undo_the_wrapper_of_the_others(spark):
    def page(k):
        tag = "article" if k == 20 else "main" if k in (3, 9) else "div"
        return f"<body><div>Our site</div><{tag}><h1>Title {k}</h1><p>Story {k} {STORY}</p></{tag}><div>Call us</div></body>"

    pages = [page(k) for k in range(60)]
    assert extracted(spark, pages) == [f"Title {k}\n\nStory {k} {STORY.strip()}" for k in range(60)]


def test_packed_nodes_come_back():
    pages = ["<dl>" + "<dt>t</dt><dd>d</dd>" * n + "</dl><p>x<b>y</b></p>" * (n % 3) for n in range(1, 20)]
    nodes = wrap.infer(pages)
    assert wrap.unpacked(wrap.packed(nodes)) == nodes
    deep = wrap.fold(wrap.parse("<div>" * 5000 + "x"))
    assert wrap.packed(wrap.unpacked(wrap.packed(deep))) == wrap.packed(deep)


def test_a_wrapper_of_many_pages_stays_bounded():
    rng = random.Random(5)
    tags = "p div ul blockquote h2 pre".split()

    def page():
        inner = lambda: "".join(rng.choice(["x ", "<b>y</b>", "<i>z</i>", "<a>w</a>"]) for _ in range(rng.randint(1, 12)))
        return "".join(f"<{t}>{inner()}</{t}>" for t in rng.choices(tags, k=rng.randint(1, 30)))

    pages = [page() for _ in range(400)]
    few, many = (len(json.loads(wrap.packed(wrap.infer(pages[:n])))) for n in (50, 400))
    assert many == few
    sizes = [len(json.loads(wrap.packed(wrap.infer([f"<p>a<tag{k}>b</tag{k}></p>" for k in range(n)])))) for n in (50, 400)]
    assert sizes[0] == sizes[1]


def test_elements_that_a_wrapper_has_not_come_in_their_order():
    pages = ["<h1>a</h1><p>x</p>"] * 12 + ["<h1>b</h1><hr><div>y</div><p>z</p><ul><li>1<li>2</ul><p>v</p>"]
    nodes = wrap.infer(pages)
    assert [(n.key, n.optional, n.pages, n.again) for n in nodes] == [
        ("h1", False, 13, 0), ("hr", True, 1, 0), ("div", True, 1, 0), ("p", False, 14, 1), ("ul", True, 1, 0)
    ]


def test_hosts_without_marks_against_their_making(spark):
    """Pages put together from constant and varying parts give the varying ones and what stands between them."""
    rng = random.Random(3)
    rows, want = [], {}
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    for host in range(12):
        above = "".join(f"<div><a href='/{j}'>{word()} {host}</a></div>" for j in range(rng.randint(1, 4)))
        below = "".join(f"<div class='x{j}'>{word()} {word()}</div>" for j in range(rng.randint(1, 3)))
        heads = [f"{word()} part" for _ in range(rng.randint(1, 3))]
        for k in range(rng.randint(6, 25)):
            parts, texts = [], []
            for head in heads:
                paragraphs = [" ".join(word() for _ in range(rng.randint(15, 40))) for _ in range(rng.randint(1, 4))]
                parts.append(f"<h2>{head}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs))
                texts += [head, *paragraphs]
            title = " ".join(word() for _ in range(4))
            page = f"<html><body>{above}<div class='content'><h1>{title}</h1>{''.join(parts)}</div>{below}</body></html>"
            rows.append((1000 * host + k, f"http://h{host}.example/{k}", page))
            want[rows[-1][0]] = "\n\n".join([title, *texts])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrap.extract_pages(df).collect()}
    assert got == want
    assert all(empty(page) != want[i] for i, _, page in rows)


def test_many_unlike_siblings_are_aligned_in_linear_time():
    rng = random.Random(1)
    tags = "p div ul blockquote pre h2 h3 table".split()
    pages = ["".join(f"<{t}>x{rng.random()}</{t}>" for t in rng.choices(tags, k=6000)) for _ in range(2)]
    nodes = wrap.infer(pages)
    wrapper = wrap.read_wrapper(wrap.decided(nodes, 2))
    assert wrap.extract(pages[0], wrapper).count("x0.") == 6000
