"""Wrapper extraction on pages, and top-k search against all products."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultfold.llm import html_wrapper as wrap
from faultfold.llm import topk
from faultfold.llm.queries import QUERIES


def article(page):
    """The text of pages whose article is one element with headings and paragraphs."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)
    blocks = re.split(r"</?(?:p|h1)>", found[1] if found else "")
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_tables(spark, data, read):
    rows = {r.page_id: r for r in QUERIES["op10_html_text"](spark, data).collect()}
    pages = read("pages").collect()
    assert len(rows) == len(pages)
    for p in pages:
        assert (rows[p.page_id].text, rows[p.page_id].n_chars) == (article(p.html), len(article(p.html)))


def one(page):
    return wrap.extract(page, wrap.read_wrapper(wrap.decided(wrap.infer([page]), 1)))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><header>Top</header><nav>a</nav><div class='cookie-notice'>c</div><main><h1>T &amp; U</h1><p>One<br>two "
         "<b>bo</b>ld.<p>Three</main><aside>s</aside><section class=comments><p>bad</section><footer>f</footer>",
         "T & U\n\nOne two bold.\n\nThree"),
        ("<div id=sidebar>x</div><div><p>Hello</p><ul><li>a<li>b</ul></div><form>q<input></form>", "Hello\n\na\n\nb"),
        ("<article><header><h1>H</h1></header><p>x</p><div class=share>s</div><table><tr><td>1<td>2</table></article>",
         "H\n\nx\n\n1\n\n2"),
        ("<article><p>a 'b\" <em>c</em>d</p></article><article class='comment'><p>e</p></article>", "a 'b\" cd"),
        ("<article><p>a<!-- <p>b -->c<script>var t='</p>'</script> d &lt;p&gt; 1 < 2</p></article", "ac d <p> 1 < 2"),
        ("plain &copy; text", "plain © text"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("", ""),
        ("<p>a<p", "a"),
    ],
)
def test_pages(page, text):
    assert one(page) == text


def test_a_wrapper_tells_constant_text_from_slots():
    def page(k):
        return f"<body><div>Welcome to our site</div><div><p>Story {k}</p>{'<p>More</p>' * k}</div><div>Call us</div></body>"

    nodes = wrap.infer([page(k) for k in range(4)])
    wrapper = wrap.read_wrapper(wrap.decided(nodes, 4))
    assert wrap.extract(page(7), wrapper).startswith("Story 7")
    assert "Welcome" not in wrap.extract(page(7), wrapper) and "Call us" not in wrap.extract(page(7), wrapper)


def test_alignment_makes_optional_and_repeated_groups():
    one, two = (wrap.fold(wrap.parse(p)) for p in ("<h1>a</h1><p>x</p>", "<h1>b</h1><hr><p>x</p><p>y</p>"))
    merged = wrap.align(one, two)
    assert [(n.key, n.optional, n.repeated) for n in merged] == [("h1", False, False), ("hr", True, False), ("p", False, True)]
    assert merged[0].inside[0].text is None and merged[2].inside[0].text is None
    pairs = wrap.align(*[wrap.fold(wrap.parse("<dl>" + "<dt>t</dt><dd>d</dd>" * n + "</dl>")) for n in (3, 4)])
    assert [(n.key, n.repeated) for n in pairs[0].inside] == [("#group", True)]


def test_ids_and_classes_made_from_titles_are_no_roles():
    page = (
        "<article><h2 id='search-algorithms'>A</h2><h2 id='related-work'>B</h2><section id='discussion'>C</section>"
        "<h3 id='alert-rules'>D</h3><div class='share-prices'>E</div><div class='section' id='discussion'>F</div>"
        "<div class='comment-list'>x</div><div class='share buttons'>y</div><ul role=navigation><li>z</ul></article>"
    )
    assert one(page) == "\n\n".join("ABCDEF")
    assert one(re.sub("</?article>", "", page)) == "\n\n".join("ABCDE")


@pytest.mark.parametrize("depth", [99, 150, 20000])
def test_nesting_has_no_limit(depth):
    def nest(inner, tag="div"):
        return f"<{tag}>" * depth + inner + f"</{tag}>" * depth

    assert one(nest("<article><p>a</p></article>")) == "a"
    assert one(f"<article><div>{nest('x')}<p>after</p></div>end</article>menu") == "x\n\nafter\n\nend"
    assert one(nest("<nav>n</nav><form>f</form><div class=comments>c</div>t")) == "t"
    assert one(f"<article><div>{'<font>' * depth}a</div><p>b<p>c</article>") == "a\n\nb\n\nc"
    pages = [nest(f"<b>Story {k}</b><hr>" + "<i>k</i>" * k) for k in range(3)]
    wrapper = wrap.read_wrapper(wrap.decided(wrap.infer(pages), 3))
    assert wrap.extract(pages[1], wrapper).startswith("Story 1")


def test_texts_that_differ_outside_the_sample_are_kept(spark):
    def page(k):
        body = "Same words" if k < 2 else f"Story {k} <b>bold {k}</b> end {k}"
        quote = f"<blockquote>Quote {k}</blockquote>" if k % 15 == 0 else ""
        return f"<div>Our site</div><div><h1>Title {k}</h1>{quote}<p>{body}</p></div><div>Call us</div>"

    rows = [(k, "http://a.example/x", page(k)) for k in range(60)] + [(k, "http://a.example/x", page(2)) for k in range(60, 200)]
    rows.append((200, "http://a.example/x", "<div>Changed site</div><div><h1>T</h1><p>p</p></div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in wrap.extract_pages(df).collect()}
    for k in range(60):
        said = "Same words" if k < 2 else f"Story {k} bold {k} end {k}"
        quote = f"Quote {k}\n\n" if k % 15 == 0 else ""
        assert texts[k] == f"Title {k}\n\n{quote}{said}"
    assert texts[200] == "Changed site\n\nT\n\np"
    # A sample of two near copies does not make their text constant.
    near = df.where("page_id < 60")
    assert {r.page_id: r.text for r in wrap.extract_pages(near, 2).collect()}[0].endswith("Quote 0\n\nSame words")


def test_null_pages_and_no_pages(spark):
    rows = [(1, None, None), (None, "odd", "<p>x</p>"), (1, "http://A.example/b", "<article>y</article>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in wrap.extract_pages(df).collect())
    assert got == sorted([(1, "", 0), (0, "x", 1), (1, "y", 1)] * 2)
    assert wrap.extract_pages(df.limit(0)).count() == 0


def best(rows, k, is_query):
    vectors = [
        (n, i, np.floor(64 * np.array(v, np.float64)).astype(np.int64))
        for n, (i, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for n, q, x in vectors:
        if q is not None and is_query(q):
            scores = [(-int(x @ v), i is None, i or 0) for m, i, v in vectors if m != n and len(v) == len(x)]
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_top_k_matches_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]), (203, []), (None, [1.0, 1.0, 1.0])]
    rows += [(20, [0.5, 0.5, 0.5]), (40, rows[40][1]), (40, rows[40][1])]
    rows += [(i, rng.normal(size=2).tolist()) for i in (20, 60, 61, 61, 62)] + [(80, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))

    def got(k):
        found = topk.top_k(df, F.col("vec_id") % 20 == 0, k).collect()
        return sorted([(r.query_id, r.rank, r.vec_id, r.score) for r in found], key=str)

    for k in (2, 200):
        assert got(k) == best(rows, k, lambda q: q % 20 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    # Blocks meet however many partitions they are dealt over.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = got(5)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == best(rows, 5, lambda q: q % 20 == 0)


def test_most_candidates_are_never_read(spark, monkeypatch):
    """Exact vectors are joined in rounds; with clustered vectors the first ones settle every query."""
    read = []
    whole = topk._scored

    def scored(width):
        read.append(width)
        return whole(width)

    monkeypatch.setattr(topk, "_scored", scored)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) + 8 * (i % 5)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(df, F.col("vec_id") % 500 == 0, 3).collect()
    assert sorted([(r.query_id, r.rank, r.vec_id, r.score) for r in found], key=str) == best(
        [(i, np.float32(v).tolist()) for i, v in rows], 3, lambda q: q % 500 == 0
    )
    assert len(read) <= 6


def test_tables_of_vectors(spark, data, read):
    rows = [(r.vec_id, r.embedding) for r in read("embeddings").collect()]
    ids, matrix = np.array([r[0] for r in rows]), np.floor(64 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    expected = []
    for q, x in zip(ids, matrix):
        if q % 20 == 0:
            order = sorted((-s, i) for s, i in zip((matrix @ x).tolist(), ids.tolist()) if i != q)[:20]
            expected += [(int(q), n, i, -s) for n, (s, i) in enumerate(order, 1)]
    got = QUERIES["op6_top_k"](spark, data).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(expected)
