"""Page extraction and vector search against brute-force versions."""

from __future__ import annotations

import math
import random
import time

import pytest

from wartaframe.llm import ann, html_text

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b<b>c</p>d", "a\nbc\nd"),
        ("<article><h1>T &amp; U</h1><p><b>one<br>two<p>three\n  four&nbsp;</article><footer>f</footer>", "T & U\none two\nthree four"),
        ("<body><nav>x</nav><div class='site-header'>h</div><main><h1>T</h1><div class=ad>buy</div><p>k</p></main></body>", "T\nk"),
        ("<article><header><h1>T</h1></header><p>x</p><div class='comments'><article>r</article></div></article>", "T\nx"),
        ("<div class='cookie-notice'>c</div><p>body</p><form>f</form><aside>s</aside>", "body"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a\nb\n1\n2"),
        ("<script>if (a<b) {}</script><style>p{}</style><!-- <p>no</p> -->end", "end"),
        ("<p title='a>b'>q</p></span></article>tail", "q\ntail"),
        ("a < b & c", "a < b & c"),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_main_text_of_a_page(page, text):
    assert html_text.text_of(html_text.parse(page or ""), set()) == text


def pages(n: int):
    rng = random.Random(2)

    def words(k):
        return " ".join(rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randrange(99)) for _ in range(k))

    quote = "<p>a passage that many articles quote</p>"
    rows, texts = [], {}
    for i in range(n):
        own = [words(8) for _ in range(3)]
        body = "".join(f"<p>{p}</p>" for p in own)
        template = "<div><div>All our sections</div><div>Follow this site</div></div>"
        inner = quote if i % 3 == 0 else ""
        if i % 2:
            html = f"<body>{template}<article>{body}{inner}<section>Read our terms</section></article></body>"
        else:
            html = f"<body>{template}{body}{inner}<section>Read our terms</section></body>"
        rows.append((i, f"http://Site{i % 2}.example/{i}", html))
        quoted = ["a passage that many articles quote"] if inner else []
        texts[i] = "\n".join([*own, *quoted])
    return rows, texts


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_site_templates_go_and_quotes_stay(spark, broadcast):
    rows, texts = pages(40)
    rows += [(None, None, None), (500, None, ""), (501, "not a url", "<p>lone</p>"), rows[3]]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS site", "'x' AS templates", "'x' AS row")
    got = html_text.main_text(frame, broadcast).collect()
    assert len(got) == len(rows)
    for r in got:
        want = texts.get(r.page_id, "lone" if r.page_id == 501 else "")
        assert (r.text, r.n_chars) == (want, len(want))


def test_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def vectors(n: int, size: int = 16):
    rng = random.Random(4)
    return [(i, [rng.gauss(0, 1) for _ in range(size)], 0) for i in range(n)]


VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, queries, k=10):
    out = {}
    for q, v, *_ in rows:
        if q in queries:
            near = sorted((math.dist(v, x), i) for i, x, *_ in rows if i != q)
            out[q] = near[:k]
    return out


def test_small_tables_are_searched_wholly(spark):
    rows = vectors(300)
    rows += [(1000 + i, rows[0][1], 1) for i in range(30)]
    bad = [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [None] * 16, 0)]
    bad += [(2400, [1.0], 0), (2500, [], 0), (None, rows[1][1], 0), (2600, [float("inf")] * 16, 0), rows[7]]
    frame = spark.createDataFrame(rows + bad, VECTORS).selectExpr("*", "'x' AS id", "'x' AS v", "'x' AS shard", "'x' AS rank")
    got = {}
    for r in ann.nearest(frame, ann.standard_queries()).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, {i for i, *_ in rows if i % 100 == 0})
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [(k + 1, i) for k, (_, i) in enumerate(near)] == [(k, i) for k, i, _ in sorted(got[q])]
        assert all(math.isclose(s, d) for (_, _, s), (d, _) in zip(sorted(got[q]), near))


def test_recall_with_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    monkeypatch.setattr(ann, "RERANK_LEAST", 100)
    rows = vectors(3000, 24)
    want = brute(rows, {i for i, *_ in rows if i % 100 == 0})
    found = ann.nearest(spark.createDataFrame(rows, VECTORS), ann.standard_queries()).collect()
    hits = sum((r.score, r.vec_id) in {(d, i) for d, i in want[r.query_id]} or r.vec_id in {i for _, i in want[r.query_id]} for r in found)
    assert len(found) == 300 and hits / 300 >= 0.9


def test_few_or_no_vectors(spark):
    rows = vectors(4)
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), ann.standard_queries()).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(0, 1), (0, 2), (0, 3)]
    assert ann.nearest(spark.createDataFrame([], VECTORS), ann.standard_queries()).count() == 0
    assert ann.nearest(spark.createDataFrame(vectors(1), VECTORS), ann.standard_queries()).count() == 0


def test_copies_of_a_page_have_one_vote(spark):
    rng = random.Random(5)

    def article(i):
        parts = [" ".join(f"w{rng.randrange(999)}" for _ in range(9)) for _ in range(3)]
        html = f"<article><h1>Title {i}</h1><div><p>{parts[0]}</p></div><section><p>{parts[1]}</p></section><p>{parts[2]}</p></article>"
        return html, "\n".join([f"Title {i}", *parts])

    ten, ten_text = article(0)
    rows = [(i, f"http://ten.example/{i}", f"<body>{ten}</body>") for i in range(10)]
    want = {i: ten_text for i in range(10)}
    # half of a host's pages copy one article under many urls, each with its own menu; the box is template
    box = "<div><div>All our sections</div></div>"
    for i in range(20, 40):
        html, text = (ten, ten_text) if i % 2 else article(i)
        rows.append((i, f"http://half.example/{i}", f"<body><nav>menu {i}</nav>{box}{html}</body>"))
        want[i] = text
    # null urls share a host; the first row is landed again and again
    rows += [(50, None, f"<body>{ten}</body>")] * 6
    want[50] = ten_text
    # without an article, the paragraphs of a repeated page stay
    rows += [(60 + i, f"http://plain.example/{i}", "<p>one</p><div>two</div>") for i in range(8)]
    want |= {60 + i: "one\ntwo" for i in range(8)}
    for broadcast in (10**6, 0):
        got = html_text.main_text(spark.createDataFrame(rows, PAGES), broadcast).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text == want[r.page_id]
    found = html_text.recurring(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.site for r in found} == {html_text._site("half.example")}


@pytest.mark.parametrize(
    "page",
    [
        '<a "' * 250_000,
        '<a "' * 250_001 + ">",
        '<a ">"' * 150_000,
        "<a \"'>" * 150_001,
        "<span>" * 50_000 + "</b>" * 50_000,
        "<p><section>" + "<span>" * 50_000 + "<ul>" * 50_000,
        "<div>" * 50_000 + "</p>" * 50_000,
    ],
)
def test_broken_pages_take_linear_time(page):
    begun = time.monotonic()
    root = html_text.parse(page + "<p>end</p>")
    html_text.text_of(root, set())
    assert time.monotonic() - begun < 15


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title='a>b'>one</p>", "one"),
        ("<p>one <a href=\"x>two</a> three</p><p>four</p>", "one two three\nfour"),
        ("<p>1 < 2 and <b>3</b></p>", "1 < 2 and 3"),
        ("<p>one</b> two</p></section><p>three", "one two\nthree"),
        ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
    ],
)
def test_broken_markup(page, text):
    assert html_text.text_of(html_text.parse(page), set()) == text
