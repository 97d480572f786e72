import math
import time

import numpy as np
import pytest

from plinth.llm.maintext import Page, _pruned, densities, extract, main_text

P = [" ".join(f"word{i}{j}" for j in range(40)) for i in range(6)]
LINKS = "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(8))


def test_template_with_all_parts():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>" ;</script></head><body class="has-sidebar">
<header><h2>Site</h2><nav><ul>{LINKS}</ul></nav></header><div class="cookie-notice"><p>{P[4]}</p></div>
<main><article><header><h1>Head &amp; line</h1><p class="byline">By somebody</p></header><p>{P[0]}<br>new&nbsp;line</p><div class="adBox">{P[5]}</div>
<h2>Part</h2><p>{P[1]} <a href=x>link</a>ed <b>bo</b>ld</p><ul><li>one</li><li>two</ul><form><label>Mail</label><input value=x><button>Go</button></form><aside>{P[2]}</aside>
<script>if (1 < 2) document.write("<p>no</p>")</script><footer>Tags: x</footer></article>
<section id="comments"><h3>3 comments</h3><article class="comment"><p>{P[3]}</p></article></section></main>
<div role="complementary">{P[5]}</div><div hidden>{P[5]}</div><footer>&copy; all</footer></body></html>"""
    assert main_text(page) == f"Head & line {P[0]} new line Part {P[1]} linked bold one two"


def test_density_alone_finds_the_article():
    page = f"<div><div>{''.join(f'<a href=/{i}>menu {i}</a> ' for i in range(12))}</div><div><h1>Title</h1><div><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></div></div><div><a href=x>Imprint</a> | <a href=y>Terms</a></div></div>"
    assert main_text(page) == f"Title {P[0]} {P[1]} {P[2]}"
    table = f"<table><tr><td><a href=1>a</a><br><a href=2>b</a><td><p>{P[0]}<p>{P[1]}</table>"
    assert main_text(table) == f"{P[0]} {P[1]}"


def test_headings_name_comments_and_related_lists():
    page = f"<body><article><h1>T</h1><p>{P[0]}</p><div><h3>Related articles</h3><ul>{LINKS}</ul></div><p>{P[1]}</p></article><div><h2>Comments (2)</h2><p>{P[2]}</p><p>{P[3]}</p></div></body>"
    assert main_text(page) == f"T {P[0]} {P[1]}"


def test_words_at_what_holds_the_page_do_not_count():
    page = f"<body><div class='menu'>{LINKS}</div><div class='layout no-sidebar'><h1>T</h1><p>{P[0]}</p><p>{P[1]}</p></div><div class='sidebar'><p>{P[2]}</p></div></body>"
    assert main_text(page) == f"T {P[0]} {P[1]}"
    page = f"<body><article><h1>T</h1><p>{P[0]}</p></article><div id='comments'><p>{P[1]}</p><p>{P[2]}</p><p>{P[3]}</p></div></body>"
    assert main_text(page) == f"T {P[0]}"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("  \n ", ""), ("plain  text\n&lt;here&gt;", "plain text <here>"), ("<nav>only</nav>", ""), ("<p>one<p>two", "one two"), ("a < b <3 c", "a < b <3 c"),
        ("<p>x<!-- <p>no --> y</p><!----><!-->z", "x y z"), ("<article><p>in<b>ter</b>nal</p></div></article> tail", "internal"), ("<p title='a > b'>kept</p>", "kept"), ('<p title="never closed>kept</p>', "kept"),
        ("<p>cut off <a href='x", "cut off"), ("<script>never closed <p>x", ""), ("<p>&#x48;&#105;&amp;amp; &notanentity; &#xD800;", "Hi&amp; ¬anentity; �"), ("<head><title>t</title><p>body</p>", "body"),
        ("<b><p>one</p></b><p>two</b> three</p>", "one two three"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"), ("<p>x</p >y<p/>z", "x y z"), ("</></ >t", "t"), ("<![CDATA[x]]>y<?php a ?>z", "yz"),
        ("<body>x</body></html>y", "x y"), ("<ARTICLE><H1>Up</H1></ARTICLE>", "Up"), ("<article>" * 2 + "a" + "</article>" * 3, "a"), ("<form><article><p>in a form</p></article></form>", "in a form"), ("ﬁ x", "ﬁ x"),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


def test_hostile_pages_are_linear():
    for page in ("<div>" * 200_000 + "x", "<" * 500_000, "<p a=\"" * 100_000, "<!--" * 200_000, "<b>" * 100_000 + "<div></b>" * 50_000, "<p><b>" * 100_000 + "end", "<script>" * 100_000, "</p>" * 200_000, "<a><i>" * 100_000, "&" * 500_000, "<li>" * 100_000 + "<td>" * 100_000):
        begin = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - begin < 20


def test_densities_against_definition():
    rng = np.random.default_rng(4)
    for _ in range(30):
        page, depth = "", 0
        for _ in range(rng.integers(1, 60)):
            kind = rng.integers(0, 5)
            if kind == 0:
                page, depth = page + "<div>", depth + 1
            elif kind == 1 and depth:
                page, depth = page + "</div>", depth - 1
            elif kind == 2:
                page += "<a href=x>" + "l" * int(rng.integers(0, 9)) + "</a>"
            else:
                page += "<p>" + "t" * int(rng.integers(0, 90)) + "</p>"
        tree = Page(page)
        gone = _pruned(tree)
        _, _, _, density, sums = densities(tree, gone)
        kids = [[k for k in range(len(tree.tags)) if tree.parents[k] == i] for i in range(len(tree.tags))]
        below = lambda i: [i, *(x for k in kids[i] for x in below(k))]
        linked = lambda i: i >= 0 and (tree.tags[i] == "a" or linked(tree.parents[i]))
        size = [sum(len(t) for n, t in tree.events if t and n == i) for i in range(len(tree.tags))]

        def one(i):
            nodes, body = below(i), below(0)
            c, lc = sum(size[x] for x in nodes), sum(size[x] for x in nodes if linked(x))
            t, lt = max(len(nodes) - 1, 1), max(sum(tree.tags[x] == "a" for x in nodes), 1)
            if not c:
                return 0.0
            cb, lb = max(sum(size), 1), sum(size[x] for x in body if linked(x))
            base = math.log(c / max(c - lc, 1) * lc + lb / cb * c + math.e)
            return c / t * max(math.log(max(c / max(lc, 1) * t / lt, 1e-12)) / math.log(max(base, 1 + 1e-9)), 0.0)

        assert np.allclose(density, [one(i) for i in range(len(tree.tags))])
        assert np.allclose(sums, [sum(one(k) for k in kids[i]) for i in range(len(tree.tags))])


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{P[0]} é</p></article>", "x", 5), (None, None, None, None, None), (1, "u", "", "y", 1), (1, "u", "<p>" + "long text " * 300_000, "z", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(1, "u", f"{P[0]} é"), (None, None, ""), (1, "u", ""), (1, "u", ("long text " * 300_000).strip())]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((*r, len(r[2])) for r in want), key=str)
    assert extract(df.limit(0)).collect() == []
