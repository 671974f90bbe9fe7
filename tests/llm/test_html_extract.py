import html
import re
import time

import pytest

from tessera.llm import html_extract, queries
from tessera.llm.common import table
from tessera.llm.html_blocks import blocks
from tessera.llm.html_pages import labelled_pages


def expected(page):
    """The article of the test tables' template, read off with a pattern."""
    body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in queries.op3_html_extract(spark, sf).collect()}
    rows = table(spark, sf, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == expected(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
        assert got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize(
    "page",
    [
        "<b>x" * 20_000 + "</i>" * 20_000,
        "<div>x" * 30_000,
        "".join(f"<div class='c{i}'>x" for i in range(30_000)),
        "<b>" * 30_000 + "<hr>x" * 30_000,
        "<li><ul>" + "<b>" * 20_000 + "<li>x" * 20_000,
        "<div><li>x" * 20_000,
        "<p><span>" * 30_000 + "</p>" * 30_000,
        "<td>x" * 30_000 + "</table>" * 30_000,
        "<" * 200_000,
        "<p title='" + "x" * 300_000,
    ],
)
def test_hostile_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html_extract.default_field().extract(page)
    assert time.perf_counter() - began < 5


#: Pages written by hand, in layouts that the generator doesn't make, and their articles.
BY_HAND = [
    (
        """<!doctype html><html lang=en><body class="post-template-default single"><div id=page><div id=masthead role=banner><p class=site-title><a href=/>A Blog</a></p></div>
        <nav class=main-navigation role=navigation><ul><li><a href=/a>About</a></li><li><a href=/c>Contact</a></li></ul></nav>
        <div id=content class=site-content><div id=primary><main id=main role=main><article class="post hentry"><h1 class=entry-title>On keeping bees</h1>
        <div class=entry-content><p>Bees need water close to the hive, in every month in which they fly, and more of it in a hot summer.</p>
        <p>A shallow dish with stones in it is enough, since bees that cannot stand will drown in open water.</p>
        <blockquote><p>Put the dish where the morning sun reaches it, and never move it once they have found it.</p></blockquote></div></article>
        <div id=comments class=comments-area><h2>2 comments</h2><ol><li><p>Nice post, thanks for this!</p></li><li><p>I use a bird bath myself.</p></li></ol></div></main></div>
        <div id=secondary class=widget-area role=complementary><h3>Recent posts</h3><ul><li><a href=/1>On ants</a></li></ul></div></div>
        <div id=colophon role=contentinfo class=site-footer>&copy; A Blog. All rights reserved.</div></div></body></html>""",
        "On keeping bees\nBees need water close to the hive, in every month in which they fly, and more of it in a hot summer.\nA shallow dish with stones in it is enough, since bees that cannot stand will drown in open water.\nPut the dish where the morning sun reaches it, and never move it once they have found it.",
    ),
    (
        """<html><body><table width=100%><tr><td class=header colspan=2><a href=/>Home</a> | <a href=/news>News</a> | <a href=/shop>Shop</a></td></tr>
        <tr><td class=sidebar><b>Sections</b><br><a href=/x>Trains</a><br><a href=/y>Boats</a></td>
        <td class=content><h1>The night train returns</h1><p>After nine years without one, the night train between the two towns will run again from May, the company said on Monday.</p>
        <p>It leaves at ten in the evening and arrives at seven, with two sleeping cars and a seated one, and bicycles travel free.</p></td></tr>
        <tr><td class=footer colspan=2>Copyright The Paper</td></tr></table></body></html>""",
        "The night train returns\nAfter nine years without one, the night train between the two towns will run again from May, the company said on Monday.\nIt leaves at ten in the evening and arrives at seven, with two sleeping cars and a seated one, and bicycles travel free.",
    ),
    (
        """<body><div class="cookie-notice"><p>This site uses cookies. <button>Accept</button></p></div><header class="site-header"><ul class="nav"><li><a href="#">Docs</a></li><li><a href="#">Blog</a></li></ul></header>
        <section class="article-body" id="story"><h2>Sorting in place</h2><p>To sort a list in place, call its own method; the list that it was is gone, and nothing is returned to you.</p>
        <p>The method takes a key, a function of one item, which is called once for each and not once for each comparison.</p></section>
        <aside class="related-posts"><h4>Read next</h4><a href="#">Sorting stably</a></aside><footer><p>Made by hand. Contact us.</p></footer></body>""",
        "Sorting in place\nTo sort a list in place, call its own method; the list that it was is gone, and nothing is returned to you.\nThe method takes a key, a function of one item, which is called once for each and not once for each comparison.",
    ),
]


@pytest.mark.parametrize(("page", "article"), BY_HAND)
def test_pages_written_by_hand(page, article):
    assert html_extract.default_field().extract(page) == article


def test_held_out_pages_of_the_same_kind():
    crf, right, total = html_extract.default_field(), 0, 0
    for page in map(blocks, labelled_pages(200, seed=77)):
        said = crf.decode(page)
        right += sum(a == (b.label == "1") for a, b in zip(said, page, strict=True))
        total += len(page)
    assert right / total > 0.98


def test_parts_that_are_not_the_article():
    page = """<html><head><title>T</title><style>x{}</style></head><body>
    <header><h1>Site</h1></header><div class="menu"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
    <div id="cookie-banner">We use cookies on this site.</div>
    <main><h1>Title &amp; more</h1><p>First   paragraph
    with <i>inline</i> text&nbsp;here, long enough to be prose.</p><script>var x = "<p>no</p>";</script>
    <div class="advert">Buy now at the shop.</div><p>Second paragraph, and it has some more words in it.</p></main>
    <div class="comments"><h3>Comments</h3><p>I liked this a lot, thanks for writing it.</p></div>
    <form action="/s"><label>Search</label><input><select><option>a</select></form>
    <aside><p>Most read: something else.</p></aside><footer>&copy; Someone</footer></body></html>"""
    assert html_extract.default_field().extract(page) == "Title & more\nFirst paragraph with inline text here, long enough to be prose.\nSecond paragraph, and it has some more words in it."


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (None, []),
        ("", []),
        ("  \n", []),
        ("plain &lt;text&gt;", ["plain <text>"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<p>a<br>b<!-- c --> d", ["a b d"]),
        ("<p>a<script>x</script>b<style>y", ["ab"]),
        ("<p>1 < 2 and 3 > 2</p><p", ["1 < 2 and 3 > 2"]),
        ("<!-- open <p>x", []),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<div hidden><p>a</p></div><div style='display: none'>b</div><div>c</div>", ["c"]),
        ("<p title='a > b'>x</p>", ["x"]),
        ("</p></div>x</body>y", ["x", "y"]),
        ("<p>The mass is <math><mi>m</mi><mo>=</mo><mn>2</mn><annotation>m=2</annotation></math> in kg.", ["The mass is m=2 in kg."]),
        ("<p>Press <button>Save</button> to go on.</p><div><button>Share</button> <button>Print</button></div>", ["Press Save to go on."]),
        ("<b><i>x</b>y</i></u></i>z", ["xyz"]),
        ("<table><tr><td>a<td>b<tr><td><p>c<table><tr><td>d</table>e</table>f", ["a", "b", "c", "d", "e", "f"]),
        ("<ul><li>a<div><li>b</ul>c", ["a", "b", "c"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("<p>a<b>b<div>c</div>d", ["ab", "c", "d"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_viterbi_matches_all_paths():
    from itertools import product

    import numpy as np

    crf = html_extract.default_field()
    page = blocks(labelled_pages(1, seed=5)[0])[:9]
    scores = crf.scores(page)

    def value(path):
        return crf.start[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(crf.between[a, b] for a, b in zip(path, path[1:], strict=False))

    best = max(product((0, 1), repeat=len(page)), key=value)
    assert [bool(y) for y in best] == crf.decode(page)
    assert np.isfinite(scores).all()


def test_edge_cases(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "v", "<article>" + "<p>Some words here.</p>" * 20_000, "x"), (None, "w", "<article><p>Words of an article.</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((str(r["page_id"]), str(r["url"]), r["n_chars"]) for r in html_extract.extract_text(df).collect())
    assert got == [("1", "None", 0), ("2", "u", 0), ("2", "u", 0), ("3", "v", 20_000 * 17 - 1), ("None", "w", 20)]
    assert html_extract.extract_text(df.limit(0)).count() == 0
