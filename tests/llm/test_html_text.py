"""Extraction of main texts: on the given pages, on layouts that were not learnt from, and on broken markup."""

from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.llm import html_text
from cohortspan.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string"

# +n: words of the article, -n: other words. None of these is among the layouts that weights are learnt from.
HELD_OUT = """
<!DOCTYPE html><html><head><title>-5</title><style>p{color:red}</style></head><body class="home has-sidebar"><header class="top"><h1>-2</h1><nav><a href="/x">-1</a></nav></header><main id="main"><article><h2>+6</h2><p>+33</p><aside class="pull"><p>-9</p></aside><p>+21 <a href="q">+3</a> +4</p><form action="/s"><label>-2</label><input value="z"><button>-1</button></form><p>+1</p></article><section id="comments"><h3>-1</h3><article class="comment"><p>-40</p></article><article class="comment"><p>-60</p></article></section></main><aside><p>-12</p></aside><footer>-8</footer></body></html>
<html><body><div class="wrap"><div class="siteHeader"><a>-2</a></div><div class="leftMenu"><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></div><div class="articleText"><h1>+5</h1><p>+40<p>+22<p>+2</div><div class="cookieBar">-20</div><div class="commentsArea"><div class="c"><p>-50</p></div></div><div class="siteFooter"><p>-9</p></div></div></body></html>
<html><body><div id="hd">-3</div><div><a>-1</a> | <a>-1</a> | <a>-2</a> | <a>-1</a></div><div><h1>+5</h1><p>+35</p><p>+12</p><p>+55</p></div><div><a>-3</a> <a>-4</a> <a>-5</a> <a>-3</a></div><div class="legal-notice">-15</div></body></html>
<html><body><div class="notice"><p>-12</p></div><div class="entry"><p>+44</p><div class="advert-slot">-6</div><p>+38</p><ul><li>+6</li><li>+4</li></ul><p>+9</p></div><div class="reader-comments"><p>-33</p></div></body></html>
<html><body><nav><a>-1</a></nav><article><h1>+5</h1><p>+25</p><table><tr><td>+2</td><td>+1</td></tr></table><blockquote>+12</blockquote><pre>+9</pre><h2>+2</h2><p>+3</p></article><div class="newsletter-box"><p>-14</p></div><div id="cookie-consent"><p>-25</p></div><footer>-5</footer></body></html>
<html><body><article><header><h1>+5</h1><p>+5</p></header><p>+25</p><footer>-6</footer></article></body></html>
<html><body><form id="aspnetForm"><div class="navigation"><a>-1</a></div><div class="main-content"><h1>+4</h1><p>+45</p><p>+15</p></div><div class="footer">-4</div></form></body></html>
<html><body><div class="ad">-9</div><div class="content"><h1>+3</h1><p>+4</p></div><div class="sidebar"><p>-30</p><p>-30</p></div></body></html>
<html><body><div class="page"><div class="banner-notice">-8</div><section><h1>+4</h1><p>+28</p></section><section><h2>+3</h2><p>+32</p></section><section class="comments"><p>-33</p></section></div></body></html>
<html><body><nav>-4</nav><header>-3</header><aside>-8</aside><div class="notice">-8</div><footer>-5</footer></body></html>
<html><body><nav>-4</nav><div class="post"><p>+3</p></div><div class="ads"><p>-30</p></div><div class="comments"><p>-25</p></div><footer>-5</footer></body></html>
<html><body><div class="menu"><a>-1</a></div><div class="main"><div class="text"><p>+30</p><p>+30</p></div><div class="notice"><p>-9</p></div><div class="text"><p>+30</p></div></div><div class="comment"><p>-9</p></div><div class="sidebar">-7</div></body></html>
<html><body><header>-4</header><div role="main"><p>+20</p><div aria-hidden="true" style="display:none">-9</div><p>+31</p></div><div class="commentlist"><ol><li>-20</li><li>-18</li></ol></div></body></html>
<html><body><div><div><div><p>+30</p><div><p>+28</p></div><div><div><p>+19</p></div></div></div></div></div><ul class="footer-nav"><li><a>-1</a></li></ul></body></html>
<html><body><div id="page"><div id="top"><span>-2</span></div><div id="story"><span>+45</span><br><br><span>+33</span></div><div id="links"><a>-2</a><br><a>-3</a><br><a>-2</a></div></div></body></html>
<html><body><article><h1>+4</h1><p>+12</p><div class="notice">-11</div><p>+12</p><div class="ad">-8</div><p>+12</p><section class="comments"><h2>-1</h2><p>-15</p></section></article></body></html>
<html><body><main><h1>+4</h1><p>+14</p><p>+16</p></main><div class="sponsor">-9</div><div class="promo-banner">-9</div></body></html>
<html><body><div class="header">-3</div><div class="nav"><a>-2</a></div><div class="article"><h1>+5</h1><p>+15</p><p>+11</p></div><div class="sidebar">-18</div><div class="footer">-9</div><script>var a="<p>x</p>";</script></body></html>
<html><body><article><h1>+3</h1><ul><li><a>+2</a></li><li><a>+3</a></li></ul></article></body></html>
"""


def built(layout, seed=3):
    """A page of the layout and the text of its article."""
    rng, kept = random.Random(seed), []

    def words(match):
        made = html_text.words_for(int(match[2]), rng)
        if match[1] == "+":
            kept.append(made)
        return made

    page = re.sub(r"(?<=[> ])([+-])(\d+)(?=[< ])", words, layout)
    return page, " ".join(kept)


def marked_text(page):
    """Text of the only article of a page without other elements in it than paragraphs and headings."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?(?:p|h1)|br)>", " ", inside))).split())


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.fit(html_text.sample(spark.read.parquet(f"{SMALL}/pages.parquet")))


def test_query_on_the_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = Q.queries()["op12_html_extraction"](spark, SMALL)
    assert dict(found.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    rows = found.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == marked_text(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_pages_without_article_tags_give_the_same_texts(spark, weights):
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        bare = re.sub(r"<(/?)article>", r"<\1div>", r.html)
        assert html_text.main_text(bare, weights) == marked_text(r.html)


@pytest.mark.parametrize("layout", HELD_OUT.strip().splitlines())
def test_layouts_not_learnt_from(weights, layout):
    for seed in (3, 4, 5):
        page, wanted = built(layout, seed)
        assert html_text.main_text(page, weights) == wanted


def test_layouts_learnt_from(weights):
    right = total = 0
    for layout in html_text.LAYOUTS.strip().splitlines():
        page, wanted = built(layout.replace("<br>", " <br> "))
        a, b = set(html_text.main_text(page, weights).split()), set(wanted.split())
        right, total = right + 2 * len(a & b), total + len(a) + len(b)
    assert right / total > 0.97


def prose(n, seed=1):
    return html_text.words_for(n, random.Random(seed))


def test_references_white_space_and_blocks(weights):
    page = f"<p>a&amp;b &lt;p&gt;\n\t c&nbsp;d <b>bo</b>ld<br>e &notanentity; &#233;&#x4e2d; &am</p><p>{prose(20)}</p>\n<p> {prose(12, 2)}"
    wanted = f"a&b <p> c d bold e &notanentity; é中 &am {prose(20)} {prose(12, 2)}".replace("&notan", "¬an")
    assert html_text.main_text(page, weights) == wanted


def test_broken_markup(weights):
    a, b, c = prose(30, 1), prose(25, 2), prose(28, 3)
    for page in (
        f"<article><p>{a}<p><b>{b}<p>{c}",
        f"<article><p>{a}</i></div><p>{b}</b></p></p>{c}</article></body></html></html>",
        f"<ARTICLE class=x><P title='a > b'>{a}</P><!-- <p>no</p> --><p data-x=\"<p>\">{b}<p>{c}</ARTICLE><script>x('</p>')",
        f"<article><h1>{a}<p>{b}<style>p{{}}</style><p>{c}<!-- open {prose(50, 4)}",
        f"<article><p>{a}</p><p>{b}</p><svg/><p>{c}</p><p",
        f"<head><title>t</title><body><article>{a} <p>{b}<select><option>x<option>y</select><p>{c}</article>",
    ):
        assert html_text.main_text(page, weights) == f"{a} {b} {c}"


def test_lists_and_tables_with_omitted_end_tags(weights):
    page = f"<article><p>{prose(20)}<ul><li>one two<li>three four</ul><table><tr><td>5<td>6<tr><td>7</table><p>{prose(9, 2)}</article>"
    assert html_text.main_text(page, weights) == f"{prose(20)} one two three four 5 6 7 {prose(9, 2)}"


@pytest.mark.parametrize("page", [None, "", "   ", "<nav><a>menu</a></nav>", "<html><head><title>only</title></head></html>", "<!-- x", "<<<>>>", "<p"])
def test_pages_without_an_article(weights, page):
    assert html_text.main_text(page, weights) == "" or page == "<<<>>>"


def test_long_pages_take_time_in_proportion(weights):
    body = "".join(f"<p>{prose(40, k % 7)}</p>" for k in range(5_000))
    page = f"<nav><a>x</a></nav><article>{body}</article><footer>{prose(9)}</footer>"
    assert len(html_text.main_text(page, weights).split()) == 200_000
    assert html_text.main_text("<a" * 200_000, weights) == ""
    assert len(html_text.main_text("<div>" * 3_000 + prose(50), weights).split()) == 50


def test_rows_come_through_once_each(spark):
    page = f"<article><p>{prose(30)}</p></article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (None, "v", page), (None, None, None)]
    pages = spark.createDataFrame(rows, PAGES).select("*", *(F.lit(c).alias(c) for c in ("text", "n_chars", "source", "_x")))
    found = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    wanted = [(i, u, prose(30) if h else "", len(prose(30)) if h else 0) for i, u, h in rows]
    assert found == sorted(wanted, key=str)
    assert html_text.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_best_region_equals_all_regions_tried():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = [(float(c), float(w)) for c, w in zip(rng.integers(0, 4, 8), rng.integers(-6, 7, 8))]
        found = html_text.best_region(scores)

        def total(first, last):
            return sum(w for _, w in scores[first:last]) - sum(c for c, _ in scores[first + 1 : last])

        best = max((total(a, b) for a, b in itertools.combinations(range(9), 2)), default=0)
        assert total(*found) == max(best, 0) if found != (0, 0) else best <= 0


def test_sample_is_bounded(spark):
    page = "<article><p>text</p></article>"
    pages = spark.createDataFrame([(k, "u", page + str(k)) for k in range(40)] + [(99, "u", page + "x" * 500)], PAGES)
    assert len(html_text.sample(pages, rows=10)) == 10
    assert sorted(html_text.sample(pages.unionByName(pages).unionByName(pages))) == sorted({r.html for r in pages.collect()})
    assert all(len(s) < 100 for s in html_text.sample(pages, chars=100))
