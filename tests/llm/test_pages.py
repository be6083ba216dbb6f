"""HTML extraction: held-out layouts, pages written by hand, the decoding against all labellings, and hard input."""

import html
import itertools
import math
import re
import time

import numpy as np
import pytest

from matchloom.llm import dom, layouts, pages
from matchloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLOG = """<!doctype html><html><head><title>My blog</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="single post-template">
<div id="cookie-consent" class="banner"><p>We use cookies to improve your visit. By going on you agree to our policy.</p><button>Accept</button></div>
<header class="site-header"><a href="/">My blog</a><p class="tagline">Notes on slow cooking</p><nav class="main-nav"><ul><li><a href="/">Home</a><li><a href="/about">About</a></ul></nav></header>
<div class="wrapper"><main class="content"><article class="post"><h1>Beans &amp; patience</h1>
<p>Dried beans want time more than anything else.  Put them in water at night,
and cook them slowly the next day.</p><div class="ad-slot">Buy the new pressure cooker now, only this week.</div>
<p>Salt them early.<br>Old beans stay hard &mdash; <a href="/old">throw them away</a>.</p><p>Enjoy.</p></article>
<section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I have cooked beans for twenty years, and I never put them in water. They turn out fine every time.</p></div>
<div class="comment"><b>Bo</b><p>Thanks, this helped me a lot.</p></div><form class="comment-form"><label>Your comment</label><textarea>type here</textarea><button>Send</button></form></section></main>
<aside class="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">Bread without kneading</a><li><a href="/2">Five soups for the winter</a></ul></aside></div>
<footer class="site-footer"><p>&copy; 2024 My blog. All rights reserved.</p></footer></body></html>"""
BLOG_TEXT = "Beans & patience Dried beans want time more than anything else. Put them in water at night, and cook them slowly the next day. Salt them early. Old beans stay hard — throw them away. Enjoy."
PLAIN = """<html><body><table><tr><td><a href=a>Home</a> <a href=b>News</a> <a href=c>Links</a> <a href=d>Contact</a></td></tr><tr><td>
<p>The council met on Tuesday evening and decided, after a long debate, to keep the old bridge open for another year, while the engineers look at its foundations again.
<p>Nobody spoke against it, but several members asked who would pay for the repairs, and they got no clear answer from the chair of the committee that night.</td></tr></table></body></html>"""


@pytest.fixture(scope="module")
def model():
    return pages.learn()


def test_held_out_layouts_and_pages_by_hand(model):
    same, made = 0, list(layouts.sample(200, 4321))
    for source in made:
        want = " ".join(t.replace(layouts.MAIN, "") for t in dom.read(source).text if t and layouts.MAIN in t)
        same += pages.main_texts([source.replace(layouts.MAIN, "")], model) == [want]
    assert same > 160
    assert pages.main_texts([BLOG, "", "<p>", PLAIN], model) == [BLOG_TEXT, "", "", " ".join(re.sub("<[^>]*>", " ", PLAIN.partition("<p>")[2]).split())]


def test_query_keeps_the_article_of_every_page(spark):
    sources = dict(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect())
    rows = QUERIES["op11_pages"](spark, SF).collect()
    assert len(rows) == len(sources)
    for r in rows:
        body = re.search("(?s)<article>(.*)</article>", sources[r.page_id])[1]
        assert r.text == " ".join(html.unescape(re.sub("</?b>", "", re.sub("<(?!/?b>)[^>]*>", " ", body))).split()) and r.n_chars == len(r.text)


def test_rows_that_need_care(spark, model):
    long_ = "<article><p>" + "Some words, and more of them. " * 200_000 + "</p></article>"
    rows = [(1, BLOG, "u", "t"), (1, BLOG, "u", "t"), (None, PLAIN, None, "t"), (2, None, "u", None), (3, "", "u", "t"), (4, "<p", "u", "t"), (5, long_, "u", "t"), (6, "no markup at all", "u", "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, c0 string, text string")
    got = pages.extract(df, "page_id", "html", model, keep=["c0"])
    assert got.columns == ["page_id", "c0", "text"]
    out = got.collect()
    assert len(out) == len(rows) and [r.text for r in out if r.page_id == 1] == [BLOG_TEXT] * 2
    assert [r.text for r in out if r.page_id in (2, 3, 4)] == ["", "", ""]
    assert pages.extract(df.limit(0), "page_id", "html", model).count() == 0


def test_decoding_is_the_best_of_all_labellings():
    draw = np.random.default_rng(5)
    for _ in range(60):
        page = dom.Page()
        for _ in range(int(draw.integers(1, 4))):
            page.add(int(draw.integers(0, len(page.tag))), "div")
        for up in range(len(page.tag)):
            for _ in range(int(draw.integers(1, 3))):
                page.add(up, "#text", (), "some text")
        n = len(page.tag)
        pure, main = draw.random(n), draw.random(n)
        on, _ = pages.judged(page)
        q = np.where([t is not None for t in page.text], 1.0, pure)
        best, found = -math.inf, None
        for labels in itertools.product((1, -1, 0), repeat=n):
            value = 0.0
            for i, x in enumerate(labels):
                up = page.parent[i]
                while up > 0 and not on[up]:  # says the same as its only child
                    up = page.parent[up]
                above = labels[up] if i and on[up] else 0
                if above:
                    value += 0.0 if x == above else -math.inf
                elif on[i]:
                    value += math.log(max(1e-300, {1: q[i] * main[i], -1: q[i] * (1 - main[i]), 0: 1 - q[i]}[x]))
                else:
                    kids = [j for j in range(n) if page.parent[j] == i]
                    value += 0.0 if x == labels[kids[0]] else -math.inf
            if value > best:
                best, found = value, [i for i in range(n) if page.text[i] is not None and labels[i] == 1]
        assert pages.decode(page, pure.copy(), main.copy()) == found


def test_reader():
    page = dom.read('<ul><li>a<li><p title=it\'s>b<p>c &eacute;<b>d</b> e<!-- x -->f 1 < 2<div hidden>no</div><select><option>1</select>g</ul><a href="x>y">h</a><script>"<p>"</SCRIPT >i<span style="display: none">no</span>j<button>open')
    assert [t for t in page.text if t] == ["a", "b", "c éd ef 1 < 2", "g", "hij", "open"]
    assert [x for x, t in zip(page.linked, page.text) if t] == [0, 0, 0, 0, 1, 0]
    assert dom.tokens_of({"class": "mainNav post-12 SideBAR", "id": "x"}) == ("main", "nav", "post", "side", "bar", "x")
    for hard in ("<div>", '<a "', "<li><div>", "<", "<!--", "</p>", "<table><tr><td>", "<button>", '<a href="', "<script>", "<span hidden>", "&"):
        began = time.time()
        dom.read(hard * 40_000)
        assert time.time() - began < 10
