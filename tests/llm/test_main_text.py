"""Main texts: layouts that the labelled pages do not have, the given pages' articles, odd pages, linear reading."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from sievegrid.llm import main_text as M
from sievegrid.llm.queries import QUERIES

W = "It was a long way to the top of the hill and nobody had thought of bringing water for the dogs"

UNSEEN = [
    (f'<div class="topnav"><a href=/>Home</a></div><div id="page"><div id="primary"><div class="article__body"><h1>Hill</h1><p>{W}.</p><p>{W}</p></div><div class="commentlist"><p>{W}</p></div></div><div id="secondary"><p>{W}</p></div></div><div id="colophon">{W}</div>', ["Hill", W + ".", W]),
    (f'<main><h1>Hill</h1><p>{W}</p><div class="adsbygoogle">{W}</div><p>{W}</p></main><aside>{W}</aside><footer><p>{W}</p></footer>', ["Hill", W, W]),
    (f'<header><h1>Site</h1></header><article><h2>Hill</h2><p>{W}</p><section class="comments"><p>{W}</p></section></article><div class="sidebar"><p>{W}</p></div>', ["Hill", W]),
    (f'<div class="cookie">{W}</div><div class="notice">{W}</div><article><h1>T</h1><p>{W}</p><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><td>b</td></tr></table><pre>x  y</pre></article><form><p>{W}</p></form>', ["T", W, "one", "two", "a", "b", "x y"]),
    (f'<div class="menu"><ul><li><a>a</a></li></ul></div><div class="article"><h1>T</h1><p>{W}</p><div class="advert"><p>{W}</p></div><p>{W}</p></div><div id="comments"><p>{W}</p></div><div class="footer">{W}</div>', ["T", W, W]),
    (f'<article><h1>T</h1><p>{W}</p><form><p>{W}</p></form><div class="reader-comments"><p>{W}</p></div><div class="user-comment"><p>{W}</p></div></article>', ["T", W]),
    (f'<nav>{W}</nav><aside>{W}</aside><p>{W}</p><p>{W}</p><div role="complementary">{W}</div><footer>{W}</footer>', [W, W]),
    (f'<html><body><div><div><div><p>{W}</p><p>{W}</p></div></div><div class="banner-ad">{W}</div></div></body></html>', [W, W]),
    (f'<noscript>{W}</noscript><article><p>{W} <a href=x>link</a> &eacute;&nbsp;z<br>next</p><p><a href=y>all link</a></p></article>', [W + " link é z next", "all link"]),
    (f'<header class="page-header"><div>{W}</div></header><div class="main"><h1>T</h1><div>{W}</div><div>{W}</div></div><div class="sidebar">{W}</div><div class="site-footer">{W}</div>', ["T", W, W]),
    (f'<script>if (a < b) "<p>{W}</p>"</script><style>p{{}}</style><article><h1>T</h1><!-- <p>{W}</p> --><p hidden>{W}</p><p style="display: none">{W}</p><p title="a > b">{W}<p>{W}</article>', ["T", W, W]),
    (f'<form action=/><div class="header">{W}</div><div class="content"><p>{W}</p><p>{W}</p><p>{W}</p></div></form>', [W, W, W]),
]


@pytest.mark.parametrize("i", range(len(UNSEEN)))
def test_unseen_layouts(i):
    page, want = UNSEEN[i]
    assert M.main_blocks(f"<html><body>{page}</body></html>", M.own_weights()) == want


def test_given_pages(spark):
    """Their articles are known: they are the only such element of each."""
    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = QUERIES["op13_main_text"](spark, path).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "<nav><a>Home</a></nav><footer>us</footer>"), (5, "just words here &lt;b&gt; &#8364; &amp"), (6, "<p>un<b>closed"), (7, f"<article><p>{W}</p>"), (7, f"<article><p>{W}</p>"), (8, "<article><p>" + (W + " ") * 100_000 + "</p></article>"), (9, "a < b <3 </ > <> <!x> c"), (None, "<p>null id</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").select("*", F.lit(5).alias("text"), F.lit(6).alias("a.b"), F.lit(7).alias("page_row"))
    out = M.main_texts(df)
    assert out.columns == ["page_id", "html", "a.b", "page_row", "text"]
    got = sorted(((r.page_id or 0, r.text) for r in out.collect()), key=lambda x: x[0])
    assert [t for _, t in got] == ["null id", "", "", "", "", "just words here <b> € &", "unclosed", W, W, " ".join([W] * 100_000), "a < b <3 <> c"]
    assert M.main_texts(df.where("false")).count() == 0


def test_blocks_and_nesting():
    text = lambda page: [b.text for b in M.sequence(page) if isinstance(b, M.Block)]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    around = [sorted(b.around) for b in M.sequence('<p class=x>a<div id="yTop">b</p>c</div>d') if isinstance(b, M.Block)]
    assert around == [[".x", "p"], [".top", ".y"], [".top", ".y"], []]
    assert text("x<textarea><p>no</textarea>y<title>no</title>z") == ["xyz"]


@pytest.mark.parametrize("best, scores", [((1, 4), [-1, 2, -1, 3, -5, 3]), ((0, 0), [-1, -2]), ((0, 0), []), ((2, 3), [1, -1, 1.5])])
def test_best_region(best, scores):
    assert M.best_region(scores) == best


def test_any_labelled_pages_can_be_learned():
    """Names that only these pages have decide."""
    pages = [f"<div class=zork><!--keep--><p>{W}</p><!--skip--></div><div class=quux><p>{W}</p></div>"] * 5
    page = f"<div class=quux><p>no {W}</p></div><div class=zork><p>yes {W}</p></div><div class=quux><p>no {W}</p></div>"
    assert M.main_blocks(page, M.fit(pages)) == [f"yes {W}"]


@pytest.mark.parametrize("piece", ['<a "', "<b>", "<div><p>", "<", "<!--", "&amp", "<p><b>", "<script>", "<a href='", "</x", "<li>", "<tr><td>"])
def test_reading_is_linear(piece):
    began = time.time()
    M.main_blocks(piece * 40_000, M.own_weights())
    assert time.time() - began < 5
