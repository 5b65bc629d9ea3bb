"""Main text of pages: planted parts, broken pages, awkward rows, and all given pages against their making."""

from __future__ import annotations

import re
import time
from html import unescape

import pytest

from themeweave.llm.html_extraction import extract_text, main_text

SMALL = "/root/testdata/sf0.001"
PROSE = "A long paragraph of prose, with commas, that goes on for a while, as the paragraphs of articles do, and then ends."


def page(body):
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{body}<footer>foot</footer></body></html>"


def test_article_without_its_surroundings():
    body = (
        f"<div class=ad>buy</div><article><h1>Head&amp;line</h1><p>{PROSE}</p><p>two  <b>bold</b>\n words<br>next</p>"
        f"<div class='comments'><p>{PROSE}</p></div><script>var t='</p>';</script><style>p{{}}</style>"
        f"<form><p>{PROSE}</p></form><ul><li>one</li><li>two</li></ul></article>"
    )
    assert main_text(page(body)) == f"Head&line\n{PROSE}\ntwo bold words next\none\ntwo"


def test_names_inside_an_article():
    body = (
        f"<article><p>{PROSE}</p><p class='social-history'>{PROSE} 2</p><section id='related-work'><h2>Related work</h2>"
        f"<p>{PROSE} 3</p></section><div class='related-posts'><p>{PROSE} 4</p></div><div class='share-this-now'>Share</div></article>"
    )
    assert main_text(page(body)) == f"{PROSE}\n{PROSE} 2\nRelated work\n{PROSE} 3"


def test_menu_inside_the_container():
    body = f"<main><div><a href=a>First</a> <a href=b>Second</a></div><p>{PROSE}</p><p>See <a href=c>this</a>.</p></main>"
    assert main_text(page(body)) == f"{PROSE}\nSee this."


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 700_000, '<p a="' * 300_000, '<p ">"' * 300_000, "<!" * 900_000, "<script " * 250_000, "<a" * 900_000, "<" * 2_000_000,
        "<div>" * 150_000 + "<td>x" * 150_000, "<div>" * 150_000 + "</p>" * 200_000, "<nav>" * 200_000 + "</p>" * 200_000,
        "<a " * 300_000 + ">" + "<p '>" * 200_000,
    ],
    ids=range(11),
)
def test_broken_pages_take_linear_time(html):
    begin = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - begin < 20


def test_deep_pages_keep_all_text():
    words = [f"w{k}" for k in range(2000)]
    assert main_text("<article>" + "<div>".join(words)).split() == words


def test_awkward_rows(spark):
    rows = [(1, None, "old"), (2, "", "old"), (3, "<p></p>", "old"), (4, f"<p>{PROSE}", "old"), (4, f"<p>{PROSE}", "old")]
    rows += [(None, "<<>&<p", "old"), (6, "<p>" + "word, " * 100_000, "old")]
    pages = spark.createDataFrame(rows, "page_id long, html string, TEXT string")
    out = extract_text(pages)
    assert out.columns == ["page_id", "html", "text"]
    got = {(r.page_id, r.text) for r in out.collect()}
    assert {(1, ""), (2, ""), (3, ""), (4, PROSE)} <= got and len(next(t for i, t in got if i == 6).split()) == 100_000
    assert out.count() == len(rows) and extract_text(pages.limit(0)).count() == 0


def test_given_pages_by_their_making(spark):
    """The pages are made of one article of headings and paragraphs; cut it out and compare."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for row in extract_text(pages).collect():
        article = re.search("<article>(.*)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div|ul|li)>", re.sub("<br>", " ", article))
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert row.text == "\n".join(line for line in lines if line)
