"""Paragraphs with inline tags and line breaks, pages of several articles."""

from __future__ import annotations

from quire.operators import extract as X
from quire.operators import nodes as ND

PAGE = ("<html><body><article><h1>A <i>big</i> title</h1><p>Hello <i>big</i> world<br>second<p><b>Lead &amp; more.<br><p class=x>third <a href='/'>link</a> end</p></article>"
        "<div>between</div><article class=b><p>Fourth<br/></p><ul><li>x</li></ul><p>last</article></body></html>")
TEXTS = ["Hello big world\nsecond", "Lead & more.", "third link end", "Fourth", "last"]


def pages(spark):
    return spark.createDataFrame([(1, "http://a.b/1", "a.b", PAGE), (2, "http://a.b/2", "a.b", "<p>no article</p>")], "page_id long, url string, book_id string, html string")


def test_paragraphs_are_whole(spark):
    got = X.explode_paragraphs(pages(spark)).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.text) for r in got] == [(1, t) for t in TEXTS]
    f = X.page_features(pages(spark)).where("page_id = 1").first()
    assert "Fourth" in f.article_text and "between" not in f.article_text


def test_rule_bodies_are_whole(spark):
    f = {r.page_id: r for r in ND.rule_features(pages(spark)).collect()}
    assert (f[1].title, f[1].paragraphs) == ("A big title", TEXTS)
