"""Elements by depth, attributes, character references, chapters as XML."""

from __future__ import annotations

import html
import random
import xml.etree.ElementTree as ET
from html.entities import html5

from pyspark.sql import functions as F

from quire.functions import html as H
from quire.operators import extract as X
from quire.operators import translate as TR
from quire.plans.build import build_books, build_next_page_book

from .conftest import SF001

PAGE = "page_id long, url string, book_id string, html string"


def pages(spark, *bodies):
    return spark.createDataFrame([(k, f"http://a.b/{k}", "a.b", x) for k, x in enumerate(bodies)], PAGE)


def paragraphs(spark, body):
    return [r.text for r in X.explode_paragraphs(pages(spark, body)).orderBy("pos").collect()]


def test_articles_end_where_they_should(spark):
    nested = "<article><p>one</p><article class='x>y'><p>two <b>in</b></p></article><p>three</article><p>out</p><article><p>four</article></article><p>out"
    assert paragraphs(spark, nested) == ["one", "two in", "three", "four"]
    assert paragraphs(spark, "<p>out<ARTICLE ID=a><p>one<p>two<div>no</div><p>three &amp; cut o") == ["one", "two", "three & cut o"]
    # a closing tag without an open one counts for nothing; a name that only begins alike is another element
    assert paragraphs(spark, "</article><article-x><p>no</p></article-x><article><p>yes</p></article>") == ["yes"]
    assert paragraphs(spark, "<script>'<article>'</script><p>no</p>") == [] and paragraphs(spark, "") == []
    # a nested article ends an open paragraph
    assert paragraphs(spark, "<article><p>a<article>b<p>c</article>d<p title='</p>'>e") == ["a", "c", "e"]
    deep = "<article>" * 300 + "<p>in" + "</article>" * 300 + "<p>out"
    assert paragraphs(spark, deep) == ["in"]


def test_contents_links_of_every_nav(spark):
    body = "<nav><a href=/1>One</a><a href='/2'>Two</nav><a href=/x>no</a><nav><ul><li><nav><a href=\"/3\">Three</a></nav><a href=/4>Four</ul>"
    got = X.nav_links(pages(spark, body)).orderBy("pos").collect()
    assert [(r.href, r.link_text) for r in got] == [("/1", "One"), ("/2", "Two"), ("/3", "Three"), ("/4", "Four")]


def test_attributes(spark):
    rows = [("<a href='/x'>a</a>", "/x"), ("<a class=\"c\" href = '/w?a=1&amp;b=2'>a</a>", "/w?a=1&b=2"), ("<a HREF=/y>a</a>", "/y"), ("<a data-href=\"/z\" href=\"/w\">a</a>", "/w"),
            ("<a href>a</a>", ""), ("<a name=n>a</a>", None), ("<a title='href=\"/no\"' href=/w?a=1&b=2>a</a>", "/w?a=1&b=2"), ("<a href=/1 href=/2>a</a>", "/1"),
            ("<a title=\"x > y\" href=/q/ >a</a>", "/q/"), ("<a\nhref=\"\n/n\">a</a>", "\n/n"), ("<a>a</a>", None)]
    got = {r.page_id: r.href for r in X.explode_links(pages(spark, *[x for x, _ in rows])).collect()}
    assert got == {k: want for k, (_, want) in enumerate(rows)}
    assert {r.page_id for r in X.anchors_with_href(X.explode_links(pages(spark, *[x for x, _ in rows]))).collect()} == {k for k, (_, w) in enumerate(rows) if w is not None}
    m = pages(spark, "<img alt='a\"b' src=/c.jpg><img src=/d.jpg>", "<p>none").select("page_id", H.image_source("html").alias("s"))
    assert {r.page_id: r.s for r in m.collect()} == {0: "/c.jpg", 1: None}
    assert {r.page_id: r.cover_url for r in X.page_metadata(pages(spark, "<img src=c/d.jpg>", "<img src='https://e.f/g'>")).collect()} == {0: "http://a.bc/d.jpg", 1: "https://e.f/g"}


def test_references_are_the_standard_library(spark):
    texts = [f"&{n}" for n in html5] + [f"a&{n.rstrip(';')}x b" for n in html5] + [f"&#{k};" for k in (*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x10000, 0x1FFFF, 0x10FFFF, 0x110000, 10**20)]
    texts += [f"&#x{k:X}" for k in (0, 65, 0x80, 0x1F469, 0x10FFFF, 2**70)] + ["&#00000000065;", "&#;", "&#x;", "&", "&&amp;&", "&notit; &notin; &ampamp; &#65x &am", "", "no"]
    r = random.Random(4)
    texts += ["".join(r.choices(["&", "amp", "lt", ";", "#", "x", "4", "not", "in", " ", "é", "\n"], k=r.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {x.k: x.o for x in df.select("k", H.decode_entities("t").alias("o")).collect()}
    assert all(got[k] == html.unescape(t) for k, t in enumerate(texts))


ROUGH = ("<html lang=fr><h1>A &lt;b&gt; & \"c\"</h1><article><p>x &amp; y < z</p><p>" + "un mot&nbsp;" * 120 + "</p><p> </p><p>a\x02b&#1;]]&gt;</p><article><p>in</p></article><p>end"
         "</article><p>out</html>")


def test_chapters_are_xml_paragraph_by_paragraph(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    given = spark.read.parquet(f"{SF001}/pages.parquet").withColumn("book_id", F.regexp_extract("url", "//([^/?#]*)", 1))
    got = build_books(given, docs).collect()
    assert len(got) == 250
    for r in got:
        ET.fromstring(f"<x>{r.chapter_html}</x>")
    # what is not translated comes back as it was: English pages, paragraph for paragraph
    plain = {r.page_id: [t for t in r.paragraphs if t.strip()] for r in X.decoded_paragraphs(X.page_features(given)).collect()}
    checked = 0
    for r in got:
        if r.src_lang == "en":
            said = ["".join(p.itertext()) for p in ET.fromstring(f"<x>{r.chapter_html}</x>").iter("p")]
            # chunks of 500 characters are joined by a space
            assert said == [" ".join(t[k : k + 500] for k in range(0, len(t), 500)) for t in plain[r.page_id]]
            checked += 1
    assert checked > 50


def test_rough_chapters(spark):
    docs = spark.createDataFrame([("un mot et la fin de la page", "fr"), ("a word and the end of the page", "en")], "text string, lang string")
    r = build_books(pages(spark, ROUGH), docs, translator=lambda texts, lang: texts.str.upper()).first()
    x = ET.fromstring(f"<x>{r.chapter_html}</x>")
    said = [p.text for p in x.iter("p")]
    assert x.find("h1").text == 'A <B> & "C"' and said[0] == "X & Y < Z" and said[2:] == ["AB]]>", "IN", "END"] and len(said) == 5
    chain = spark.createDataFrame([("a.b", 1, "http://a.b/0")], "book_id string, page_no long, url string")
    page = build_next_page_book(chain, pages(spark, "<article>x &amp; y　　</p>　　z &lt; w</article>"), translator=lambda t, lang: t).first()
    assert [p.text for p in ET.fromstring(f"<x>{page.page_html}</x>").iter("p")] == ["x & y", "z < w"]


def test_paragraphs_in_two_level_order(spark):
    texts = spark.createDataFrame([(1, 2, "fr", "b" * 1200), (1, 10, "fr", "c"), (1, 1, "fr", ""), (2, 0, None, "d"), (1, 3, "fr", None)], "page_id long, para_no int, src_lang string, text string")
    tr, fresh = TR.translate_texts(texts, ["page_id"], translator=lambda t, lang: t.str.upper(), para_col="para_no")
    got = {r.page_id: [tuple(p) for p in r.paragraphs] for r in tr.collect()}
    assert got == {1: [(2, " ".join(["B" * 500, "B" * 500, "B" * 200])), (10, "C")], 2: [(0, "D")]}
    assert fresh.count() == 4
