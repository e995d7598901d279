"""Operator 5: articles split over siblings, hosts with two templates, template text in prose elements."""

from __future__ import annotations

from quire.llm import templates

MENU = "<ul class=menu><li>Home<li>News</ul><form>Search</form>"


def texts(spark, pages, host="a.b"):
    rows = [(k, f"http://{host}/{k}", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in templates.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[k] for k in range(len(pages))]


def test_article_in_siblings(spark):
    pages = [f"<body>{MENU}<div class=lead><p>Lead {k}</p></div><div class=rest><p>Rest {k} is longer</p></div><p>Foot</p>" for k in range(6)]
    assert texts(spark, pages) == [f"Lead {k} Rest {k} is longer" for k in range(6)]
    pages = [f"<body>{MENU}<div class=entry-title><h1>Title {k}</h1></div><div class=entry-content><p>Body {k} and on</p></div>" for k in range(6)]
    assert texts(spark, pages) == [f"Title {k} Body {k} and on" for k in range(6)]
    # a page judged alone
    assert texts(spark, pages[:1]) == ["Title 0 Body 0 and on"]
    two = [f"<body>{MENU}<article><p>One {k}</p></article><div>between {k}</div><article class=x><p>Two {k}</p></article>" for k in range(6)]
    assert texts(spark, two) == [f"One {k} Two {k}" for k in range(6)]


def test_two_templates(spark):
    a = [f"<body>{MENU}<div class=content><p>Of A {k} at some length</p></div><div class=box><p>Box {k}</p></div>" for k in range(7)]
    b = [f"<body>{MENU}<div class=story><p>Of B {k} at some length</p></div><div class=box><p>Box {k}</p></div>" for k in range(3)]
    assert texts(spark, a + b) == [*[f"Of A {k} at some length Box {k}" for k in range(7)], *[f"Of B {k} at some length Box {k}" for k in range(3)]]


def test_template_text_in_prose_elements(spark):
    notice = "This site asks its readers to subscribe to the weekly letter. " * 5
    for n in (2, 3, 8):
        pages = [f"<body>{MENU}<article><h1>Title {k}</h1><p>{notice}</p><h3>Subscribe now</h3><p>The <i>text</i> of {k}<br>and more</p>"
                 f"<ul><li>Share it</li></ul><blockquote>Said {k}</blockquote></article>" for k in range(n)]
        assert texts(spark, pages) == [f"Title {k} The text of {k} and more Said {k}" for k in range(n)]


def test_copies_are_no_template(spark):
    page = f"<body>{MENU}<article><h1>Title</h1><p>One</p><p>Two</p></article>"
    assert texts(spark, [page, page]) == ["Title One Two"] * 2
    other = f"<body>{MENU}<article><h1>Other</h1><p>Three</p></article>"
    assert texts(spark, [page, page, page, other]) == [*["Title One Two"] * 3, "Other Three"]
