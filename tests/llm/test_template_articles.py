"""Operator 5: article text that looks like furniture or repeats, and articles that only the template tells."""

from __future__ import annotations

import re

from quire.llm import templates

from .test_operators import SF, article
from .test_template_slots import MENU, texts


def test_near_copies_keep_their_text(spark):
    shared = "".join(f"<p>Shared paragraph {k} of some length</p>" for k in range(6))
    pages = [f"<body>{MENU}<article><h1>Title {k}</h1>{shared}<p>Only here {k}</p></article>" for k in range(2)]
    words = " ".join(f"Shared paragraph {k} of some length" for k in range(6))
    assert texts(spark, pages) == [f"Title {k} {words} Only here {k}" for k in range(2)]


def test_subheads_of_varying_text_stay(spark):
    pages = [f"<body>{MENU}<article><h1>Title {k}</h1><h2>Introduction</h2><p>In {k}</p><h2>Method</h2><h3>Data</h3><p>By {k}</p>"
             f"<h2>References</h2><ul><li>Ref {k}</li></ul><h3>More of us</h3><p>Follow this site</p></article>" for k in range(4)]
    assert texts(spark, pages) == [f"Title {k} Introduction In {k} Method Data By {k} References Ref {k}" for k in range(4)]


def test_names_inside_articles(spark):
    kept = ('<div class="related-work"><p>Work {k}</p></div><section id="discussion-comments"><p>Discussed {k}</p></section><p class="alert">Alert {k}</p>'
            '<figure class="share-chart"><figcaption>Chart {k}</figcaption></figure>')
    gone = ('<div class="ad">Buy {k}</div><div class="comment-list"><p>I disagree {k}</p></div><section id="comments"><p>Me too {k}</p></section>'
            '<div class="newsletter-box">Letter {k}</div><aside>Aside {k}</aside><div class="share-buttons">Share {k}</div>')
    pages = [f"<body>{MENU}<article><h1>Title {k}</h1>{kept.format(k=k)}{gone.format(k=k)}</article>" for k in range(5)]
    assert texts(spark, pages) == [f"Title {k} Work {k} Discussed {k} Alert {k} Chart {k}" for k in range(5)]


def plain(k):
    """Neither article elements nor telling tags or names; the template alone tells."""
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "About", "Help"))
    return f"<body><div>{menu}</div><div><p>Story {k} begins</p><p>and goes on with {k}</p></div><div>All rights kept by us</div>"


def test_the_template_decides(spark):
    assert texts(spark, [plain(k) for k in range(6)]) == [f"Story {k} begins and goes on with {k}" for k in range(6)]
    # without it everything is text
    assert templates.extract(plain(1), [], frozenset()) == "Home News About Help Story 1 begins and goes on with 1 All rights kept by us"


def test_articles_without_their_names(spark):
    """The given pages with articles, menus, adverts and footers renamed to bare divs: what no page shares is found."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    bare = [(r.page_id, r.url, re.sub(r"<(/?)(?:article|nav|footer|aside)\b[^>]*>", r"<\1div>", re.sub(r'(<div) class="[^"]*"', r"\1", r.html or ""))) for r in pages]
    got = {r.page_id: r.text for r in templates.extract_pages(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert all(article(r.html) in got[r.page_id] for r in pages)
