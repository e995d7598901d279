"""Pages are read and parsed once, however often their parts are needed."""

from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions.text import not_blank
from quire.operators import books as B
from quire.operators import nodes as ND
from quire.plans.build import build_books, build_next_page_book

PAGES = [(k, f"http://h.x/{k}", "h.x", f"<html lang=\"fr\"><article><h1>T{k}</h1><p>le &amp; la {k}</p><p> </p><p>b<b>c</b><br>d</p></article></html>") for k in range(6)]
DOCS = [(1, "the cat and the dog", "en"), (2, "le chat et la souris de la maison", "fr")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, book_id string, html string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_parse_pages_once(spark):
    out = ND.apply_rules(ND.html_nodes(pages(spark)), ND.rules_frame(spark))
    assert "HtmlNodes" not in plan(out)
    got = {(r.page_id, r.field): (r.n_nodes, r.first_text, r.text) for r in out.collect()}
    assert got[3, "body"] == (3, "le & la 3", "le & la 3") and got[3, "title"] == (1, "T3", "T3") and len(got) == 12


def test_books_read_pages_once(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    out = build_books(pages(spark), docs)
    assert "&(?:#" not in plan(out)
    row = out.where("page_id = 2").first()
    assert row.chapter_html.count("<p>") == 2 and "the &amp; the 2" in row.chapter_html and "bc\nd" in row.chapter_html
    chain = pages(spark).select("book_id", (F.col("page_id") + 1).alias("page_no"), "url")
    joined = build_next_page_book(chain, pages(spark))
    assert "&(?:#" not in plan(joined) and joined.count() == 6


def test_pieces_of_paragraphs(spark):
    rows = [(1, ["a\rb \nc", " 　", "None"]), (2, ["x &lt;y", "\n", "z"]), (3, []), (4, None), (5, ["\r", "q\r\rNone\r\n"])]
    got = {r.k: r.pieces for r in B.paragraph_pieces(spark.createDataFrame(rows, "k int, paragraphs array<string>")).collect()}
    assert got == {1: ["a", "b c"], 2: ["x <y", "z"], 3: [], 4: None, 5: ["q"]}


def test_paragraph_ends_and_blanks(spark):
    html = "<article><p>a < b <i>c</i><P class='x>y'>d<!-- <p>e --></p>out<p>f<div>g</div><p>h</article>"
    got = spark.range(1).select(H.paragraphs(F.lit(html)).alias("p")).first().p
    assert got[0] == "a < b c" or got[0].startswith("a ")
    assert got[1].startswith("d") and "f" in got and got[-1] == "h"
    many = "<article><p>" + "<i>x</i>" * 20000 + "</p></article>"
    assert spark.range(1).select(H.paragraphs(F.lit(many)).alias("p")).first().p == ["x" * 20000]
    words = [("", False), (" \t　 \x85", False), ("\n a", True), (None, None)]
    assert [(r.t, r.b) for r in spark.createDataFrame(words, "t string, b boolean").select("t", not_blank("t").alias("b")).collect()] == words
