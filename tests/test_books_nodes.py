"""Ordering (toc_pages, url_list), skew-safe numbering, nodes and rules
(small_html), conditional normalisation."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import books as B
from quire.operators import nodes as ND
from quire.operators.numbering import number_within


def test_number_within_matches_row_number_under_skew(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"b{rnd.randint(0, 30)}", i) for i in rnd.sample(range(100000), 3000)]
    df = spark.createDataFrame(rows, "book_id string, page_id long")
    got = {(r["book_id"], r["page_id"]): r["n"] for r in number_within(df, ["book_id"], ["page_id"], "n").collect()}
    w = Window.partitionBy("book_id").orderBy("page_id")
    want = {(r["book_id"], r["page_id"]): r["n"] for r in df.withColumn("n", F.row_number().over(w)).collect()}
    assert got == want


def test_pagewise_and_lexical_order(spark):
    # toc_pages: 3 contents pages; page 1 kept as listed, later pages sorted by key
    toc = [(1, 0, "Chapter 2", "/c2"), (1, 1, "Chapter 10", "/c10"), (2, 0, "Chapter 2", "/c2b"),
           (2, 1, "Chapter 10", "/c10b"), (3, 0, "B", "/b"), (3, 1, "A", "/a"), (3, 2, "A", "/a")]
    df = spark.createDataFrame([("bk",) + r for r in toc], "book_id string, toc_page int, pos int, link_text string, href string")
    key = F.when(F.col("toc_page") > 1, F.col("link_text"))
    n = number_within(df.withColumn("k", key), ["book_id"], ["toc_page", "k", "pos"], "link_no")
    order = [r["href"] for r in n.orderBy("link_no").collect()]
    assert order == ["/c2", "/c10", "/c10b", "/c2b", "/a", "/a", "/b"]   # code-point order: "Chapter 10" < "Chapter 2"
    files = spark.createDataFrame([("bk", f"chapter{i}.html") for i in (1, 2, 10)], "book_id string, file_name string")
    lex = [r["file_name"] for r in number_within(files, ["book_id"], ["file_name"], "n").orderBy("n").collect()]
    assert lex == ["chapter1.html", "chapter10.html", "chapter2.html"]


def test_first_occurrence(spark):
    df = spark.createDataFrame([(1, 0, "u"), (1, 1, "v"), (1, 2, "u"), (2, 0, "u")], "list_id int, pos int, value string")
    got = {(r["list_id"], r["pos"]): r["first_pos"] for r in B.first_occurrence(df, "list_id", "value").collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (2, 0): 0}


def test_conditional_normalize_on_cr(spark):
    frags = spark.createDataFrame([(1, 0, "a\rb"), (1, 1, "\n"), (1, 2, "c"), (2, 0, "x"), (2, 1, "y")],
                                  "cid int, pos int, text string")
    got = {r["cid"]: (r["normalized"], r["content"]) for r in B.conditional_normalize(frags, ["cid"]).collect()}
    assert got == {1: (True, "<p>a</p><p>b</p><p>c</p>"), 2: (False, "x</p><p>y")}


SMALL_HTML = [
    (1, "http://x.example/a", '<div id="list"><dl><dd><a href="/c1">One</a></dd><dd><a href="/c2">Two</a></dd></dl></div>'
                              '<div id="info"><h1>Book</h1><p>作者：某</p></div><p class="p1">alt</p>'),
    (2, "http://x.example/b", '<ul class="p2"><li><a href="/x">no</a></li></ul><ul class="p2"><li><a href="/y">yes</a></li></ul>'
                              '<div><img src="/cover.jpg"></div>'),
    (3, "http://x.example/c", "<article><p>unclosed<p>second</article>"),
    (4, "http://x.example/d", "<span>nothing here</span>"),
]


def test_nodes_and_rules(spark):
    pages = spark.createDataFrame(SMALL_HTML, "page_id long, url string, html string").withColumn("book_id", F.lit("x"))
    nodes = ND.html_nodes(pages)
    got = {}
    for r in ND.apply_rules(nodes, ND.rules_frame(spark)).collect():
        got[(r["page_id"], r["field"])] = (r["n_nodes"], r["first_text"])
    assert got[(1, "link")] == (2, "One")
    assert got[(1, "title")] == (1, "Book")
    assert got[(1, "author")] == (2, "作者：某")          # '#info p:nth-of-type(1), .p1'
    assert got[(2, "link")] == (1, "yes")               # 'ul.p2:nth-of-type(2) li a'
    assert got[(2, "cover")][0] == 1
    assert got[(3, "body")] == (2, "unclosed")          # unclosed <p> closed by the next <p>
    assert not any(k[0] == 4 for k in got)
    img = nodes.where("tag = 'img'").select(F.col("attrs")["src"].alias("src")).first()["src"]
    assert img == "/cover.jpg"


def test_link_by_text_next_and_last(spark):
    from quire.functions.urls import LAST_PAGE_TEXT, NEXT_PAGE_TEXT, page_number
    from quire.operators.extract import link_by_text
    links = spark.createDataFrame(
        [(1, 0, "上壹頁", "/book-7-1.html"), (1, 1, NEXT_PAGE_TEXT, "/book-7-3.html"),
         (1, 2, LAST_PAGE_TEXT, "/book-7-9.html"), (1, 3, NEXT_PAGE_TEXT, "/dup.html"), (2, 0, "x", "/y")],
        "page_id long, pos long, link_text string, href string")
    nxt = {r["page_id"]: r["href"] for r in link_by_text(links).collect()}
    assert nxt == {1: "/book-7-3.html"}
    last = link_by_text(links, LAST_PAGE_TEXT).select(page_number("href").alias("n")).first()["n"]
    assert last == "9"


def test_extraction_is_case_insensitive(spark):
    from quire.operators import extract as X
    html = ('<HTML LANG="fr"><HEAD><TITLE>T</TITLE><SCRIPT>var t="</P>";</SCRIPT></HEAD><BODY><NAV><A HREF="/x">X</A></NAV>'
            '<ARTICLE><H1>Titre &amp Co</H1><P><B>Un<BR><P>Deux</P></ARTICLE></BODY></HTML>')
    pages = spark.createDataFrame([(1, "http://h.example/1", html)], "page_id long, url string, html string") \
        .withColumn("book_id", F.lit("h.example"))
    paras = [r["text"] for r in X.explode_paragraphs(pages).orderBy("pos").collect()]
    assert paras == ["Un", "Deux"]
    links = X.nav_links(pages).collect()
    assert [(r["href"], r["link_text"]) for r in links] == [("/x", "X")]
    meta = X.page_metadata(pages).first()
    assert (meta["title"], meta["html_lang"]) == ("Titre & Co", "fr")


def test_rule_features_on_site_pages(spark):
    from quire.functions.urls import host
    from quire.operators.nodes import rule_features
    rows = [
        (1, "https://www.shubaowb.com/1/2.html",
         '<div class="title1">书名</div><div id="content"><p>第一段</p><p>第二段</p></div>'),
        (2, "https://www.zhenhunxiaoshuo.com/x.html",
         '<h1 class="focusbox-title">Tale</h1><div class="content-wrap"><div class="content">'
         '<article class="article-content"><p>A</p><p>B</p></article></div></div>'),
        (3, "https://www.sto.cx/book-1-2.html", '<h1>Page title</h1><div id="BookContent">　　甲　　乙</div>'),
        (4, "https://unknown.example/p", "<p>no rule matches</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("book_id", host("url"))
    got = {r["page_id"]: (r["title"], list(r["paragraphs"])) for r in rule_features(pages).collect()}
    assert got[1] == ("书名", ["第一段", "第二段"])
    assert got[2] == ("Tale", ["A", "B"])
    assert got[3] == ("Page title", ["　　甲　　乙"])
    assert got[4] == (None, [])


def test_conditional_normalize_array_equals_row_form(spark):
    frags = [(1, ["a\rb", "\n", "c", " "]), (2, ["x", "y"]), (3, []), (4, ["\r", "z\r"])]
    arr = spark.createDataFrame(frags, "cid int, ps array<string>")
    flag, content = B.conditional_normalize_array("ps")
    got = {r["cid"]: (r["f"], r["c"]) for r in arr.select("cid", flag.alias("f"), content.alias("c")).collect()}
    rows = spark.createDataFrame([(c, i, t) for c, ps in frags for i, t in enumerate(ps)], "cid int, pos int, text string")
    from quire.operators.extract import drop_blank
    want = {r["cid"]: (r["normalized"], r["content"]) for r in B.conditional_normalize(drop_blank(rows), ["cid"]).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert got[3] == (False, "")
