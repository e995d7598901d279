"""Scalar text functions on literal fixtures (FIXTURES.md: messy_text,
messy_lists, labels_text, titles, page_hrefs) and properties."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import urls as U
from quire.operators.translate import chunk_texts


def _py_normalize(t, tags=False):
    if t is None:
        return None
    s = re.sub(r"[\r\n\xa0]+", " ", t).strip()
    if s == "None" or s.replace(" ", "") == "":
        s = ""
    return f"<p>{s}</p>" if tags and s else s


MESSY = [(1, "a\r\nb"), (2, "a b"), (3, "　　x　"), (4, "None"), (5, "   "),
         (6, ""), (7, None), (8, "a\rb\r"), (9, " None "), (10, "　None　")]


def test_normalize_text_fixture(spark):
    df = spark.createDataFrame(MESSY, "id int, text string")
    rows = df.select("id", "text", T.normalize_text("text").alias("n"),
                     T.normalize_text("text", True).alias("p")).collect()
    for r in rows:
        assert r["n"] == _py_normalize(r["text"]), r
        assert r["p"] == _py_normalize(r["text"], True), r


def test_normalize_list_form(spark):
    df = spark.createDataFrame([(1, ["a\r\n", " ", "None", "b", None])], "id int, items array<string>")
    assert df.select(T.normalize_text_list("items").alias("x")).first()["x"] == "ab"
    assert df.select(T.normalize_text_list("items", True).alias("x")).first()["x"] == "<p>a</p><p>b</p>"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\r\n 　 é")), max_size=12),
                min_size=1, max_size=8))
def test_unicode_strip_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["s"] for r in df.select("id", T.unicode_strip("t").alias("s")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}
    norm = {r["id"]: r["n"] for r in df.select("id", T.normalize_text("t").alias("n")).collect()}
    assert all(not re.search(r"[\r\n\xa0]", v) for v in norm.values())


def test_slug_titles(spark):
    titles = [(1, "Café Noir!"), (2, "天下 第一"), (3, 'He said "hi"'), (4, None), (5, "Élan_vital-2")]
    df = spark.createDataFrame(titles, "id int, title string")
    got = {r["id"]: r["s"] for r in df.select("id", T.slug("title").alias("s")).collect()}
    for i, t in titles:
        assert got[i] == (None if t is None else re.sub(r"[^\w]", "_", t).lower())
    assert all(re.fullmatch(r"[\w]*", v) for v in got.values() if v is not None)


def test_label_value(spark):
    df = spark.createDataFrame([(1, "作者：张三"), (2, "no colon"), (3, "a：b：c")], "id int, text string")
    got = {r["id"]: (r["last"], r["second"]) for r in
           df.select("id", T.label_value("text").alias("last"), T.label_second("text").alias("second")).collect()}
    assert got == {1: ("张三", "张三"), 2: ("no colon", None), 3: ("c", "b")}


def test_page_number(spark):
    df = spark.createDataFrame([(1, "/book-123-45.html"), (2, "/book-1.html"), (3, "x")], "id int, href string")
    got = {r["id"]: r["n"] for r in df.select("id", U.page_number("href").alias("n")).collect()}
    assert got == {1: "45", 2: None, 3: None}


def test_strip_tokens_and_ideographic_split(spark):
    df = spark.createDataFrame([(1, "一\r\n%e5%90%bb二　　三　　")], "id int, t string")
    r = df.select(F.posexplode(T.split_pieces(T.strip_tokens("t"), T.IDEOGRAPHIC_PARAGRAPH)).alias("pos", "p")).collect()
    assert [x["p"] for x in r] == ["一二", "三", ""]


def test_routes(spark):
    urls = [(1, "https://www.sto.cx/book-1-1.html"), (2, "https://m.zhenhunxiaoshuo.com/x"),
            (3, "http://www.256wx.com/a"), (4, "https://www.shubaowb.com/b"), (5, "https://example.com/c"),
            (6, "https://sto.cx/zhenhunxiaoshuo")]
    df = spark.createDataFrame(urls, "id int, url string")
    got = {r["id"]: r["r"] for r in df.select("id", U.route("url").alias("r")).collect()}
    assert got == {1: "sto_cx", 2: "zhenhunxiaoshuo", 3: "256wx", 4: "shubaowb", 5: "generic", 6: "sto_cx"}


EDGE_TEXTS = ["", "a", "x" * 499, "y" * 500, "z" * 501, "w" * 1000, "q" * 499 + "😀" + "r" * 10, None]


def test_chunk_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE_TEXTS)], "doc_id int, text string")
    rows = chunk_texts(df, ["doc_id"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["chunk_no"], r["chunk"]))
    for i, t in enumerate(EDGE_TEXTS):
        got = [c for _, c in sorted(by.get(i, []))]
        want = [] if not t else [t[k:k + 500] for k in range(0, len(t), 500)]
        assert got == want, i


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é😀\n")), max_size=1300), min_size=1, max_size=5))
def test_chunks_concatenate_to_source(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rows = chunk_texts(df, ["doc_id"]).collect()
    for i, t in enumerate(texts):
        cs = sorted((r["chunk_no"], r["chunk"]) for r in rows if r["doc_id"] == i)
        assert "".join(c for _, c in cs) == t
        assert all(len(c) == 500 for _, c in cs[:-1])


def test_title_author_split_combined_titles(spark):
    from quire.operators.extract import title_author_split
    rows = [(1, "Great Book Author: Jane Roe", "sel"), (2, "Plain Title", "From Selector"), (3, None, "x")]
    df = spark.createDataFrame(rows, "id int, title string, author_sel string")
    t, a = title_author_split("title", "author_sel")
    got = {r["id"]: (r["t"], r["a"]) for r in df.select("id", t.alias("t"), a.alias("a")).collect()}
    assert got == {1: ("Great Book", "Jane Roe"), 2: ("Plain Title", "From Selector"), 3: (None, "x")}


def test_entities_match_html_unescape(spark):
    import html as pyhtml

    from quire.functions.html import decode_entities
    cases = ["a&amp", "&ampx", "&amp;lt;", "x&lt", "&copy 2", "&#39s", "&middot;", "&amp;&amp;&amp", "t &quot;q&quot;",
             "&nbsp;", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, t string")
    got = {r["id"]: r["d"] for r in df.select("id", decode_entities("t").alias("d")).collect()}
    assert got == {i: pyhtml.unescape(t) for i, t in enumerate(cases)}
