"""Nodes by position, selectors on rows and in one pass, contents lists."""

from __future__ import annotations

import random
import subprocess
import sys
from html.parser import HTMLParser

from pyspark.sql import functions as F

from quire.functions.urls import NEXT_PAGE_TEXT
from quire.operators import contents as CO
from quire.operators import nodes as ND
from quire.plans.build import build_books

from .conftest import SF0001

PAGE = "page_id long, url string, book_id string, html string"
REPO = __file__.rsplit("/tests/", 1)[0]


def page(spark, *bodies, host="a.b"):
    return spark.createDataFrame([(k, f"http://{host}/{k}", host, x) for k, x in enumerate(bodies)], PAGE)


def texts(spark, body, host="a.b", field="body"):
    return [r.text for r in ND.rule_texts(page(spark, body, host=host)).where(F.col("field") == field).orderBy("no").collect()]


def test_nodes_are_no_larger_than_the_page(spark):
    body = "<b>x" * 2000
    got = ND.html_nodes(page(spark, body)).collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.pos)] == list(range(2000))
    assert all(r["last"] == 1999 and r.depth == r.pos for r in got)
    assert sum(len(t.text) for r in got for t in r.texts) == 2000
    # the whole text of one chosen node
    one = ND.html_nodes(page(spark, body)).where("pos = 1990").select("page_id", "pos", "last")
    assert ND.node_texts(one, ND.html_nodes(page(spark, body))).first().text == "x" * 10


class Plain(HTMLParser):
    """Well-formed markup only: the tree as nested lists."""

    def __init__(self):
        super().__init__()
        self.all, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "up": list(self.stack), "text": "", **dict(attrs)}
        self.all.append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        for n in self.stack:
            n["text"] += data


def tree(r, depth=0):
    out = ""
    for _ in range(r.randint(1, 3)):
        tag, mark = r.choice(["div", "span", "em"]), r.choice(["", " class='p'", " id='k'", " class='q p'"])
        out += f"<{tag}{mark}>{r.choice('uvw')}{tree(r, depth + 1) if depth < 4 and r.random() < 0.7 else ''}</{tag}>{r.choice(['', 'z'])}"
    return out


def test_selectors_are_brute_force(spark):
    r = random.Random(2)
    bodies = [tree(r) for _ in range(40)]
    selectors = {"a": "div span", "b": ".p em", "c": "#k .p, em.q", "d": "div div div", "e": "span:nth-of-type(2)", "f": "#k", "g": "div #k em"}
    rules = ND.rules_frame(spark, [("generic", f, s, 1) for f, s in selectors.items()])
    pages = page(spark, *bodies)

    def step(s, n, seen):
        tag, nth = s.split(":")[0], int(s[-2]) if ":" in s else None
        if nth and seen != nth:
            return False
        for mark in ("#", "."):
            if mark in tag:
                tag, name = tag.split(mark)
                if name not in (n.get("id" if mark == "#" else "class") or "").split():
                    return False
        return tag in ("", n["tag"])

    def fits(steps, n):
        if not step(steps[-1], n, n["nth"]):
            return False
        at = 0
        for up in n["up"]:
            if at < len(steps) - 1 and step(steps[at], up, up["nth"]):
                at += 1
        return at == len(steps) - 1

    want = {}
    for k, b in enumerate(bodies):
        p = Plain()
        p.feed(b)
        seen = {}
        for n in p.all:
            key = (id(n["up"][-1]) if n["up"] else None, n["tag"])
            n["nth"] = seen[key] = seen.get(key, 0) + 1
        for f, s in selectors.items():
            hit = [n for n in p.all if any(fits(alt.split(), n) for alt in s.split(","))]
            if hit:
                want[k, f] = (len(hit), hit[0]["text"])
    got = {(x.page_id, x.field): (x.n_nodes, x.text) for x in ND.apply_rules(ND.html_nodes(pages), rules).collect()}
    assert got == want and len(want) > 60
    # the one-pass reader selects the same; text inside nested selected elements once
    once = {}
    for x in ND.rule_texts(pages, rules).orderBy("page_id", "field", "no").collect():
        once.setdefault((x.page_id, x.field), []).append(x)
    for f in "abdefg":
        for k in range(len(bodies)):
            assert ((k, f) in once) == ((k, f) in want)
            if (k, f) in once:
                assert (once[k, f][0].n_nodes, once[k, f][0].text) == want[k, f]


def test_rule_bodies_take_each_text_once(spark):
    assert texts(spark, "<div id=Content>direct<div>a<p>b <i>c</i></p>d</div>tail<br><br>end</div>out") == ["direct", "a", "b c", "d", "tail\nend"]
    assert texts(spark, "<div id=content>one<p>two</p></div>", host="www.shubaowb.com") == ["one", "two"]
    assert texts(spark, "<div id=chaptercontent>only<script>no</script> text</div>", host="www.shubaowb.com") == ["only text"]
    assert texts(spark, "<article><p>x<article><p>y</p></article><p>z &amp; w</article>") == ["x", "y", "z & w"]
    assert texts(spark, "<div id=BookContent>　　甲<p>乙</p></div>", host="www.sto.cx") == ["　　甲", "乙"]
    # a site without rules of its own: the generic ones
    assert texts(spark, "<div id=Content><p>one</p></div>", host="www.256wx.net") == ["one"]
    assert texts(spark, "") == [] and texts(spark, "<p>none") == []


def test_one_reader_in_the_plan(spark):
    plan = ND.rule_features(page(spark, "<article><p>x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RuleTexts(") == 1 and plan.count("HtmlNodes(") == 0


def test_site_metadata(spark):
    body = "<div id=info><h1>Tale Author: X</h1><p>作者：某人</p></div><div id=intro><p>简介：long &amp; short</p></div><div><img alt=c src='/c.jpg'></div>"
    got = ND.rule_metadata(page(spark, body, "<p>none")).orderBy("page_id").collect()
    assert tuple(got[0])[1:] == ("Tale", "X", "long & short", "http://a.b/c.jpg") and tuple(got[1])[1:] == (None,) * 4


def links(*hrefs, nxt=None):
    a = "".join(f"<li><a href='{h}'>{t}</a></li>" for h, t in hrefs)
    return f"<nav><ul>{a}</ul></nav>" + (f"<p><a class=n href={nxt}>{NEXT_PAGE_TEXT}</a>" if nxt else "")


SITE = [
    (1, "http://s.t/toc", links(("/c9", "newest"), ("/c1", "one"), ("c-rel", "odd"), nxt="/toc2")),
    (2, "http://s.t/toc2", links(("http://s.t/c2?a=1&amp;b=2", "two"), ("/c1", "one again"), ("/toc", "first page"), nxt="/toc3")),
    (3, "http://s.t/toc3", links(("/gone", "missing"), ("/c9", "last"), ("/c3", "three"), nxt="http://s.t/toc")),
    (4, "http://s.t/c1", "<article><h1>C1</h1><p>first</p></article>"), (5, "http://s.t/c2?a=1&b=2", "<article><h1>C2</h1><p>second</p></article>"),
    (6, "http://s.t/c3", "<article><h1>C3</h1><p>third</p></article>"), (7, "http://s.t/c9", "<article><h1>C9</h1><p>ninth</p></article>"),
    (8, "http://u.v/list", links(("/a", "A"), ("/b", "B"))), (9, "http://u.v/b", "<article><h1>B</h1><p>b</p></article>"),
    (10, "http://s.t/start", links(("/c0", "zero"), nxt="/toc")),
]


def test_contents_of_three_pages(spark):
    pages = spark.createDataFrame([(i, u, u.split("/")[2], h) for i, u, h in SITE], PAGE)
    # /start leads into the three pages, whose last one leads back to the first
    order = CO.contents_order(pages).orderBy("contents_url", "chapter_no").collect()
    assert [(r.chapter_no, r.url, r.title, r.toc_page) for r in order if r.book_id == "s.t"] == [
        (1, "http://s.t/c0", "zero", 1), (2, "http://s.t/c9", "newest", 2), (3, "http://s.t/c1", "one", 2), (4, "http://s.tc-rel", "odd", 2),
        (5, "http://s.t/c2?a=1&b=2", "two", 3), (6, "http://s.t/gone", "missing", 4), (7, "http://s.t/c3", "three", 4)]
    assert [(r.chapter_no, r.url) for r in order if r.book_id == "u.v"] == [(1, "http://u.v/a"), (2, "http://u.v/b")]
    docs = spark.createDataFrame([("a word and the end", "en")], "text string, lang string")
    book = build_books(pages, docs, order=CO.contents_order(pages)).orderBy("book_id", "chapter_no").collect()
    assert [(r.book_id, r.chapter_no, r.title) for r in book] == [("s.t", 2, "C9"), ("s.t", 3, "C1"), ("s.t", 5, "C2"), ("s.t", 7, "C3"), ("u.v", 2, "B")]
    assert CO.contents_order(pages.where("page_id = 4")).count() == 0 and CO.contents_order(pages.limit(0)).count() == 0


def test_nodes_agree_with_the_rules_pass(spark):
    pages = spark.read.parquet(f"{SF0001}/pages.parquet").withColumn("book_id", F.lit("x"))
    rows = {(r.page_id, r.field): (r.n_nodes, r.text.strip()) for r in ND.apply_rules(ND.html_nodes(pages), ND.rules_frame(spark)).collect()}
    once = {(r.page_id, r.field): (r.n_nodes, r.text.strip()) for r in ND.rule_texts(pages).where("no = 0").collect()}
    assert rows == once and len(rows) == 200


def test_entry_without_what_the_optional_part_needs():
    """A library missing, or a leftover folder: the other queries stay."""
    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['quire.llm'] = None\nimport warnings; warnings.simplefilter('ignore')\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'build_books' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
