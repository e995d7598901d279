"""C1 + D4: HTML as rows, and per-site selector rules.

``html_nodes`` is a Python UDTF over the standard-library parser (bs4 and
lxml are not available): one page in, one row per element out.  An element
carries its place in document order (``pos``) and that of its last descendant
(``last``), so "lies inside" is ``pos BETWEEN``, and the text pieces directly
under it, so the rows of a page are no larger than the page.  Selectors are
evaluated on these rows as joins (``apply_rules``).

``rule_texts`` is the one-pass form for the book job: a site's selectors are
followed along the stack of open elements while the page is read, and each
piece of text comes out once per field.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.text import label_value, unicode_strip
from ..functions.urls import DEFAULT_ROUTE, absolutise, route, split_url_head
from ..session import materialize

# --- fixed values -----------------------------------------------------------
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Opening one of these closes an open <p> (HTML implied end tags).
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main nav ol p pre section table ul".split())
# Opening one of these closes an open element of the same family.
SELF_CLOSING_FAMILY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
RAW_TEXT = frozenset(("script", "style"))
# Selector rules per route (route, field, CSS selector, priority): the
# reference's selectors for its sites and its generic path, then the test
# pages' markup as the generic fallback (priority 2).  Comma = either.
RULES = (
    ("sto_cx", "title", "h1", 1),
    ("sto_cx", "body", "#BookContent", 1),
    ("sto_cx", "link", "div.paginator a", 1),
    ("zhenhunxiaoshuo", "title", "h1.focusbox-title", 1),
    ("zhenhunxiaoshuo", "author", "div.focusbox-text p", 1),
    ("zhenhunxiaoshuo", "link", "body section div.excerpts-wrapper div article a", 1),
    ("zhenhunxiaoshuo", "body", "div.content-wrap div.content article.article-content p", 1),
    ("shubaowb", "title", ".title1", 1),
    ("shubaowb", "author", "div.book_box dl dd.dd_box span", 1),
    ("shubaowb", "description", ".book_about dd", 1),
    ("shubaowb", "link", "div.book_last dl dd a", 1),
    ("shubaowb", "body", "#content *", 1),
    ("shubaowb", "body", "#chaptercontent", 2),
    ("generic", "title", "#info h1, .catalog h1", 1),
    ("generic", "author", "#info p:nth-of-type(1), .p1", 1),
    ("generic", "description", "#intro p, .jj .p2", 1),
    ("generic", "cover", "div img", 1),
    ("generic", "link", "#list dl dd a, ul.p2:nth-of-type(2) li a", 1),
    ("generic", "body", "#Content *", 1),
    ("generic", "title", "article h1", 2),
    ("generic", "body", "article p", 2),
    ("generic", "link", "nav a", 2),
    ("generic", "advert", "div.ad", 2),
)
# ---------------------------------------------------------------------------

# Largest rule set compiled into the one-pass reader.
RULES_MAX = 100_000

NODE_SCHEMA = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("nth", T.IntegerType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("texts", T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("text", T.StringType())]))),
    T.StructField("first_text", T.StringType()),
])


class Element:
    """An open or closed element of the page being read."""

    __slots__ = ("pos", "last", "parent", "depth", "tag", "nth", "node_id", "classes", "attrs", "texts", "first_text", "children", "state")

    def __init__(self, pos, parent, depth, tag, nth, attrs):
        self.pos = self.last = pos
        self.parent, self.depth, self.tag, self.nth, self.attrs = parent, depth, tag, nth, attrs
        self.node_id, self.classes = attrs.get("id"), attrs.get("class", "").split()
        self.texts, self.first_text, self.children, self.state = [], None, {}, None


class TreeReader(HTMLParser):
    """Reads a page with implied end tags; every step costs the same however
    deep the page is.  ``opened``, ``closed`` and ``said`` are for subclasses."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.open_tags: dict[str, int] = {}
        self.top: dict[str, int] = {}
        self.count = 0
        self.pieces = 0

    def opened(self, e: Element) -> None: ...

    def closed(self, e: Element) -> None: ...

    def said(self, text: str) -> None: ...

    def line_break(self) -> None: ...

    def _close_last(self) -> None:
        e = self.stack.pop()
        e.last = self.count - 1
        self.open_tags[e.tag] -= 1
        self.closed(e)

    def _close(self, tag: str) -> None:
        if self.open_tags.get(tag):
            while self.stack[-1].tag != tag:
                self._close_last()
            self._close_last()

    def _open(self, tag: str, attrs, push: bool) -> None:
        if tag in CLOSES_P:
            self._close("p")
        for family in SELF_CLOSING_FAMILY.get(tag, ()):
            if self.stack and self.stack[-1].tag == family:
                self._close_last()
        parent = self.stack[-1] if self.stack else None
        seen = parent.children if parent else self.top
        seen[tag] = seen.get(tag, 0) + 1
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v if v is not None else "")
        e = Element(self.count, parent.pos if parent else None, len(self.stack), tag, seen[tag], first)
        self.count += 1
        if push:
            self.stack.append(e)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.opened(e)
        if not push:
            self.closed(e)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.line_break()
        self._open(tag, attrs, tag not in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        # only void elements end at '/>'
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if not any(self.open_tags.get(t) for t in RAW_TEXT):
            self.said(data)
            self.pieces += 1

    def read(self, html: str) -> None:
        self.feed(html or "")
        self.close()
        while self.stack:
            self._close_last()


class NodeReader(TreeReader):
    """All elements of a page in document order."""

    def __init__(self):
        super().__init__()
        self.nodes: list[Element] = []
        self.leading: list[Element] = []  # whose leading text comes next: an element, or <p> and the <b> it begins with
        self.breaks = False

    def opened(self, e):
        self.nodes.append(e)
        begins = e.tag == "b" and len(self.leading) == 1 and self.leading[0].tag == "p" and self.leading[0].pos == e.parent
        self.leading = [*self.leading, e] if begins else [e]

    def handle_endtag(self, tag):
        self.leading = []
        super().handle_endtag(tag)

    def said(self, text):
        for e in self.leading:
            e.first_text = text
        self.leading = []
        if self.stack:
            self.stack[-1].texts.append((self.pieces, text))


def parse_nodes(html: str):
    reader = NodeReader()
    reader.read(html)
    for e in reader.nodes:
        yield e.pos, e.last, e.parent, e.depth, e.tag, e.nth, e.node_id, e.classes, e.attrs, e.texts, e.first_text or ""


@udtf(returnType=NODE_SCHEMA, useArrow=True)
class HtmlNodes:
    def eval(self, html: str):
        yield from parse_nodes(html)


def html_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, url, book_id, node columns...), one row per element."""
    src = pages.select("page_id", "url", "book_id", "html")
    return src.lateralJoin(HtmlNodes(F.col("html").outer())).drop("html")


def node_texts(matched: DataFrame, nodes: DataFrame, keys=("page_id",)) -> DataFrame:
    """The whole text of chosen nodes (``matched``: keys, pos, last): keys, pos,
    text.  Only their own subtrees are read: pos between pos and last."""
    keys = list(keys)
    m = matched.select(*keys, F.col("pos").alias("_from"), F.col("last").alias("_to"))
    pieces = nodes.select("page_id", "pos", F.explode("texts").alias("t"))
    j = m.join(pieces, "page_id").where(F.col("pos").between(F.col("_from"), F.col("_to")))
    said = j.groupBy(*keys, "_from").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    text = F.array_join(F.transform("ts", lambda x: x["text"]), "")
    return m.join(said, [*keys, "_from"], "left").select(*keys, F.col("_from").alias("pos"), F.coalesce(text, F.lit("")).alias("text"))


# --- selectors -----------------------------------------------------------------

def compounds(selector: str) -> list[list[dict]]:
    """A selector list as alternatives (comma), each a list of steps (white
    space: inside), each a step {tag, id, classes, nth}; nothing else is known."""
    out = []
    for alternative in selector.split(","):
        steps = []
        for part in alternative.split():
            m = re.fullmatch(r"([a-z0-9]*|\*)((?:[#.][\w-]+)*)(?::nth-of-type\((\d+)\))?", part)
            if not m:
                raise ValueError(f"unsupported selector part: {part}")
            marks = re.findall(r"([#.])([\w-]+)", m[2])
            ids = [name for kind, name in marks if kind == "#"]
            steps.append({"tag": m[1] if m[1] not in ("", "*") else None, "id": ids[0] if ids else None,
                          "classes": [name for kind, name in marks if kind == "."], "nth": int(m[3]) if m[3] else None})
        out.append(steps)
    return out


RULE_SCHEMA = T.StructType([
    T.StructField("route", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("selector", T.StringType()), T.StructField("priority", T.IntegerType())])
_STEP_SCHEMA = T.StructType([
    *RULE_SCHEMA.fields[:2], T.StructField("priority", T.IntegerType()), T.StructField("alternative", T.IntegerType()), T.StructField("step", T.IntegerType()),
    T.StructField("steps", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("nth", T.IntegerType())])


def rules_frame(spark: SparkSession, rows=RULES) -> DataFrame:
    return spark.createDataFrame(list(rows), RULE_SCHEMA)


def _rule_rows(rules: DataFrame) -> list[tuple]:
    """The rule set on the driver; an error beyond RULES_MAX."""
    rows = rules.select(*RULE_SCHEMA.names).limit(RULES_MAX + 1).collect()
    if len(rows) > RULES_MAX:
        raise ValueError(f"more than {RULES_MAX} rules")
    return [tuple(r) for r in rows]


def effective_route(url, known) -> "F.Column":
    """B1's route; one without rules of its own (``known``) takes the generic ones."""
    r = route(url)
    return F.when(r.isin(*known), r).otherwise(F.lit(DEFAULT_ROUTE)) if known else F.lit(DEFAULT_ROUTE)


def select_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Every node that the best-priority rule of its page's route selects, per
    (page, field): page_id, field, priority, pos, last, first_text.  A step of
    a selector is a filter on the node, "inside" a containment of positions."""
    spark = nodes.sparkSession
    rows = _rule_rows(rules)
    steps = [(r, f, p, a, k + 1, len(alt), x["tag"], x["id"], x["classes"], x["nth"])
             for r, f, selector, p in rows for a, alt in enumerate(compounds(selector)) for k, x in enumerate(alt)]
    table = F.broadcast(spark.createDataFrame(steps, _STEP_SCHEMA))  # at most RULES_MAX selectors
    n = nodes.select("page_id", "pos", "last", "tag", "nth", "node_id", "classes", "first_text", effective_route("url", sorted({r[0] for r in rows})).alias("route")).alias("n")
    x = table.alias("x")
    fits = ((F.col("n.route") == F.col("x.route")) & (F.col("x.tag").isNull() | (F.col("x.tag") == F.col("n.tag")))
            & (F.col("x.id").isNull() | (F.col("x.id") == F.col("n.node_id"))) & (F.col("x.nth").isNull() | (F.col("x.nth") == F.col("n.nth")))
            & (F.size(F.array_except("x.classes", "n.classes")) == 0))
    # read once for each step of the longest selector: written, so that the
    # nodes are not read off the pages as often
    hits = materialize(n.join(x, fits).select("page_id", "field", "priority", "alternative", "step", "steps", "pos", "last", "first_text"), "rule-hits")
    key = ["page_id", "field", "priority", "alternative"]
    reached, found = hits.where("step = 1"), []
    for k in range(1, max((s[5] for s in steps), default=1) + 1):
        found.append(reached.where(F.col("steps") == k))
        outer = reached.select(*key, F.col("pos").alias("_from"), F.col("last").alias("_to")).alias("o")
        inner = hits.where(F.col("step") == k + 1).alias("i")
        inside = (F.col("i.pos") > F.col("o._from")) & (F.col("i.pos") <= F.col("o._to"))
        for c in key:
            inside = inside & (F.col(f"i.{c}") == F.col(f"o.{c}"))
        reached = inner.join(outer, inside, "left_semi")
    chosen = found[0]
    for f in found[1:]:
        chosen = chosen.unionByName(f)
    chosen = materialize(chosen.select("page_id", "field", "priority", "pos", "last", "first_text").distinct(), "rule-nodes")
    best = chosen.groupBy("page_id", "field").agg(F.min("priority").alias("priority"))
    return chosen.join(best, ["page_id", "field", "priority"])


def apply_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (page, field) the nodes of the best-priority rule that selects
    any: their count, the first one's leading text and its whole text."""
    # the selectors and the texts read the nodes: pages are parsed once
    nodes = materialize(nodes.select("page_id", "url", "pos", "last", "tag", "nth", "node_id", "classes", "texts", "first_text"), "nodes")
    per = (select_nodes(nodes, rules).groupBy("page_id", "field")
           .agg(F.count(F.lit(1)).alias("n_nodes"), F.min_by(F.struct("pos", "last", "first_text"), "pos").alias("f")))
    firsts = per.select("page_id", "field", "n_nodes", "f.pos", "f.last", "f.first_text")
    return (firsts.join(node_texts(firsts, nodes, ("page_id", "field")), ["page_id", "field", "pos"])
                  .select("page_id", "field", "n_nodes", "first_text", "text"))


# --- one pass ------------------------------------------------------------------

TEXT_SCHEMA = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("no", T.IntegerType()), T.StructField("n_nodes", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("link", T.StringType())])


class Rule:
    """One alternative of a rule.  A trailing ``*`` takes in the text directly
    under the element before it; bodies come apart at block elements."""

    def __init__(self, field: str, priority: int, steps: list[dict]):
        self.field, self.priority = field, priority
        self.whole = len(steps) > 1 and steps[-1] == {"tag": None, "id": None, "classes": [], "nth": None}
        self.steps = steps[:-1] if self.whole else steps

    def fits(self, k: int, e: Element) -> bool:
        x = self.steps[k]
        return ((x["tag"] is None or x["tag"] == e.tag) and (x["id"] is None or x["id"] == e.node_id) and (x["nth"] is None or x["nth"] == e.nth)
                and all(c in e.classes for c in x["classes"]))


class Taken:
    """What one field of one priority has taken so far."""

    def __init__(self):
        self.open = 0  # selected elements around the reader: text inside nested ones is taken once
        self.n_nodes = 0
        self.parts: list[list[str]] = []
        self.links: list[str | None] = []
        self.cut = True  # the next text begins a new part
        self.breaks = False


class RuleReader(TreeReader):
    """Follows all selectors of a route along the open elements: a selector's
    state is how many of its steps the open elements have met."""

    def __init__(self, rules: list[Rule]):
        super().__init__()
        self.rules = rules
        self.taken = {(r.field, r.priority): Taken() for r in rules}
        self.start = (0,) * len(rules)

    def opened(self, e):
        before = self.stack[-2].state if len(self.stack) > 1 and self.stack[-1] is e else self.stack[-1].state if self.stack and self.stack[-1] is not e else self.start
        state, hit = list(before), {}
        for k, r in enumerate(self.rules):
            met, n = before[k], len(r.steps)
            if met >= n:
                # inside a scope whose every descendant counts
                if r.whole:
                    self.taken[r.field, r.priority].n_nodes += 1
            elif r.fits(met, e):
                if met == n - 1:
                    hit[r.field, r.priority] = r.whole
                    state[k] = n if r.whole else met
                else:
                    state[k] = met + 1
        self._cut(e.tag)
        for key, whole in hit.items():
            t = self.taken[key]
            t.n_nodes += not whole
            if not t.open:
                t.cut = True
                if not whole:
                    t.parts.append([])
                    t.links.append(e.attrs.get("href") or e.attrs.get("src"))
                    t.cut = False
            t.open += 1
        e.state = tuple(state)
        e.children["\0"] = tuple(hit)

    def closed(self, e):
        for key in e.children.pop("\0", ()):
            self.taken[key].open -= 1
        self._cut(e.tag)

    def _cut(self, tag: str) -> None:
        if tag in CLOSES_P:
            for (field, _), t in self.taken.items():
                if field == "body" and t.open and t.parts and (t.cut or t.parts[-1]):
                    t.cut = True

    def line_break(self):
        for t in self.taken.values():
            t.breaks = t.open > 0

    def said(self, text):
        blank = not text.strip()
        for t in self.taken.values():
            if not t.open:
                continue
            if t.breaks and blank:
                continue  # a line break counts once text follows it
            if t.cut:
                if blank:
                    continue
                t.parts.append([])
                t.links.append(None)
                t.cut = False
            elif t.breaks and t.parts[-1]:
                t.parts[-1].append("\n")
            t.breaks = False
            t.parts[-1].append(text)


def rule_reader(rows) -> type:
    """The UDTF for a rule set (rows of route, field, selector, priority)."""
    rows = [tuple(r) for r in rows]

    @udtf(returnType=TEXT_SCHEMA, useArrow=True)
    class RuleTexts:
        def __init__(self):
            self.rules: dict[str, list[Rule]] = {}
            for name, field, selector, priority in rows:
                self.rules.setdefault(name, []).extend(Rule(field, priority, steps) for steps in compounds(selector))

        def eval(self, html: str, name: str):
            reader = RuleReader(self.rules.get(name, []))
            reader.read(html)
            best: dict[str, int] = {}
            for (field, priority), t in reader.taken.items():
                if t.n_nodes or t.parts:
                    best[field] = min(best.get(field, priority), priority)
            for field, priority in sorted(best.items()):
                t = reader.taken[field, priority]
                for no, (part, link) in enumerate(zip(t.parts, t.links)):
                    yield field, no, t.n_nodes, "".join(part), link

    return RuleTexts


def rule_texts(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The fields of every page by its route's rules, in one pass over it:
    page_id, url, book_id, field, no (order in the field), n_nodes, text, link
    (href or src of the element).  Of a field's rules the best priority that
    selects anything counts; text inside nested selected elements comes once."""
    rows = RULES if rules is None else _rule_rows(rules)
    read = rule_reader(rows)
    src = pages.select("page_id", "url", "book_id", "html", effective_route("url", sorted({r[0] for r in rows})).alias("_route"))
    return src.lateralJoin(read(F.col("html").outer(), F.col("_route").outer())).drop("html", "_route")


def rule_metadata(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """B4 by the route's rules: page_id, title, author, description, cover_url;
    the first element each rule selects.  A combined title gives the author
    (B5), a labelled author or description what follows the label (I4), the
    cover is made absolute."""
    from .extract import title_author_split
    said = rule_texts(pages, rules).where(F.col("field").isin("title", "author", "description", "cover") & (F.col("no") == 0))
    one = lambda field, col: F.max(F.when(F.col("field") == field, F.col(col)))
    per = said.groupBy("page_id", "url").agg(one("title", "text").alias("t"), one("author", "text").alias("a"), one("description", "text").alias("d"), one("cover", "link").alias("c"))
    title, author = title_author_split(unicode_strip("t"), unicode_strip(label_value("a")))
    return (pages.select("page_id").join(per, "page_id", "left")
            .select("page_id", title.alias("title"), author.alias("author"), unicode_strip(label_value("d")).alias("description"),
                    absolutise("c", split_url_head("url")).alias("cover_url")))


def rule_features(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Per-page features for the book job from the route's selector rules:
    title = first 'title' element, paragraphs = the parts of the body in
    document order.  Same columns as ``extract.page_features``."""
    said = rule_texts(pages, rules)
    per = (said.where(F.col("field").isin("title", "body")).groupBy("page_id")
               .agg(F.min_by(F.when(F.col("field") == "title", F.col("text")), F.when(F.col("field") == "title", F.col("no"))).alias("title"),
                    F.sort_array(F.collect_list(F.when(F.col("field") == "body", F.struct("no", "text")))).alias("_b")))
    paras = F.transform("_b", lambda x: x["text"])
    base = pages.select("page_id", "url", "book_id")
    return (base.join(per, "page_id", "left")
                .select("page_id", "url", "book_id", unicode_strip("title").alias("title"),
                        F.array_join(F.coalesce(paras, F.array()), " ").alias("article_text"),
                        F.coalesce(paras, F.array().cast("array<string>")).alias("paragraphs")))
