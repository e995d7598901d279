"""Operator 5: HTML extraction by equivalence-class template deduction.

Pages of one host come from a template.  Tokens of a page are its elements,
told apart by their path (tag, class and id of every ancestor), and its text
nodes, told apart by path and wording.  Tokens with the same occurrence
vector - as often on every page of the host - form an equivalence class; a
class that is large and frequent enough is part of the template.  As paths
carry their ancestors, classes nest as the elements do.  What lies between is
a slot, and the slot that holds the prose is the article:

1. tokens of each page with counts; per (host, token) a fingerprint of its
   vector (an order-free hash of page and count), its pages and its prose;
2. classes by (host, fingerprint), valid with ``MIN_CLASS`` tokens on
   ``SUPPORT`` of the host's pages, two at least;
3. the slots are what varies: all prose outside template text (text tokens of
   a valid class on ``FURNITURE`` of the host's pages, two at least; an
   element goes only if all its own text is template, whatever its kind and
   length) and outside furniture.  In articles a repeated heading stays where
   a slot follows it, and an article of which the template would take more
   than half the blocks keeps them: it is a near copy of other pages;
4. each page yields the text of all its slots in page order, without
   navigation, forms, adverts, notices, comments and what else is furniture by
   element, role or class (inside an article only by names that say nothing
   else, and never a paragraph's).  Where the host's template has slots in article or
   main elements, or the host shows no template, a page that has such elements
   yields theirs only.  A page whose text is template altogether keeps it.

Every aggregate is partial before its shuffle, so a host may hold any share
of the pages, and copies of a page count as one; no task sees a host whole.  Page bodies are never shuffled while
the deduced templates are within ``BROADCAST_HASHES``; beyond it they are
joined on salted hosts.

Defined results: null and empty html gives empty text; a null URL belongs to
the host ''; repeated rows are extracted alike; markup that is cut off or
never closed ends with the page; further columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bounded_batches, read
from .urls import split_url

SUPPORT = 0.5
MIN_CLASS = 3
FURNITURE = 0.9
# Hashes (8 bytes each) of all deduced templates that may be broadcast.
BROADCAST_HASHES = 1_000_000
SALTS = 64

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>?")
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+")

RAW = frozenset("script style noscript template textarea title iframe svg math select option datalist xmp noframes object canvas audio video".split())
_RAW_ENDS = {name: re.compile("</" + name, re.IGNORECASE | re.ASCII) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
HEAD = frozenset(("head", "meta", "link", "base"))
DROPPED = frozenset(("nav", "aside", "footer", "form", "button", "dialog", "menu", "input", "fieldset"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
MAIN_TAGS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar toolbar alert".split())
WRAPPERS = frozenset(("html", "body"))
# words of class and id that name furniture
FURNITURE_NAMES = frozenset((
    "nav navbar navigation menu menubar footer sidebar aside ad ads advert adverts advertisement advertising adsense adslot banner banners "
    "sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay comment comments "
    "commentlist disqus respond replies related recommended share sharing social breadcrumb breadcrumbs newsletter subscribe subscription signup "
    "login search widget widgets toolbar pager pagination masthead topbar").split())
HEADER_NAMES = frozenset(("header", "masthead"))
IN_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement sponsored related promo".split())
# words that say nothing of an element's use: inside an article a name is
# furniture only if these are all that stands beside furniture's words
PLAIN_NAMES = frozenset((
    "area bar block body bottom box btn button buttons center col column container content cta element footer group head header heading holder icons "
    "inline inner item items left link links list message module outer panel part post posts right row section site slot small story title top unit "
    "user wrap wrapper your our the this").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt".split())
NOT_FURNITURE = frozenset("has with no without content article main body wrapper container page layout site".split())
CONTENT_NAMES = frozenset("content article main post entry story text body".split())
# a new block of the kind closes an open one, up to a container
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = frozenset("ul ol dl table tbody thead div section article main body".split())


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), _html.unescape(a or b or c))
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, open and close, in page order; comments,
    declarations and elements without prose of their own are passed over."""
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
        elif m := _TAG.match(page, lt):
            at, name = m.end(), m[2].lower()
            if m[1]:
                yield "close", name, ""
            elif name in RAW and not m[3].endswith("/"):
                stop = _RAW_ENDS[name].search(page, at)
                at = stop.start() if stop else end
            else:
                yield "open", name, m[3]
        else:
            yield "text", "<", ""
            at = lt + 1


def furniture(name: str, attrs: dict[str, str], in_main: bool) -> bool:
    """Is the element none of the article, by its tag, role or names?"""
    if name in WRAPPERS:
        return False
    if name in DROPPED or (name == "header" and not in_main):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if "style" in attrs and "display:none" in attrs["style"].replace(" ", "").lower():
        return True
    for label in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        own = set(_NAMES.findall(label))
        if name in MAIN_TAGS:
            if own & IN_ARTICLE:
                return True
        elif in_main:
            # a paragraph's name is no evidence there: template text goes by its class
            if name not in PROSE and own & FURNITURE_NAMES and own <= FURNITURE_NAMES | PLAIN_NAMES:
                return True
        elif own & FURNITURE_NAMES and not own & NOT_FURNITURE - {"content", "container", "wrapper", "body"}:
            return True
        elif own & HEADER_NAMES and not in_main and not own & NOT_FURNITURE:
            return True
    return False


class Node:
    __slots__ = ("name", "path", "drop", "main", "rank")

    def __init__(self, name, path, drop, main, rank):
        self.name, self.path, self.drop, self.main, self.rank = name, path, drop, main, rank


def _hash(parent: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


ROOT = Node("", 0, False, False, 0)


def walk(page: str) -> Iterator[tuple[str, tuple[Node, ...] | list[Node], str]]:
    """("element", open nodes, name) and ("text", open nodes, words) and
    ("break", ..) at the borders of blocks."""
    stack, count = [ROOT], {}

    def pop() -> None:
        n = stack.pop()
        count[n.name] -= 1

    for kind, name, rest in tokens(page):
        if kind == "text":
            yield "text", stack, name
        elif kind == "close":
            if name in INLINE:
                continue
            yield "break", stack, name
            if count.get(name):
                while stack[-1].name != name:
                    pop()
                pop()
        else:
            inline = name in INLINE
            if not inline:
                yield "break", stack, name
            if name in VOID:
                continue
            if inline:
                # never pushed: an inline element that is left open must not hold the rest
                continue
            attrs = attributes(rest) if rest.strip(" /") else {}
            for old in CLOSES.get(name, ()):
                k = len(stack) - 1
                while k > 0 and stack[k].name not in LISTS:
                    if stack[k].name == old:
                        while len(stack) > k:
                            pop()
                        break
                    k -= 1
            # a paragraph or heading ends where the next block begins
            if stack[-1].name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                pop()
            if rest.endswith("/") and name not in PROSE and name not in MAIN_TAGS and name != "div":
                continue
            top = stack[-1]
            label = f"{name}.{'.'.join(sorted(_NAMES.findall((attrs.get('class', '') + ' ' + attrs.get('id', '')).lower())))}" if attrs else name
            main = top.main or name in MAIN_TAGS
            names = set(_NAMES.findall((attrs.get("class", "") + " " + attrs.get("id", "")).lower())) if attrs else set()
            rank = 2 if name in MAIN_TAGS else 1 if names & CONTENT_NAMES and name not in WRAPPERS else 0
            node = Node(name, _hash(top.path, label), top.drop or name in HEAD or furniture(name, attrs, top.main), main, rank)
            stack.append(node)
            count[name] = count.get(name, 0) + 1
            yield "element", stack, name


def container(stack: list[Node]) -> Node:
    """What a text would be the prose of: the outermost article or main
    element, else the outermost element of a content-like name, else the
    innermost element that is no paragraph, heading or cell."""
    for n in stack:
        if n.rank == 2:
            return n
    for n in stack:
        if n.rank == 1 and n.name not in PROSE:
            return n
    for n in reversed(stack):
        if n.name not in PROSE and n.name not in ("ul", "ol", "dl", "tr", "tbody", "table", "blockquote"):
            return n
    return stack[0]


def page_tokens(page: str) -> dict[int, list]:
    """token -> [count, container path (0: an element), rank, chars]; paths
    are of text that is not furniture."""
    out: dict[int, list] = {}

    def add(tok, path, rank, chars):
        got = out.get(tok)
        if got is None:
            out[tok] = [1, path, rank, chars]
        else:
            got[0] += 1
            got[3] += chars

    for kind, stack, text in walk(page):
        if kind == "element":
            add(stack[-1].path, 0, 0, 0)
        elif kind == "text" and (own := " ".join(_html.unescape(text).split())):
            top = stack[-1]
            c = None if top.drop else container(stack)
            add(_hash(top.path, "#" + own), c.path if c else 0, c.rank if c else 0, len(own) if c else 0)
    return out


def extract(page: str | None, main: list[int], drop: frozenset | set) -> str:
    """The text of a page's slots, in page order; ``main`` are the article and
    main elements of the host's template, ``drop`` its texts."""
    if not page:
        return ""
    found = blocks(page)
    # without an article element in the template, one on a page is no more than a slot of it
    kept = [b for b in found if b[2] == 2] if main or not drop else []
    kept = kept or found
    slots = slots_of(kept, drop)
    # an article that is mostly the text of other pages is their near copy, no template
    if kept[:1] and kept[0][2] == 2 and 2 * len(slots) < len(kept):
        slots = kept
    return " ".join(t for *_, t in slots) or " ".join(t for *_, t in kept)


def blocks(page: str) -> list[tuple[Node, tuple[int, ...], int, str]]:
    """(element, tokens, rank of its container, text) of every text block that is not furniture."""
    out, own, toks, top, rank = [], [], [], None, 0

    def end():
        if own:
            if words := _html.unescape("".join(own)).split():
                out.append((top, tuple(toks), rank, " ".join(words)))
            own.clear()
            toks.clear()

    for kind, stack, text in walk(page):
        if kind == "text":
            if stack[-1].drop:
                continue
            top = stack[-1]
            if not own:
                rank = container(stack).rank
            own.append(text)
            if words := " ".join(_html.unescape(text).split()):
                toks.append(_hash(top.path, "#" + words))
        elif kind == "break":
            end()
    end()
    return out


def slots_of(found: list, drop: frozenset | set) -> list:
    """The blocks without template text; a prose element goes only if all its
    own text is template, a heading in an article only if it heads no slot:
    with varying text after it, and not template text before it, it stays."""
    if not drop:
        return found
    alive = {id(b[0]) for b in found if b[0].name in PROSE and not all(t in drop for t in b[1])}
    keep = [id(b[0]) in alive if b[0].name in PROSE else not all(t in drop for t in b[1]) for b in found]
    # from the end: what each heading heads
    heads, below = [False] * len(found), False
    for k in range(len(found) - 1, -1, -1):
        if not keep[k] and found[k][2] == 2 and found[k][0].name in HEADINGS:
            heads[k] = below
        else:
            below = keep[k]
    for k, own in enumerate(heads):
        if own and (k == 0 or keep[k - 1]):
            keep[k] = True
    return [b for b, kept in zip(found, keep) if kept]


def count_tokens(pages: DataFrame) -> DataFrame:
    """host, tok, path, rank, page, n, chars: the tokens of every page; the
    token 0 stands for the page itself."""
    bounded_batches(pages.sparkSession)
    src = pages.select(split_url(F.col("url"))[0].alias("host"), F.xxhash64(F.col("html").cast("string")).alias("page"),
                       F.col("html").cast("string").alias("html"))
    # copies of a page count once
    again = materialize(src.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "page-copies")
    if again.count() <= BROADCAST_HASHES:
        again = F.broadcast(again)
    src = src.join(again, ["host", "page"], "left").select("host", "page", "html", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    schema = "host string, page long, tok long, path long, rank int, n int, chars long, share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, page, share, cols = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), [[] for _ in range(8)]
            for k, text in enumerate(b.column(2)):
                found = page_tokens(text.as_py() or "")
                rows = [(host[k], page[k], 0, 0, 0, 1, 0, share[k]), *[(host[k], page[k], t, v[1], v[2], v[0], v[3], share[k]) for t, v in found.items()]]
                for c, x in zip(cols, zip(*rows)):
                    c.extend(x)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["host", "page", "tok", "path", "rank", "n", "chars", "share"])

    return src.mapInArrow(run, schema)


def deduce(pages: DataFrame) -> DataFrame:
    """(host, main, texts): the article and main elements of the host's template, and its template texts."""
    toks = materialize(
        count_tokens(pages).groupBy("host", "tok").agg(
            F.sum(F.shiftright(F.xxhash64("page", "n"), 24)).alias("vector"), F.sum("share").alias("pages"),
            F.max(F.struct("rank", "path")).alias("at"), F.sum("chars").alias("chars")), "page-tokens")
    hosts = toks.where("tok = 0").select("host", F.col("pages").alias("all"))
    often = toks.where("tok <> 0 and pages > 1.5").join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("all") - 1e-6)
    # equivalence classes; the valid ones are the template
    valid = often.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= MIN_CLASS).select("host", "vector")
    template = materialize(often.join(valid, ["host", "vector"], "left_semi"), "page-template")
    # slots in article and main elements: prose outside template text
    slots = (toks.where("chars > 0 and at.rank = 2").join(template.select("host", "tok"), ["host", "tok"], "left_anti")
                 .select("host", F.col("at.path").alias("tok")).distinct())
    main = (slots.join(template.select("host", "tok"), ["host", "tok"], "left_semi")
                 .groupBy("host").agg(F.sort_array(F.collect_list("tok")).alias("main")))
    texts = (template.where((F.col("pages") >= FURNITURE * F.col("all") - 1e-6) & (F.col("chars") > 0))
                     .groupBy("host").agg(F.sort_array(F.collect_list("tok")).alias("texts")))  # each on most pages: no more than a page has
    return main.join(texts, "host", "full")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    bounded_batches(pages.sparkSession)
    found = materialize(deduce(pages), "templates")
    src = pages.select("page_id", "url", split_url(F.col("url"))[0].alias("host"), F.col("html").cast("string").alias("html"))
    hashes = F.coalesce(F.size("main"), F.lit(0)) + F.coalesce(F.size("texts"), F.lit(0)) + 1
    if (found.agg(F.sum(hashes).alias("n")).first()["n"] or 0) <= BROADCAST_HASHES:
        d = src.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    d = d.select("page_id", "url", "html", "main", "texts")

    def sets(lists: list) -> list[frozenset]:
        # pages of one host have the same list: one set for each
        made: dict[tuple, frozenset] = {}
        return [made.setdefault(key, frozenset(key)) if (key := tuple(t or ())) not in made else made[key] for t in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            main, texts = b.column(3).to_pylist(), b.column(4).to_pylist()
            got = [extract(h.as_py(), m or [], t) for h, m, t in zip(b.column(2), main, sets(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    return d.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
