"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the given tables (or what Spark derives from them) in
whole; output columns are aliased to the names used by the oracle SQL.
Integers are exposed as BIGINT on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..functions.urls import NEXT_PAGE_TEXT
from ..operators import extract as X
from ..functions import markup as M
from ..operators import books as B
from ..operators import contents as CO
from ..operators import language as LG
from ..operators import nodes as ND
from ..operators import translate as TR
from ..operators.chains import chain_forest, follow_chain
from ..operators.numbering import number_within
from ..operators.skew import HOT_ROWS, split_hot_join
from ..session import materialize, scratch_path
from ..sources import sinks as SK
from ..sources.pages import decode_pages, declares_gbk, load_pages, read_table, spread
from ..sources.pages import read_landing, write_landing
from ..streaming.ingest import ingest_pages
from .build import build_books as _build_books
from .build import build_next_page_book

QUERIES: dict = {}


def register(fn):
    QUERIES[fn.__name__.removesuffix("_q")] = fn
    return fn


def _docs(spark, sf_dir) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


# --- 2.1 scans, sources ------------------------------------------------------

@register
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_pages(spark, sf_dir)
    return p.select("page_id", "url", "book_id", F.length("html").cast("long").alias("n_chars"))


@register
def decode_pages_q(spark, sf_dir):
    p = load_pages(spark, sf_dir).select("page_id", F.encode("html", "UTF-8").alias("content"), "html")
    d = decode_pages(p.withColumnRenamed("html", "orig"), "content")
    return d.select("page_id", "charset", F.length("html").cast("long").alias("n_chars"),
                    (F.col("html") == F.col("orig")).alias("same_text"))


# --- 2.2 projections, filters -----------------------------------------------

@register
def route_source(spark, sf_dir):
    p = load_pages(spark, sf_dir)
    return p.select("page_id", "url", U.route("url").alias("route"))


@register
def split_url(spark, sf_dir):
    p = load_pages(spark, sf_dir)
    return p.select("page_id", U.split_url_head("url").alias("base_url"),
                    U.split_url_tail("url").alias("path_part"))


@register
def absolute_links(spark, sf_dir):
    links = X.explode_links(load_pages(spark, sf_dir))
    return links.select("page_id", "pos", "href",
                        U.absolutise("href", U.split_url_head("url")).alias("abs_url"))


@register
def explode_links(spark, sf_dir):
    links = X.explode_links(load_pages(spark, sf_dir))
    return links.select("page_id", "pos", "href", "link_text")


@register
def anchors_with_href(spark, sf_dir):
    return X.anchors_with_href(X.explode_links(load_pages(spark, sf_dir))).select("page_id", "pos", "href")


@register
def link_by_text(spark, sf_dir):
    # the reference looks for its "next page" word; on these pages the nav
    # word 'the' plays that part
    return X.link_by_text(X.explode_links(load_pages(spark, sf_dir)), "the").select("page_id", "pos", "href")


@register
def explode_paragraphs(spark, sf_dir):
    return X.explode_paragraphs(load_pages(spark, sf_dir)).select("page_id", "pos", "text")


@register
def drop_blank(spark, sf_dir):
    return X.drop_blank(X.explode_paragraphs(load_pages(spark, sf_dir))).select("page_id", "pos", "text")


@register
def page_metadata(spark, sf_dir):
    return X.page_metadata(load_pages(spark, sf_dir)).drop("book_id")


@register
def title_author_split(spark, sf_dir):
    p = load_pages(spark, sf_dir).select("page_id", H.drop_scripts("html").alias("clean"))
    raw_title = H.first_or_null("clean", H.TITLE)
    title = T.unicode_strip(H.node_text(raw_title))
    t, a = X.title_author_split(title, F.lit(None).cast("string"))
    return p.select("page_id", t.alias("title"), a.alias("author"))


@register
def content_fallback(spark, sf_dir):
    return X.content_fallback(load_pages(spark, sf_dir)).drop("book_id")


# --- 2.3 generators ---------------------------------------------------------

@register
def split_paragraphs(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(T.split_pieces("text", "\n")).alias("pos", "text")) \
            .select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


@register
def chunk_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return TR.chunk_texts(d, ["doc_id"]).select("doc_id", "chunk_no", "chunk")


# --- 2.9 scalars ------------------------------------------------------------

@register
def normalize_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.normalize_text("text").alias("normalized"),
                    T.normalize_text("text", paragraph_tags=True).alias("as_paragraph"))


@register
def slug_title(spark, sf_dir):
    p = load_pages(spark, sf_dir).select("page_id", H.drop_scripts("html").alias("clean"))
    return p.select("page_id", T.slug(H.title_text("clean")).alias("slug"))


@register
def unicode_strip(spark, sf_dir):
    p = X.explode_paragraphs(load_pages(spark, sf_dir))
    return p.select("page_id", "pos", T.unicode_strip("text").alias("stripped"))


@register
def label_value(spark, sf_dir):
    # footer reads '(c) host . text': the middle dot stands in for the
    # full-width colon of the reference's "label：value" fields
    p = load_pages(spark, sf_dir).select("page_id", H.drop_scripts("html").alias("clean"))
    footer = H.node_text(H.first_or_null("clean", H.FOOTER))
    return p.select("page_id", T.label_value(footer, "·").alias("label_last"),
                    T.label_second(footer, "·").alias("label_second"))


@register
def page_number(spark, sf_dir):
    p = load_pages(spark, sf_dir)
    return p.select("page_id", U.page_number("url").alias("page_number"),
                    U.path_number("url").alias("path_number"))


@register
def strip_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.strip_tokens("text").alias("cleaned"))


@register
def declared_charset(spark, sf_dir):
    p = load_pages(spark, sf_dir)
    return p.select("page_id", declares_gbk(F.encode("html", "UTF-8")).alias("declared_gbk"),
                    H.declared_charset("html").alias("declared_charset"))


@register
def page_text(spark, sf_dir):
    p = load_pages(spark, sf_dir)
    return p.select("page_id", H.page_text("html").alias("text"))


# --- shared derivations -----------------------------------------------------


def _numbered(spark, sf_dir):
    """(book_id, page_id, url, chapter_no) per page (F1); keys only."""
    return B.number_chapters(load_pages(spark, sf_dir))


def _titles(spark, sf_dir):
    """Chapter title per page: computed where the page is, no shuffle."""
    p = load_pages(spark, sf_dir)
    return p.select("page_id", H.title_text(H.drop_scripts("html")).alias("title"))


def _chain(spark, sf_dir, num=None):
    """C6 on the test tables: (book_id, page_no, url)."""
    num = num if num is not None else _numbered(spark, sf_dir)
    edges = B.next_page_edges(num)
    ch = follow_chain(edges)
    # book of each page by its own (unique) URL, not by the chain head: a hot
    # book's head would be one key shared by a third of the rows
    books = num.select(F.col("url").alias("node"), "book_id")
    return ch.join(books, "node").select("book_id", "page_no", F.col("node").alias("url"))


def _toc_links(spark, sf_dir):
    """Contents pages (the chain) with their nav links."""
    chain = _chain(spark, sf_dir)
    links = X.nav_links(load_pages(spark, sf_dir)).select("url", "pos", "href", "link_text", "markup")
    return chain.withColumnRenamed("page_no", "toc_page").join(links, "url")


def _link_keys(spark, sf_dir):
    """Sort key of each nav link: its markup translated (G1)."""
    p = load_pages(spark, sf_dir)
    links = X.nav_links(p).join(p.select("page_id", H.html_lang("html").alias("src_lang")), "page_id")
    tr, _ = TR.translate_texts(links.select("page_id", "pos", "src_lang", F.col("markup").alias("text")),
                               ["page_id", "pos"])
    return links.join(tr.withColumnRenamed("translated_text", "sort_key"), ["page_id", "pos"], "left")


def _doc_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return TR.chunk_texts(d.withColumnRenamed("lang", "src_lang"), ["doc_id", "src_lang"])


def _memory(spark, sf_dir):
    """Translation memory derived from the corpus: glossary translations of
    the distinct chunks not already in English."""
    todo = TR.distinct_chunks(_doc_chunks(spark, sf_dir).where(F.col("src_lang") != TR.TARGET_LANG))
    return TR.glossary_translate(todo, TR.glossary_frame(spark), ["src_lang", "chunk_hash"])


def _contents(spark, sf_dir):
    """E2 over each page's non-blank paragraphs: (page_id, content), for
    pages that have any.  Array functions on the page row: no shuffle."""
    f = X.decoded_paragraphs(X.page_features(load_pages(spark, sf_dir)))
    kept = F.filter("paragraphs", lambda x: F.length(T.unicode_strip(x)) > 0)
    return (f.where(F.size(kept) > 0)
             .select("page_id", B.join_paragraph_array("paragraphs").alias("content")))


def _book_meta(spark, sf_dir, num=None):
    return B.book_metadata(load_pages(spark, sf_dir))


# --- 2.3 chains -------------------------------------------------------------

@register
def follow_next_page(spark, sf_dir):
    return _chain(spark, sf_dir)


@register
def conversation_chains(spark, sf_dir):
    """C6 on a second table: each conversation's turns as a "next" chain."""
    c = spread(read_table(spark, sf_dir, "conversations").select("conv_id", "turn"))
    node = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), node.alias("to_url"))
    edges = c.select("conv_id", "turn", node.alias("from_url")).join(nxt, ["conv_id", "turn"], "left")
    ch = follow_chain(edges.select("from_url", "to_url"))
    return ch.select(F.split("head", ":")[0].cast("long").alias("conv_id"), "page_no",
                     F.split("node", ":")[1].cast("long").alias("turn"))


@register
def chain_depths(spark, sf_dir):
    """C6 without repeated pages: every page's distance from the end of its chain."""
    forest = chain_forest(B.next_page_edges(_numbered(spark, sf_dir)))
    return forest.select(F.col("node").alias("url"), F.col("root").alias("last_url"), "depth")


@register
def paged_toc(spark, sf_dir):
    t = _toc_links(spark, sf_dir)
    n = number_within(t, ["book_id"], ["toc_page", "pos"], "link_no")
    return n.select("book_id", "link_no", "toc_page", "pos", "href", "link_text")


# --- 2.4 joins --------------------------------------------------------------

def _contents_links(spark, sf_dir, num):
    p = load_pages(spark, sf_dir)
    nav = (B.absolute(X.nav_links(p))
           .select("book_id", F.col("page_id").alias("from_page_id"), "pos", F.lit("nav").alias("kind"), "link_url"))
    edges = B.next_page_edges(num).where(F.col("to_url").isNotNull())
    nxt = (edges.join(num.select(F.col("url").alias("from_url"), F.col("page_id").alias("from_page_id")), "from_url")
                .select("book_id", "from_page_id", F.lit(None).cast("long").alias("pos"),
                        F.lit("next").alias("kind"), F.col("to_url").alias("link_url")))
    # written once: the hot-key count and the join both read it, so page
    # bodies are scanned for links a single time
    return materialize(nav.unionByName(nxt), "contents-links")


@register
def toc_join_pages(spark, sf_dir):
    num = _numbered(spark, sf_dir)
    links = _contents_links(spark, sf_dir, num)
    pages = load_pages(spark, sf_dir).select(F.col("url").alias("link_url"), F.col("page_id").alias("target_page_id"))
    return split_hot_join(links, pages, ["link_url"], "left").select(
        "book_id", "from_page_id", "pos", "kind", "link_url", "target_page_id")


@register
def missing_chapters(spark, sf_dir):
    num = _numbered(spark, sf_dir)
    links = _contents_links(spark, sf_dir, num)
    return B.missing_chapters(links, load_pages(spark, sf_dir), _contents(spark, sf_dir))


@register
def translate_lookup(spark, sf_dir):
    chunks = _doc_chunks(spark, sf_dir)
    # one distinct-chunk table: the memory's input and the hot keys of the
    # lookup (from n_uses), so documents are chunked for counting only once
    dist = materialize(TR.distinct_chunks(chunks), "distinct-chunks")
    hot = dist.where(F.col("n_uses") > HOT_ROWS).select("src_lang", "chunk_hash")
    memory = TR.glossary_translate(dist.where(F.col("src_lang") != TR.TARGET_LANG), TR.glossary_frame(spark),
                                   ["src_lang", "chunk_hash"])
    looked = TR.lookup_translations(chunks, memory, hot=hot)
    return looked.select("doc_id", "chunk_no", "translated")


@register
def glossary_override(spark, sf_dir):
    return _memory(spark, sf_dir).select("src_lang", "chunk_hash", "translated_text")


@register
def book_chapters(spark, sf_dir):
    num = _numbered(spark, sf_dir)
    books = _book_meta(spark, sf_dir, num).select("book_id", F.col("title").alias("book_title"))
    chapters = num.join(_titles(spark, sf_dir), "page_id").select(
        "book_id", "chapter_no", F.col("title").alias("chapter_title"))
    return books.join(chapters, "book_id").select("book_id", "book_title", "chapter_no", "chapter_title")


# --- 2.5 aggregations -------------------------------------------------------

@register
def reassemble_chunks(spark, sf_dir):
    c = _doc_chunks(spark, sf_dir).withColumn("translated", F.col("chunk"))
    return TR.reassemble(c, ["doc_id"], "translated", "text")


@register
def join_paragraphs(spark, sf_dir):
    return _contents(spark, sf_dir)


@register
def conditional_normalize(spark, sf_dir):
    # fragments = 500-character chunks of each document; the trigger is the
    # line break these tables carry (the reference's '\r' is absent here)
    frags = _doc_chunks(spark, sf_dir).select("doc_id", F.col("chunk_no").alias("pos"), F.col("chunk").alias("text"))
    return B.conditional_normalize(frags, ["doc_id"], trigger="\n")


@register
def assemble_book(spark, sf_dir):
    num = _numbered(spark, sf_dir)
    chapters = num.join(_titles(spark, sf_dir), "page_id").select("book_id", "chapter_no", "title")
    return B.toc_items(chapters)


@register
def distinct_chunks(spark, sf_dir):
    return TR.distinct_chunks(_doc_chunks(spark, sf_dir))


@register
def translation_savings(spark, sf_dir):
    """E5's report: chunks sent once per distinct (language, text) instead of
    once per occurrence - calls made and saved, per language."""
    d = TR.distinct_chunks(_doc_chunks(spark, sf_dir))
    return (d.groupBy("src_lang")
             .agg(F.sum("n_uses").alias("n_chunks"), F.count(F.lit(1)).alias("n_distinct"))
             .withColumn("saved_calls", F.col("n_chunks") - F.col("n_distinct")))


@register
def chapters_per_book(spark, sf_dir):
    return B.chapters_per_book(load_pages(spark, sf_dir))


# --- 2.6 windows, 2.7 sorts, 2.8 set operations -----------------------------

@register
def number_chapters(spark, sf_dir):
    return _numbered(spark, sf_dir).select("book_id", "page_id", "chapter_no")


@register
def first_occurrence(spark, sf_dir):
    links = X.nav_links(load_pages(spark, sf_dir)).select("page_id", "pos", "href")
    return B.first_occurrence(links, "page_id", "href")


@register
def order_chapters(spark, sf_dir):
    k = _link_keys(spark, sf_dir)
    w = Window.partitionBy("page_id").orderBy("sort_key", "pos")  # one contents page: bounded
    return k.select("page_id", "pos", "href", F.row_number().over(w).cast("long").alias("order_no"))


@register
def pagewise_order(spark, sf_dir):
    t = _toc_links(spark, sf_dir)
    keys = _link_keys(spark, sf_dir).select("url", "pos", "sort_key")
    t = t.join(keys, ["url", "pos"], "left").withColumn(
        "page_key", F.when(F.col("toc_page") > 1, F.col("sort_key")))
    n = number_within(t, ["book_id"], ["toc_page", "page_key", "pos"], "link_no")
    return n.select("book_id", "toc_page", "pos", "href", "link_no")


def _contents_site(spark, sf_dir):
    """Contents pages derived from the given pages: each host's pages from the
    last to the first, 20 links a page, each naming the next contents page,
    the first link of a page repeated at its end."""
    p = load_pages(spark, sf_dir).select("page_id", "url", "book_id", (-F.col("page_id")).alias("back"))
    n = number_within(p, ["book_id"], ["back"], "no").withColumn("part", F.floor((F.col("no") - 1) / 20))
    anchor = F.concat(F.lit("<li><a href='"), H.escape_html("url"), F.lit("'>Page "), F.col("no").cast("string"), F.lit("</a>"))
    parts = n.groupBy("book_id", "part").agg(F.sort_array(F.collect_list(F.struct("no", anchor.alias("a")))).alias("l"))
    listed = F.array_join(F.transform("l", lambda x: x["a"]), "")
    html = F.concat(F.lit("<html><body><nav><ul>"), listed, F.element_at("l", 1)["a"], F.lit("</ul></nav><a href=/contents-"),
                    (F.col("part") + 1).cast("string"), F.lit(">" + NEXT_PAGE_TEXT + "</a></body></html>"))
    return parts.select((F.xxhash64("book_id", "part")).alias("page_id"), F.concat(F.lit("http://"), F.col("book_id"), F.lit("/contents-"), F.col("part").cast("string")).alias("url"),
                        "book_id", html.alias("html"))


@register
def contents_order(spark, sf_dir):
    """Chapter numbers from contents lists (derived from the pages) that run over several pages."""
    order = CO.contents_order(materialize(_contents_site(spark, sf_dir), "contents-site"))
    placed = CO.chapter_pages(order, load_pages(spark, sf_dir))
    return placed.select("book_id", "chapter_no", "url", "title", "toc_page", "page_id")


@register
def build_books_by_contents(spark, sf_dir):
    """J4 with the chapters in the order of the contents lists."""
    order = CO.contents_order(materialize(_contents_site(spark, sf_dir), "contents-site"))
    return _build_books(load_pages(spark, sf_dir), _docs(spark, sf_dir), order=order)


@register
def lexical_order(spark, sf_dir):
    num = _numbered(spark, sf_dir).select("book_id", "chapter_no",
                                          M.chapter_file_name("chapter_no").alias("file_name"))
    n = number_within(num, ["book_id"], ["file_name"], "lexical_no")
    return n.select("book_id", "chapter_no", "file_name", "lexical_no")


@register
def append_links(spark, sf_dir):
    t = _toc_links(spark, sf_dir).select("book_id", "toc_page", "pos", "href")
    return t.where(F.col("toc_page") == 1).unionByName(t.where(F.col("toc_page") > 1))


# --- 2.9 markup -------------------------------------------------------------

@register
def chapter_html(spark, sf_dir):
    num = _numbered(spark, sf_dir)
    f = X.decoded_paragraphs(X.page_features(load_pages(spark, sf_dir)))
    kept = F.filter("paragraphs", lambda x: F.length(T.unicode_strip(x)) > 0)
    j = num.select("page_id", "book_id", "chapter_no").join(f.select("page_id", "title", M.paragraphs_html(kept).alias("body")), "page_id")
    return j.select("book_id", "chapter_no", M.chapter_html("title", "body").alias("chapter_html"))


@register
def title_page(spark, sf_dir):
    meta = _book_meta(spark, sf_dir)
    return meta.select("book_id", M.title_page_html("title", "author").alias("title_page"))


# --- 2.10 language and translation ------------------------------------------

def _article_texts(spark, sf_dir):
    p = load_pages(spark, sf_dir)
    return p.select("page_id", H.node_text(F.coalesce(H.article(H.drop_scripts("html")), F.lit(""))).alias("text"),
                    H.html_lang("html").alias("html_lang"))


@register
def detect_language(spark, sf_dir):
    model = LG.train(_docs(spark, sf_dir))
    texts = _article_texts(spark, sf_dir)
    det = LG.detect(texts, model, "page_id")
    return det.join(texts.select("page_id", "html_lang"), "page_id")


@register
def translate_documents(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumnRenamed("lang", "src_lang")
    return TR.translate_rows(d, ["doc_id"])


@register
def apply_corrections(spark, sf_dir):
    mem = _memory(spark, sf_dir)
    t = F.col("translated_text")
    first = F.substring(t, 1, 1)
    fix1 = (mem.where(t.contains("\n"))
               .select("src_lang", "chunk_hash", T.normalize_text(t).alias("translated_text"),
                       F.lit(1).alias("priority")))
    fix2 = (mem.where(first.rlike("^[a-z]$"))
               .select("src_lang", "chunk_hash",
                       F.concat(F.upper(first), F.substring(t, 2, 1 << 30)).alias("translated_text"),
                       F.lit(2).alias("priority")))
    return TR.apply_corrections(mem, fix1.unionByName(fix2))


# --- sources / sinks / job / nodes / stream ---------------------------------


@register
def landing_roundtrip(spark, sf_dir):
    html = load_pages(spark, sf_dir).select("page_id", "html")
    num = _numbered(spark, sf_dir).join(html, "page_id").select(
        "book_id", (F.col("chapter_no") - 1).alias("idx"), "url", "html")
    path = scratch_path(spark, "landing")
    write_landing(num, path)
    back = read_landing(spark, path)
    return back.select("book_id", "idx", "url", M.page_file_name("idx").alias("file_name"),
                       F.length("html").cast("long").alias("n_chars"))


@register
def build_books(spark, sf_dir):
    return _build_books(load_pages(spark, sf_dir), _docs(spark, sf_dir))


@register
def build_books_by_rules(spark, sf_dir):
    """J4 with title/body taken from the route's selector rules (C1 + D4)
    instead of the regex fast path: the form that serves any site the rule
    table describes.  Same result on these pages by construction."""
    return _build_books(load_pages(spark, sf_dir), _docs(spark, sf_dir), extraction="rules")


@register
def chapter_files(spark, sf_dir):
    path = scratch_path(spark, "chapters")
    SK.write_chapter_files(_build_books(load_pages(spark, sf_dir), _docs(spark, sf_dir)), path)
    return SK.read_chapter_files(spark, path).select("book_id", "file_name", "chapter_html")


@register
def book_export(spark, sf_dir):
    num = _numbered(spark, sf_dir)
    books = _book_meta(spark, sf_dir, num).join(B.chapters_per_book(num), "book_id")
    path = scratch_path(spark, "books")
    SK.export_books(books, path)
    return SK.read_books(spark, path)


@register
def book_parts(spark, sf_dir):
    """A5 whole: navigation, title page and chapters of every book, written in order and read back."""
    pages = load_pages(spark, sf_dir)
    chapters = materialize(_build_books(pages, _docs(spark, sf_dir)), "book-chapters")
    path = scratch_path(spark, "book-parts")
    SK.write_book_parts(SK.book_parts(chapters, _book_meta(spark, sf_dir)), path)
    return SK.read_book_parts(spark, path).select("book_id", "part_no", "kind", "file_name", "title", "content")


@register
def translated_metadata(spark, sf_dir):
    """B4 + J1 + J2 per book: title, author and description translated from the description's language."""
    return B.translated_metadata(_book_meta(spark, sf_dir), LG.train(_docs(spark, sf_dir)))


@register
def html_nodes(spark, sf_dir):
    n = ND.html_nodes(load_pages(spark, sf_dir))
    return n.select("page_id", F.col("pos").cast("long").alias("pos"), "tag")


@register
def tag_counts(spark, sf_dir):
    n = ND.html_nodes(load_pages(spark, sf_dir))
    return n.groupBy("tag").agg(F.count(F.lit(1)).alias("n_nodes"))


@register
def apply_rules(spark, sf_dir):
    n = ND.html_nodes(load_pages(spark, sf_dir))
    return ND.apply_rules(n, ND.rules_frame(spark)).select("page_id", "field", "n_nodes", "first_text")


@register
def stream_ingest(spark, sf_dir):
    landed = scratch_path(spark, "ingest-landed")
    ckpt = scratch_path(spark, "ingest-checkpoint")
    return ingest_pages(spark, sf_dir, landed, ckpt)


@register
def next_page_book(spark, sf_dir):
    """The "next page" site end to end on the test tables (chain = pages of a
    host in order)."""
    return build_next_page_book(_chain(spark, sf_dir), load_pages(spark, sf_dir))
