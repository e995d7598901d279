"""Books: chapters in order, contents links, joins, assembly, export.

Test-table stand-ins (SURVEY 2 / 7.4): book = URL host, chapter = page,
chapter order = page_id, contents links = <nav> links, next page = next
page of the same host, body = <article> paragraphs, title = <h1>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import urls as U
from pyspark.sql import Column

from ..functions.text import normalize_text, not_blank, unicode_strip
from .numbering import number_within
from .skew import split_hot_join


def number_chapters(pages: DataFrame) -> DataFrame:
    """chapter_no 1..n per book in page order (skew-safe numbering).
    Only keys go through the sort and the written table - never the page
    body; callers join per-page results back on page_id."""
    keys = pages.select("book_id", "page_id", "url")
    return number_within(keys, ["book_id"], ["page_id"], "chapter_no")


def next_page_edges(numbered: DataFrame) -> DataFrame:
    """Per book, page n links to page n+1 (the last page has no next):
    a self-join on (book_id, chapter_no + 1) - unique keys, no hot group."""
    a = numbered.select("book_id", "chapter_no", F.col("url").alias("from_url"))
    b = numbered.select("book_id", (F.col("chapter_no") - 1).alias("chapter_no"), F.col("url").alias("to_url"))
    return a.join(b, ["book_id", "chapter_no"], "left").select("book_id", "from_url", "to_url")


def join_paragraphs(paras: DataFrame, key_cols=("page_id",), sep: str = M.PARAGRAPH_JOIN,
                    out_col: str = "content") -> DataFrame:
    """Fragments joined with '</p><p>' in order (one group = one page)."""
    keys = list(key_cols)
    return (paras.groupBy(*keys)
                 .agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_ps"))
                 .select(*keys, F.array_join(F.transform("_ps", lambda x: x["text"]), sep).alias(out_col)))


def conditional_normalize(fragments: DataFrame, key_cols, trigger: str = "\r") -> DataFrame:
    """Fragments are split on ``trigger``, '' and '\\n' pieces dropped,
    the rest joined with '</p><p>'; if any fragment held the trigger the whole
    chapter is normalized (and wrapped in <p>), else it is left as joined."""
    keys = list(key_cols)
    import re
    flag = fragments.groupBy(*keys).agg(F.bool_or(F.col("text").contains(trigger)).alias("normalized"))
    pieces = (fragments.select(*keys, "pos", F.posexplode(F.split("text", re.escape(trigger), -1)).alias("sub", "piece"))
                       .where((F.col("piece") != "") & (F.col("piece") != "\n")))
    joined = (pieces.groupBy(*keys)
                    .agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "piece"))).alias("_ps"))
                    .select(*keys, F.array_join(F.transform("_ps", lambda x: x["piece"]), M.PARAGRAPH_JOIN)
                            .alias("joined")))
    j = flag.join(joined, keys, "left")
    return j.select(*keys, "normalized",
                    F.when(F.col("normalized"), normalize_text(F.coalesce("joined", F.lit("")), True))
                     .otherwise(F.coalesce("joined", F.lit(""))).alias("content"))


def join_paragraph_array(arr) -> Column:
    """E2 on one row's own fragments (array): non-blank ones joined with
    '</p><p>'.  No shuffle - the fragments never leave their row."""
    kept = F.filter(_col(arr), lambda x: F.length(unicode_strip(x)) > 0)
    return F.array_join(kept, M.PARAGRAPH_JOIN)


def conditional_normalize_array(arr, trigger: str = "\r") -> tuple[Column, Column]:
    """E3 on one row's own fragments: (normalized flag, content), same rule
    as ``conditional_normalize`` but as array functions on the row."""
    import re
    kept = F.filter(_col(arr), lambda x: F.length(unicode_strip(x)) > 0)
    flag = F.exists(kept, lambda x: x.contains(trigger))
    pieces = F.filter(F.flatten(F.transform(kept, lambda x: F.split(x, re.escape(trigger), -1))),
                      lambda p: (p != "") & (p != "\n"))
    joined = F.array_join(pieces, M.PARAGRAPH_JOIN)
    return flag, F.when(flag, normalize_text(joined, True)).otherwise(joined)


def paragraph_pieces(rows: DataFrame, paragraphs: str = "paragraphs", out_col: str = "pieces", trigger: str = "\r") -> DataFrame:
    """E3 with the paragraphs kept apart, in place of the array ``paragraphs``:
    its non-blank fragments, references decoded, split on ``trigger``, '' and
    '\\n' pieces dropped; if any fragment held the trigger, every piece is
    normalized.  Each step is a column of its own: computed once."""
    import re
    from ..functions.html import decode_entities
    rest = [c for c in rows.columns if c != paragraphs]
    said = rows.select(*rest, F.transform(paragraphs, decode_entities).alias("_said"))
    kept = said.select(*rest, F.filter("_said", not_blank).alias("_kept"))
    split = F.filter(F.flatten(F.transform("_kept", lambda x: F.split(x, re.escape(trigger), -1))), lambda p: (p != "") & (p != "\n"))
    cut = kept.select(*rest, F.exists("_kept", lambda x: x.contains(trigger)).alias("_cut"), split.alias("_pieces"))
    clean = F.filter(F.transform("_pieces", lambda p: normalize_text(p)), lambda p: p != "")
    return cut.select(*rest, F.when(F.col("_cut"), clean).otherwise(F.col("_pieces")).alias(out_col))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_occurrence(items: DataFrame, list_col: str, value_col: str, pos_col: str = "pos") -> DataFrame:
    """``list.index(value)`` - duplicates share the first position.
    The window's group is one list (one page), so it is bounded."""
    w = Window.partitionBy(list_col, value_col)
    return items.withColumn("first_pos", F.min(pos_col).over(w))


def missing_chapters(links: DataFrame, pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Contents links with no page, and pages with no content."""
    # a link target shared by every page (home, index) is a hot key
    no_page = (split_hot_join(links, pages.select(F.col("url").alias("link_url")), ["link_url"], "left_anti")
                    .select("book_id", F.col("link_url").alias("url"), F.lit("no page").alias("reason")))
    empty = (pages.join(contents.where(F.col("content").isNotNull() & (F.col("content") != ""))
                               .select("page_id"), "page_id", "left_anti")
                  .select("book_id", "url", F.lit("no content").alias("reason")))
    return no_page.unionByName(empty)


def toc_items(chapters: DataFrame) -> DataFrame:
    """Navigation rows per book - item 0 'nav', item 1 the title page,
    then chapters in order.  Rows, not one array per book: a book with a
    third of all chapters is never gathered into one value."""
    books = chapters.select("book_id").distinct()
    head = (books.select("book_id", F.lit(0).cast("long").alias("item_no"), F.lit(M.NAV_ITEM).alias("file_name"),
                         F.lit(None).cast("string").alias("title"), F.lit(False).alias("in_spine"))
                 .unionByName(books.select("book_id", F.lit(1).cast("long").alias("item_no"),
                                           F.lit(M.TITLE_PAGE_FILE).alias("file_name"),
                                           F.lit("Title page").alias("title"), F.lit(True).alias("in_spine"))))
    ch = chapters.select("book_id", (F.col("chapter_no") + 1).alias("item_no"),
                         M.chapter_file_name("chapter_no").alias("file_name"), "title",
                         F.lit(True).alias("in_spine"))
    return head.unionByName(ch)


def chapters_per_book(chapters: DataFrame) -> DataFrame:
    """E6."""
    return chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chapters"))


def absolute(links: DataFrame) -> DataFrame:
    return links.withColumn("link_url", U.absolutise("href", U.split_url_head("url")))


def translated_metadata(meta: DataFrame, model, glossary: DataFrame | None = None, memory: DataFrame | None = None, translator=None) -> DataFrame:
    """Book metadata in the target language: the description's language is
    detected (``model``: ``language.train``) and kept as ``language_code``;
    title, author and description are translated from it.  A field without
    text stays NULL; a book without description keeps its declared code."""
    from . import language as LG
    from . import translate as TR
    said = meta.where(F.length(unicode_strip(F.coalesce("description", F.lit("")))) > 0).select("book_id", F.col("description").alias("text"))
    code = LG.detect(said, model, "book_id", out_col="detected")
    m = meta.join(code, "book_id", "left").withColumn("language_code", F.coalesce("detected", "language_code")).drop("detected")
    fields = ("title", "author", "description")
    texts = m.select("book_id", F.col("language_code").alias("src_lang"), F.posexplode(F.array(*fields)).alias("part", "text"))
    tr, _ = TR.translate_texts(texts, ["book_id"], glossary=glossary, memory=memory, translator=translator, para_col="part")
    got = lambda k: F.get(F.filter("paragraphs", lambda x: x["para"] == k), 0)["text"]
    return m.drop(*fields).join(tr.select("book_id", *[got(k).alias(f) for k, f in enumerate(fields)]), "book_id", "left").select(meta.columns)


def book_metadata(pages: DataFrame) -> DataFrame:
    """B4 per book: metadata of each book's first page.  The first page is
    picked with a partial aggregate (min_by), not a sort of the whole book."""
    from .extract import page_metadata
    first = (pages.groupBy("book_id").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("f"))
                  .select("book_id", "f.page_id", "f.url", "f.html"))
    return page_metadata(first).select("book_id", "title", "author", "description", "cover_url",
                                       F.col("html_lang").alias("language_code"))
