"""Extraction: pages -> paragraphs, links, metadata, content, HTML nodes.

All native regex expressions except ``html_nodes`` (a Python UDTF over the
standard library parser, for selector-style queries on the tree).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import LABEL_SEPARATOR, label_value, unicode_strip
from ..functions.urls import NEXT_PAGE_TEXT, absolutise, split_url_head


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages with scripts/styles removed once (``clean``); html dropped."""
    return pages.select("page_id", "url", "book_id", H.drop_scripts("html").alias("clean"))


def page_features(pages: DataFrame) -> DataFrame:
    """Everything the book job needs from a page, in one pass over ``html``:
    title, article text (for language detection) and the raw paragraph
    array.  The script-stripping regex runs once per page."""
    extra = [c for c in pages.columns if c not in ("page_id", "url", "book_id", "html")]
    keep = ["page_id", "url", "book_id", *extra]
    # what is used twice is a column of its own: computed once
    c = pages.select(*keep, H.drop_scripts("html").alias("clean"))
    c = c.select(*keep, "clean", H.inside("clean", "article").alias("_article"))
    c = c.select(*keep, "clean", "_article", H.strip_tags(F.array_join("_article", "\n")).alias("_text"))
    return c.select(*keep,
                    H.title_text("clean").alias("title"),
                    H.decode_entities("_text").alias("article_text"),
                    H.paragraphs_in("_article").alias("paragraphs"))


def paragraphs_of(features: DataFrame) -> DataFrame:
    """C3 from the feature table: (page_id, book_id, pos, text)."""
    return (features.select("page_id", "book_id", F.posexplode("paragraphs").alias("pos", "raw"))
                    .select("page_id", "book_id", F.col("pos").cast("long").alias("pos"),
                            H.decode_entities("raw").alias("text")))


def decoded_paragraphs(features: DataFrame) -> DataFrame:
    """Feature rows with the paragraph array entity-decoded (still one row per page)."""
    return features.withColumn("paragraphs", F.transform("paragraphs", H.decode_entities))


def explode_paragraphs(pages: DataFrame) -> DataFrame:
    """Whole text of each <p> inside <article>, in order (blank kept).
    Unused feature columns are pruned by Catalyst."""
    return paragraphs_of(page_features(pages))


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop fragments that are empty after a Unicode strip."""
    return df.where(F.length(unicode_strip(col)) > 0)


def _links(c: DataFrame) -> DataFrame:
    arr = c.select("page_id", "url", "book_id",
                   H.anchor_attrs("clean").alias("attrs"), H.anchor_inner("clean").alias("inner"))
    ex = arr.select("page_id", "url", "book_id",
                    F.posexplode(F.arrays_zip("attrs", "inner")).alias("pos", "a"))
    return ex.select(
        "page_id", "url", "book_id", F.col("pos").cast("long").alias("pos"),
        H.href_of("a.attrs").alias("href"),
        unicode_strip(H.node_text("a.inner")).alias("link_text"),
        F.concat(F.lit("<a"), F.col("a.attrs"), F.lit(">"), F.col("a.inner"), F.lit("</a>")).alias("markup"))


def explode_links(pages: DataFrame) -> DataFrame:
    """Every <a> of a page in order: attributes, href (NULL when absent),
    text (tags removed, entities decoded, stripped) and the link markup."""
    return _links(clean_pages(pages))


def nav_links(pages: DataFrame) -> DataFrame:
    """Contents links of the test pages: the <a> inside every <nav>."""
    return _links(clean_pages(pages).withColumn("clean", F.array_join(H.inside("clean", "nav"), "</a>")))


def anchors_with_href(links: DataFrame) -> DataFrame:
    """B8."""
    return links.where(F.col("href").isNotNull())


def link_by_text(links: DataFrame, label: str = NEXT_PAGE_TEXT) -> DataFrame:
    """Per page, the first link whose text equals ``label`` (default: the
    "next page" link text; ``LAST_PAGE_TEXT`` finds the last-page link)."""
    return (links.where((F.col("link_text") == label) & F.col("href").isNotNull())
                 .groupBy("page_id")
                 .agg(F.min_by("href", "pos").alias("href"), F.min("pos").alias("pos")))


def title_author_split(title, author_sel) -> tuple:
    """(title, author) from a combined 'X Author: Y' title, else the
    author selector's text."""
    t = F.col(title) if isinstance(title, str) else title
    a = F.col(author_sel) if isinstance(author_sel, str) else author_sel
    has = t.contains("Author:")
    parts = F.split(t, "Author:")
    return (F.when(has, unicode_strip(F.get(parts, 0))).otherwise(t),
            F.when(has, unicode_strip(F.get(parts, 1))).otherwise(a))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, author, description, cover URL, declared language."""
    c = pages.select("page_id", "url", "book_id", "html", H.drop_scripts("html").alias("clean"))
    footer = unicode_strip(H.node_text(H.first_or_null("clean", H.FOOTER)))
    title = H.title_text("clean")
    author_sel = F.when(footer.contains(LABEL_SEPARATOR), unicode_strip(label_value(footer)))
    t, a = title_author_split(title, author_sel)
    paras = H.paragraphs("clean")
    return c.select(
        "page_id", "book_id", t.alias("title"), a.alias("author"),
        unicode_strip(H.decode_entities(F.get(paras, 0))).alias("description"),
        absolutise(H.image_source("clean"), split_url_head("url")).alias("cover_url"),
        H.html_lang("html").alias("html_lang"))


def content_fallback(pages: DataFrame) -> DataFrame:
    """Body from the primary selector (paragraphs of <article>), else the
    fallback (the page text of <body>).  Both from the page's own row."""
    fallback = unicode_strip(H.page_text(F.coalesce(H.first_or_null("html", r"(?s)<body\b[^>]*>(.*)"), F.col("html"))))
    f = decoded_paragraphs(page_features(pages.select("page_id", "url", "book_id", "html", fallback.alias("fallback"))))
    kept = F.filter("paragraphs", lambda x: F.length(unicode_strip(x)) > 0)
    primary = F.when(F.size(kept) > 0, F.array_join(kept, "</p><p>"))
    return f.select("page_id", "book_id",
                    F.when(primary.isNotNull(), F.lit("article")).otherwise(F.lit("body")).alias("content_source"),
                    F.coalesce(primary, F.col("fallback")).alias("content"))
