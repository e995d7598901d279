"""Chapter and title-page markup (well-formed, escaped)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import markup_text
from .text import _c

# --- fixed values -----------------------------------------------------------
NOTICE = "This ebook is compiled for educational purposes only and is not to be redistributed."
UNKNOWN_AUTHOR = "Unknown"
PARAGRAPH_JOIN = "</p><p>"
TITLE_PAGE_FILE = "titlepage.html"
NAV_ITEM = "nav"
# Chapter file: heading, then the body in a div whose id is the title.
CHAPTER_TEMPLATE = '<h1>{title}</h1>\n<div id="{title}">{body}</div>\n'
# Page of the "next page" site: numbered heading, div id = page number.
PAGE_TEMPLATE = '<h1>Page {page_no}</h1>\n<div id="{page_no}">{body}</div>\n'
# Title page: title, notice, title and author lines, cover heading.
TITLE_PAGE_TEMPLATE = (
    '<html><head><title>{title}</title><meta charset="utf-8"/></head><body>'
    '<div class="title">{title}</div><div>{notice}</div><div>Title: {title}</div>'
    '<div>Author: {author}</div><div class="cover"><h1 id="titlepage">{title}</h1>'
    '<h2>by {author}</h2></div></body></html>')
# ---------------------------------------------------------------------------


def template_parts(template: str):
    """Split a '{name}' template into literal text and field names, in order."""
    import re
    out = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if piece or i % 2:
            out.append(("field" if i % 2 else "text", piece))
    return out


def fill(template: str, **fields) -> Column:
    """Template filled with Columns (one ``concat``; fields must be non-NULL)."""
    return F.concat(*[F.lit(v) if k == "text" else fields[v] for k, v in template_parts(template)])


def chapter_file_name(chapter_no) -> Column:
    return F.concat(F.lit("chapter"), _c(chapter_no).cast("string"), F.lit(".html"))


def numbered_page_file_name(page_no) -> Column:
    return F.concat(F.lit("page"), _c(page_no).cast("string"), F.lit(".html"))


def page_file_name(idx) -> Column:
    return F.concat(F.lit("page_"), _c(idx).cast("string"), F.lit(".txt"))


def paragraphs_html(texts) -> Column:
    """An array of paragraph texts as well-formed markup: each escaped, in its own <p>."""
    return F.array_join(F.transform(_c(texts), lambda x: F.concat(F.lit("<p>"), markup_text(x), F.lit("</p>"))), "")


def chapter_html(title, body_markup) -> Column:
    """Chapter markup with the title escaped (NULL-safe), well-formed."""
    t = markup_text(F.coalesce(_c(title), F.lit("")))
    return fill(CHAPTER_TEMPLATE, title=t, body=F.coalesce(_c(body_markup), F.lit("")))


def title_page_html(title, author) -> Column:
    t = markup_text(F.coalesce(_c(title), F.lit("")))
    a = markup_text(F.coalesce(_c(author), F.lit(UNKNOWN_AUTHOR)))
    return fill(TITLE_PAGE_TEMPLATE, title=t, author=a, notice=F.lit(NOTICE))
