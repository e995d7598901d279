"""HTML scalars as native expressions on the page's own row.

An element's extent is found by counting: its tags are picked out in order, a
running depth says which pieces of markup lie inside it, so nested elements
end where they should and unclosed ones at the end of the page.  Attributes
are read into a map, character references decoded by table.  The
``html_nodes`` UDTF (operators.nodes) is the general tree form.

Trap: every page's script holds ``var t="</p>";`` - scripts and styles are
removed before any tag is looked at.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, unicode_strip

# --- fixed values -----------------------------------------------------------
# Characters escaped when text is written into markup ('&' first).
ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
)
# Elements whose tags end an open paragraph.
BLOCKS = ("p div article section aside main nav header footer form fieldset figure figcaption address details "
          "ul ol li dl dt dd table tbody thead tr td th h1 h2 h3 h4 h5 h6 hr blockquote pre")
# References looked up before the other names.
COMMON_NAMES = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "hellip;", "mdash;", "ndash;", "rsquo;", "lsquo;", "rdquo;", "ldquo;")
# Characters markup may not hold, escaped or not.
NOT_IN_MARKUP = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
# ---------------------------------------------------------------------------

# Tag patterns are case-insensitive, as HTML is.  A tag ends at the first '>'
# outside quotes; the quantifiers give nothing back, so long tags cost no stack.
ATTRS = r"""((?:[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+)?)>"""
SCRIPT_STYLE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
TAG = r"<[^>]*>"
# A paragraph reaches to its closing tag or the next block.
WHOLE_PARAGRAPH = rf"(?is)<p{ATTRS}((?:[^<]++|<(?!/p\s*>|/?(?:{BLOCKS.replace(' ', '|')})[\s/>]))*+)"
INLINE_TAG = r"(?is)<!--.*?-->|<(?!br\b)[^>]*>"
LAST_BREAKS = r"(?i)(?:<br\b[^>]*>\s*)+\z"
BREAK = r"(?i)<br\b[^>]*>"
# A link reaches to its closing tag or the next link.
ANCHOR = rf"(?is)<a{ATTRS}(.*?)(?:</a\s*>|(?=<a[\s>])|\z)"
IMG = rf"(?is)<img{ATTRS}"
ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)?|[^&]+"
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"
FOOTER = r"(?is)<footer\b[^>]*>(.*?)</footer>"
HTML_LANG = r"""(?i)<html\b[^>]*\blang\s*=\s*"([^"]*)\""""
META_CHARSET = r"""(?i)<meta\b[^>]*\bcharset\s*=\s*"?([A-Za-z0-9_-]+)"""


def drop_scripts(col) -> Column:
    return F.regexp_replace(_c(col), SCRIPT_STYLE, "")


# --- character references -----------------------------------------------------

def _names() -> Column:
    """What each name stands for, common ones first: one string literal, made a map once when the plan is optimized."""
    names = [*COMMON_NAMES, *sorted(set(html5) - set(COMMON_NAMES))]
    return F.str_to_map(F.lit("\x1e".join(f"{n}\x1f{html5[n]}" for n in names)), F.lit("\x1e"), F.lit("\x1f"))


# The longest name that is known without its ';'.
_SHORT = max(len(n) for n in html5 if not n.endswith(";"))


def _character(number: Column) -> Column:
    """What ``&#number;`` stands for (number NULL: too large)."""
    def coded(n: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    # 128-159 stand for the characters of code page 1252 where it has one
    page = F.array(*[F.lit(bytes([k]).decode("cp1252", "ignore") or chr(k)) for k in range(0x80, 0xA0)])
    silent = (number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | number.between(0x7F, 0x9F)
              | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return (F.when(number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("�"))
             .when(number.between(0x80, 0x9F), F.get(page, (number - 0x80).cast("int")))
             .when(silent, F.lit(""))
             .otherwise(coded(number)))


def _reference(piece: Column) -> Column:
    """One piece of text: a reference decoded, or the piece as it is."""
    table = _names()
    body = F.substring(piece, 2, 1 << 20)
    digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    # more digits than any code point has: too large
    number = (F.when(piece.rlike("^&#[xX]"), F.when(F.length(digits) <= 7, F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("long")))
               .otherwise(F.when(F.length(digits) <= 8, F.conv(F.concat(F.lit("0"), digits), 10, 10).cast("long"))))
    known = [F.try_element_at(table, body)]
    # else the longest name known without ';' that it begins with
    for n in range(_SHORT, 1, -1):
        known.append(F.when(F.length(body) > n, F.concat(F.try_element_at(table, F.substring(body, 1, n)), F.substring(body, n + 1, 1 << 20))))
    return (F.when(~piece.startswith("&") | (F.length(piece) < 2), piece)
             .when(piece.startswith("&#"), _character(number))
             .otherwise(F.coalesce(*known, piece)))


def decode_entities(col) -> Column:
    """Character references decoded, all names and numbers, as HTML reads them
    in text (a name without ';' where HTML allows it)."""
    c = _c(col)
    pieces = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, _reference), "")).otherwise(c)


def escape_html(col) -> Column:
    out = _c(col)
    for ch, ent in ESCAPES:
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def markup_text(col) -> Column:
    """Text as it may stand in markup: escaped, without characters markup may not hold."""
    return escape_html(F.regexp_replace(_c(col), NOT_IN_MARKUP, ""))


def strip_tags(col) -> Column:
    return F.regexp_replace(_c(col), TAG, "")


def node_text(col) -> Column:
    """Text of a markup fragment: tags removed, entities decoded."""
    return decode_entities(strip_tags(col))


def page_text(html) -> Column:
    """Visible text of a page: scripts/styles dropped, tags removed, entities decoded."""
    return node_text(drop_scripts(html))


def first(col, pattern: str) -> Column:
    return F.regexp_extract(_c(col), pattern, 1)


def first_or_null(col, pattern: str) -> Column:
    c = _c(col)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


# --- elements -----------------------------------------------------------------

def inside(clean_html, name: str) -> Column:
    """Pieces of markup inside ``name`` elements, in page order, split where
    such an element begins or ends (array; empty without one).  The depth runs
    over the element's own tags: a nested one ends itself only, one never
    closed reaches to the end, a closing tag without an open one counts for
    nothing."""
    c = _c(clean_html)
    tag = rf"(?i)<(/?){name}{ATTRS}"
    steps = F.regexp_extract_all(c, F.lit(tag), F.lit(1))
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, t: Column) -> Column:
        d = F.when(t == "", acc["d"] + 1).otherwise(F.greatest(acc["d"] - 1, F.lit(0)))
        return F.struct(d.alias("d"), F.concat(acc["all"], F.array(d)).alias("all"))

    depth = F.aggregate(steps, start, step, lambda acc: acc["all"])
    parts = F.split(c, rf"(?i)</?{name}{ATTRS}", -1)
    # the piece after the k-th tag has the k-th depth
    after = F.arrays_zip(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("piece"), depth.alias("depth"))
    found = F.transform(F.filter(after, lambda x: x["depth"] > 0), lambda x: x["piece"])
    return F.when(c.rlike(rf"(?i)<{name}[\s/>]"), found).otherwise(F.array().cast("array<string>"))


def article(clean_html) -> Column:
    """Markup of all articles of a page, in page order; NULL without one."""
    found = inside(clean_html, "article")
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def paragraphs(clean_html) -> Column:
    """Array of whole paragraph texts inside <article>: tags removed, line breaks kept."""
    return paragraphs_in(inside(clean_html, "article"))


def paragraphs_in(pieces) -> Column:
    """The same from the pieces of markup inside the articles."""
    found = F.flatten(F.transform(_c(pieces), lambda piece: F.regexp_extract_all(piece, F.lit(WHOLE_PARAGRAPH), F.lit(2))))

    def text(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, INLINE_TAG, ""), LAST_BREAKS, ""), BREAK, "\n")

    return F.transform(found, text)


def attributes(attrs) -> Column:
    """The attributes in a tag as a map: names in lower case, values without
    quotes ('' without a value), references decoded; of a name given twice the
    first counts."""
    def read(a: Column) -> Column:
        value = F.regexp_replace(a, r"(?s)^[^=]*=?\s*", "")
        quoted = value.startswith('"') | value.startswith("'")
        value = F.when(quoted, F.substring(value, 2, F.length(value) - 2)).otherwise(value)
        return F.struct(F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"), decode_entities(value).alias("value"))

    all_ = F.transform(F.regexp_extract_all(_c(attrs), F.lit(ATTRIBUTE), F.lit(0)), read)
    names = F.transform(all_, lambda x: x["name"])
    return F.map_from_entries(F.filter(all_, lambda x, k: F.array_position(names, x["name"]) == k + 1))


def attribute(attrs, name: str) -> Column:
    """One attribute's value; NULL when the tag lacks it."""
    return F.try_element_at(attributes(attrs), F.lit(name))


def anchor_attrs(clean_html) -> Column:
    return F.regexp_extract_all(_c(clean_html), F.lit(ANCHOR), F.lit(1))


def anchor_inner(clean_html) -> Column:
    return F.regexp_extract_all(_c(clean_html), F.lit(ANCHOR), F.lit(2))


def href_of(attrs) -> Column:
    return attribute(attrs, "href")


def image_source(clean_html) -> Column:
    """``src`` of the first image; NULL without one."""
    c = _c(clean_html)
    return F.when(c.rlike(IMG), attribute(F.regexp_extract(c, IMG, 1), "src"))


def title_text(clean_html) -> Column:
    """<h1> text, falling back to <title>."""
    h1 = first_or_null(clean_html, H1)
    t = first_or_null(clean_html, TITLE)
    return unicode_strip(node_text(F.coalesce(h1, t)))


def html_lang(html) -> Column:
    return first_or_null(html, HTML_LANG)


def declared_charset(html) -> Column:
    return F.lower(first_or_null(html, META_CHARSET))
