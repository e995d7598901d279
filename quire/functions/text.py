"""Text scalars as Spark Columns (JVM-side, codegen-friendly).

Every function takes and returns a ``Column``; NULL in gives NULL out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Translation chunk length, in code points.
CHUNK_SIZE = 500
# Characters that Python's str.strip() removes (str.isspace), as a regex class.
WHITESPACE_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
                    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Runs of these become one space in normalize_text: CR, LF, no-break space.
NORMALIZE_RUN = r"[\r\n\x{A0}]+"
# Placeholder strings normalize_text turns into ''.
NONE_LITERAL = "None"
# Tokens removed before splitting "next page" text.
JUNK_TOKENS = ("\r", "\n", "%e5%90%bb")
# Paragraph separator of the "next page" site: two ideographic spaces.
IDEOGRAPHIC_PARAGRAPH = "　　"
# Label separator (full-width colon).
LABEL_SEPARATOR = "："
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unicode_strip(col) -> Column:
    """str.strip(): remove Unicode whitespace at both ends (``trim`` keeps U+3000)."""
    ws = WHITESPACE_CLASS
    return F.regexp_replace(_c(col), f"^{ws}+|{ws}+$", "")


def is_blank(col) -> Column:
    return ~not_blank(col)


def not_blank(col) -> Column:
    """Whether a Unicode strip leaves anything."""
    return _c(col).rlike("[^" + WHITESPACE_CLASS[1:])


def normalize_text(col, paragraph_tags: bool = False) -> Column:
    """Runs of CR/LF/NBSP -> one space, strip, 'None' or blank -> ''.
    With ``paragraph_tags`` a non-empty result is wrapped in <p>..</p>."""
    s = unicode_strip(F.regexp_replace(_c(col), NORMALIZE_RUN, " "))
    s = F.when((s == NONE_LITERAL) | (s == ""), F.lit("")).otherwise(s)
    if paragraph_tags:
        s = F.when(s == "", s).otherwise(F.concat(F.lit("<p>"), s, F.lit("</p>")))
    return s


def normalize_text_list(col, paragraph_tags: bool = False) -> Column:
    """List form: each element normalized, empties dropped, joined with ''."""
    return F.array_join(
        F.transform(_c(col), lambda x: F.coalesce(normalize_text(x, paragraph_tags), F.lit(""))),
        "")


def slug(col) -> Column:
    """File slug: every non-word character -> '_', lower case (Unicode words)."""
    return F.lower(F.regexp_replace(_c(col), r"[^\p{L}\p{N}_]", "_"))


def label_value(col, sep: str = LABEL_SEPARATOR) -> Column:
    """Text after the last separator (whole text when there is none)."""
    return F.element_at(F.split(_c(col), re.escape(sep)), -1)


def label_second(col, sep: str = LABEL_SEPARATOR) -> Column:
    """Second part after splitting on the separator; NULL when there is none."""
    return F.get(F.split(_c(col), re.escape(sep)), 1)


def strip_tokens(col, tokens=JUNK_TOKENS) -> Column:
    out = _c(col)
    for t in tokens:
        out = F.replace(out, F.lit(t), F.lit(""))
    return out


def split_pieces(col, sep: str) -> Column:
    """Array of pieces split on a literal separator (empty pieces kept)."""
    return F.split(_c(col), re.escape(sep), -1)


def chunk_starts(col, size: int = CHUNK_SIZE) -> Column:
    """0-based chunk numbers of a text; empty or NULL text has none."""
    n = F.length(_c(col))
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))


def chunk_at(col, chunk_no, size: int = CHUNK_SIZE) -> Column:
    return F.substring(_c(col), _c(chunk_no) * size + 1, size)


def chunk_hash(col) -> Column:
    return F.sha2(_c(col), 256)
