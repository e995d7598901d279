"""URL scalars: routing, splitting, absolutising, page numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# --- fixed values -----------------------------------------------------------
# Source routes, tested in this order; first substring match wins.
ROUTES = (
    ("sto.cx", "sto_cx"),
    ("zhenhunxiaoshuo", "zhenhunxiaoshuo"),
    ("256wx", "256wx"),
    ("shubaowb", "shubaowb"),
)
DEFAULT_ROUTE = "generic"
# Link texts of the "next page" site: next page, last page.
NEXT_PAGE_TEXT = "下壹頁"
LAST_PAGE_TEXT = "最末頁"
# ---------------------------------------------------------------------------

HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host(col) -> Column:
    return F.regexp_extract(_c(col), HOST_PATTERN, 1)


def route(col, routes=ROUTES, default: str = DEFAULT_ROUTE) -> Column:
    """First pattern contained in the URL names the route (CASE WHEN chain)."""
    url = _c(col)
    expr = None
    for pattern, label in routes:
        cond = url.contains(pattern)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default) if expr is not None else F.lit(default)


def split_url_head(col, sep: str = "/", position: int = 3) -> Column:
    """``sep.join(url.split(sep)[:position])``."""
    return F.array_join(F.slice(F.split(_c(col), _regex_literal(sep), -1), 1, position), sep)


def split_url_tail(col, sep: str = "/", position: int = 3) -> Column:
    """``sep.join(url.split(sep)[position:])`` ('' when too few parts)."""
    parts = F.split(_c(col), _regex_literal(sep), -1)
    n = F.size(parts)
    return F.when(n > position,
                  F.array_join(F.slice(parts, position + 1, n - position), sep)).otherwise(F.lit(""))


def absolutise(href, base) -> Column:
    """Absolute hrefs are kept; relative ones are appended to the base URL."""
    h = _c(href)
    return F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h).otherwise(F.concat(_c(base), h))


def page_number(col) -> Column:
    """``href.split('-')[2].split('.')[0]``; NULL when there are too few parts."""
    return F.get(F.split(F.get(F.split(_c(col), "-", -1), 2), r"\.", -1), 0)


def path_number(col) -> Column:
    """Trailing number of the URL path (before any ?query, #fragment or suffix)."""
    return F.regexp_extract(_c(col), r"/([0-9]+)(?:\.[a-z]+)?/?(?:[?#]|$)", 1)


def _regex_literal(s: str) -> str:
    import re
    return re.escape(s)
