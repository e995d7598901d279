"""quire: a Spark corpus engine - raw pages in, ordered translated books out.

Common entry points::

    from quire import get_session, load_pages, build_books
"""

from .plans.build import build_books, build_next_page_book
from .session import drop_scratch, get_session, materialize
from .sources.pages import decode_pages, load_pages, load_raw_pages, read_page_files
from .streaming.ingest import ingest_pages

__all__ = ["build_books", "build_next_page_book", "decode_pages", "drop_scratch", "get_session",
           "ingest_pages", "load_pages", "load_raw_pages", "materialize", "read_page_files"]
