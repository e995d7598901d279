"""Pages -> ordered, translated chapters of every book at once.

A1 pages -> F1 chapter numbers (skew-safe) -> C3/B7 paragraphs -> E3/E2
paragraphs -> J1 language per page -> J2 translation of the title and each
paragraph (distinct chunks only, glossary translator) -> I5 chapter markup,
every paragraph escaped in its own <p>.
One lazy plan apart from the materialised numbering and the language
model; shuffles at the numbering, the chunk dedupe/lookup and the re-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markup as M
from ..functions import text as T
from ..operators import books as B
from ..operators import extract as X
from ..operators import language as LG
from ..operators import translate as TR
from ..operators.contents import chapter_pages
from ..session import materialize


def build_books(pages: DataFrame, training_docs: DataFrame, glossary: DataFrame | None = None,
                memory: DataFrame | None = None, translator=None, extraction: str = "regex",
                rules: DataFrame | None = None, order: DataFrame | None = None,
                model: LG.TrigramModel | None = None, memory_out: str | None = None) -> DataFrame:
    """``order`` (book_id, chapter_no, url), as ``contents.contents_order``
    gives it, numbers the chapters and says which pages are any; without it
    every page is a chapter, in page order.  ``model`` is a kept language model
    (else one is trained on ``training_docs``).  Chunks translated in this run
    are appended to the table ``memory_out``; read back as ``memory``, a second
    run on the same texts calls no translator.

    ``extraction='regex'`` reads title/body with native regexes (fast
    path, for <article>/<h1>/<p> pages); ``'rules'`` takes them from the
    route's selector rules over the HTML-node UDTF (any site in the rules)."""
    if extraction == "rules":
        from ..operators.nodes import rule_features
        feats = rule_features(pages, rules)
    else:
        feats = X.page_features(pages)
    # one scan of the page bodies; every branch below reads this narrow table.
    # E2/E3 on each page's own paragraph array: no shuffle (trigger '\r' as in the reference)
    feats = materialize(B.paragraph_pieces(feats), "page-features")
    if order is not None:
        chapters = chapter_pages(order.select("book_id", "chapter_no", "url"), feats.select("url", "page_id")).where(F.col("page_id").isNotNull())
        num = materialize(chapters.select("page_id", "book_id", "chapter_no"), "chapters")
        feats = feats.join(num.select("page_id").distinct(), "page_id", "left_semi")
    else:
        num = B.number_chapters(feats).select("page_id", "book_id", "chapter_no")
    art = feats.select("page_id", F.col("article_text").alias("text"))
    # one small row per page, used twice below: written once to the shared folder
    langs = materialize(LG.detect(art, model or LG.train(training_docs), "page_id", out_col="src_lang"), "page-langs")
    # text 0 is the title, the others the paragraphs: each is translated by itself
    texts = (feats.select("page_id", F.concat(F.array("title"), F.col("pieces")).alias("texts")).join(langs, "page_id", "left")
                  .select("page_id", "src_lang", F.posexplode("texts").alias("para_no", "text")))
    tr, fresh = TR.translate_texts(texts, ["page_id"], glossary=glossary, memory=memory, translator=translator, para_col="para_no")
    if memory_out:
        fresh.write.mode("append").parquet(memory_out)
    title = F.get(F.filter("paragraphs", lambda x: x["para"] == 0), 0)["text"]
    body = F.transform(F.filter("paragraphs", lambda x: x["para"] > 0), lambda x: x["text"])
    wide = tr.select("page_id", title.alias("t_title"), M.paragraphs_html(body).alias("t_body"))
    j = num.join(langs, "page_id", "left").join(wide, "page_id", "left")
    return j.select("book_id", "chapter_no", "page_id", "src_lang", F.col("t_title").alias("title"),
                    M.chapter_file_name("chapter_no").alias("file_name"),
                    M.chapter_html("t_title", "t_body").alias("chapter_html"))


def build_next_page_book(chain: DataFrame, pages: DataFrame, glossary: DataFrame | None = None,
                         translator=None) -> DataFrame:
    """The "next page" site's flow: pages in chain order; each page's body
    text has junk tokens removed, is split on two ideographic spaces, every
    non-empty piece is translated (distinct chunks once), the pieces become
    paragraphs in order, escaped, and the page is rendered as "Page n".  ``chain`` is
    (book_id, page_no, url); ``pages`` (page_id, url, html)."""
    clean = pages.select("page_id", "url", H.html_lang("html").alias("src_lang"), H.drop_scripts("html").alias("clean"))
    text = clean.select("page_id", "url", "src_lang", H.strip_tags(F.array_join(H.inside("clean", "article"), "\n")).alias("text"))
    body = text.select("page_id", "url", "src_lang", T.strip_tokens(H.decode_entities("text")).alias("body"))
    pieces = (body.select("page_id", "src_lang",
                          F.posexplode(T.split_pieces("body", T.IDEOGRAPHIC_PARAGRAPH)).alias("piece_no", "text"))
                  .where(F.col("text") != ""))
    # read twice (distinct chunks, their uses): page bodies are read once
    pieces = materialize(pieces, "page-pieces")
    tr, _ = TR.translate_texts(pieces, ["page_id"], glossary=glossary, translator=translator, para_col="piece_no")
    joined = tr.select("page_id", M.paragraphs_html(F.transform("paragraphs", lambda x: x["text"])).alias("content"))
    j = (chain.join(body.select("page_id", "url"), "url")
              .join(joined, "page_id", "left"))
    return j.select("book_id", "page_no", M.numbered_page_file_name("page_no").alias("file_name"),
                    M.fill(M.PAGE_TEMPLATE, page_no=F.col("page_no").cast("string"),
                           body=F.coalesce("content", F.lit(""))).alias("page_html"))
