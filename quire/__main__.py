"""Command line: build books from a page table.

    python -m quire --pages /data/pages.parquet --training-docs /data/documents.parquet \
                    --out /data/books [--master local[8]]

Writes ``<out>/chapters`` (one folder per book: file name, chapter number,
chapter markup), ``<out>/books`` (one JSON row per book) and ``<out>/parts``
(one folder per book: navigation, title page and chapters in order).  Pages
need (page_id, url, html); training documents (text, lang) for language
detection.  Options: a glossary (lang, src, dst, priority), a translation
memory that is read and added to, corrections to it (src_lang, chunk_hash,
translated_text, priority), the extraction mode, chapter order from contents
lists, a kept language model.
"""

from __future__ import annotations

import argparse
import os

from .functions import html as H
from .functions.urls import host
from .operators import books as B
from .operators import contents as CO
from .operators import language as LG
from .operators import translate as TR
from .plans.build import build_books
from .session import drop_scratch, get_session, materialize
from .sources import sinks as SK


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="quire", description=__doc__.splitlines()[0])
    ap.add_argument("--pages", required=True)
    ap.add_argument("--training-docs", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    ap.add_argument("--glossary", help="table of lang, src, dst, priority")
    ap.add_argument("--memory", help="translation memory: read if there, new rows added")
    ap.add_argument("--corrections", help="table of src_lang, chunk_hash, translated_text, priority")
    ap.add_argument("--extraction", choices=("regex", "rules"), default="regex")
    ap.add_argument("--order", choices=("page", "contents"), default="page")
    ap.add_argument("--language-model", help="folder of a kept model; trained and kept there if absent")
    a = ap.parse_args(argv)
    spark = get_session(a.master)
    pages = spark.read.parquet(a.pages).select("page_id", "url", "html").withColumn("book_id", host("url"))
    docs = spark.read.parquet(a.training_docs).select("text", "lang")
    glossary = spark.read.parquet(a.glossary) if a.glossary else None
    memory = spark.read.parquet(a.memory) if a.memory and exists(spark, a.memory) else None
    if memory is not None:
        # written apart: this run appends to the table it reads
        memory = materialize(memory, "memory")
        if a.corrections:
            memory = TR.apply_corrections(memory, spark.read.parquet(a.corrections)).drop("corrected")
    if a.language_model and exists(spark, a.language_model):
        model = LG.load_model(spark, a.language_model)
    else:
        model = LG.train(docs)
        if a.language_model:
            LG.save_model(model, a.language_model)
    order = CO.contents_order(pages) if a.order == "contents" else None
    out = lambda name: os.path.join(a.out, name)
    SK.write_chapter_files(build_books(pages, docs, glossary=glossary, memory=memory, extraction=a.extraction, order=order, model=model, memory_out=a.memory), out("chapters"))
    written = SK.read_chapter_files(spark, out("chapters"))
    meta = B.translated_metadata(B.book_metadata(pages), model, glossary=glossary, memory=memory)
    books = meta.join(B.chapters_per_book(written), "book_id")
    SK.export_books(books, out("books"))
    # the chapter's heading, as translated
    titled = written.withColumn("title", H.decode_entities(H.first("chapter_html", H.H1)))
    SK.write_book_parts(SK.book_parts(titled, SK.read_books(spark, out("books"))), out("parts"))
    print(f"chapters: {written.count()}  books: {books.count()}  -> {a.out}")
    drop_scratch(spark)  # outputs are written; intermediates are no longer read


def exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


if __name__ == "__main__":
    main()
