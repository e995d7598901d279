"""Book export in parts, translated metadata, kept memory and language model."""

from __future__ import annotations

import glob
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quire.operators import books as B
from quire.operators import language as LG
from quire.plans.build import build_books
from quire.sources import sinks as SK

DOCS = [("le chat et la souris dans la maison", "fr"), ("der hund und die katze in dem haus", "de"), ("the cat and the mouse in the house", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "text string, lang string")


def pages(spark):
    rows = [(k, f"http://{b}/{k}", b, f"<html lang=fr><h1>Le titre {k} &amp; co</h1><article><p>le chat et la souris {k}</p><p>dans la maison</p></article>") for k, b in enumerate(["a.b", "c.d", "a.b", "a.b"])]
    return spark.createDataFrame(rows, "page_id long, url string, book_id string, html string")


def test_parts_in_reading_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SK, "NAV_ITEMS", 10)
    chapters = spark.range(1, 26).select(F.lit("x").alias("book_id"), F.col("id").alias("chapter_no"), F.concat(F.lit("chapter"), F.col("id"), F.lit(".html")).alias("file_name"),
                                         F.when(F.col("id") != 3, F.concat(F.lit("T<"), F.col("id"))).alias("title"), F.lit("<p>x</p>").alias("chapter_html"))
    chapters = chapters.unionByName(chapters.where("chapter_no < 3").withColumn("book_id", F.lit("y")))
    books = spark.createDataFrame([("x", "X & co", None), ("y", None, "A")], "book_id string, title string, author string")
    path = str(tmp_path / "parts")
    SK.write_book_parts(SK.book_parts(chapters, books), path)
    got = {}
    for r in SK.read_book_parts(spark, path).orderBy("book_id", "part_no").collect():
        got.setdefault(r.book_id, []).append(r)
        ET.fromstring(r.content)
    assert [(r.part_no, r.kind) for r in got["x"]] == [(-3, "nav"), (-2, "nav"), (-1, "nav"), (0, "title"), *[(k, "chapter") for k in range(1, 26)]]
    assert [r.file_name for r in got["y"]] == ["nav0.html", "titlepage.html", "chapter1.html", "chapter2.html"]
    listed = [(a.get("href"), a.text) for r in got["x"][:3] for a in ET.fromstring(r.content).iter("a")]
    assert listed == [(f"chapter{k}.html", f"T<{k}" if k != 3 else None) for k in range(1, 26)]
    # about as many files as tasks and books together
    files = [f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions")) + 2


def test_translated_metadata(spark, docs):
    meta = B.book_metadata(pages(spark)).withColumn("language_code", F.lit("xx"))
    got = {r.book_id: r for r in B.translated_metadata(meta, LG.train(docs)).collect()}
    assert got["a.b"].language_code == "fr" and got["a.b"].title == "the titre 0 & co" and got["a.b"].description == "the chat and the souris 0" and got["a.b"].author is None
    none = meta.withColumn("description", F.lit(None).cast("string"))
    assert {r.language_code for r in B.translated_metadata(none, LG.train(docs)).collect()} == {"xx"}


def test_second_run_translates_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "memory")
    first = build_books(pages(spark), docs, translator=lambda t, lang: t.str.upper(), memory_out=path).collect()

    def never(texts, lang):
        raise AssertionError("called")

    memory = spark.read.parquet(path)
    assert memory.count() == 9  # four titles, four first paragraphs, one second one
    again = build_books(pages(spark), docs, translator=never, memory=memory).collect()
    assert sorted(again) == sorted(first) and "LE CHAT ET LA SOURIS 0" in "".join(r.chapter_html for r in first)


def test_kept_model_scores_alike(spark, docs, tmp_path):
    model = LG.train(docs)
    LG.save_model(model, str(tmp_path / "m"))
    kept = LG.load_model(spark, str(tmp_path / "m"))
    texts = spark.createDataFrame([(1, "le chat dort dans la maison"), (2, "der hund schläft"), (3, ""), (4, None), (5, "mouse in the")], "k long, text string")
    got = {r.k: r.lang for r in LG.detect(texts, model, "k").collect()}
    assert got == {r.k: r.lang for r in LG.detect(texts, kept, "k").collect()} and (got[1], got[2], got[5], len(got)) == ("fr", "de", "en", 5)
    # no exchange carries text, and a model too large to broadcast gives the same
    plan = LG.detect(texts, model, "k")._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "text" in line for line in plan.splitlines())
    kept.vocab = LG.BROADCAST_MAX_GRAMS + 1
    assert got == {r.k: r.lang for r in LG.detect(texts, kept, "k").collect()}
