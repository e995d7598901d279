"""Translation memory (hit, miss, empty), glossary override, corrections,
reassembly, and the pluggable pandas translator."""

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import translate as TR


def test_lookup_hit_miss_empty_and_reassemble(spark):
    chunks = spark.createDataFrame(
        [(1, "fr", 0, "bonjour"), (1, "fr", 1, "monde"), (1, "fr", 2, "vide"), (2, "fr", 0, "vide")],
        "doc_id int, src_lang string, chunk_no long, chunk string")
    mem = spark.createDataFrame(
        [("fr", "bonjour", "hello"), ("fr", "vide", "")], "src_lang string, source_text string, translated_text string"
    ).withColumn("chunk_hash", F.sha2("source_text", 256))
    looked = TR.lookup_translations(chunks, mem)
    got = {(r["doc_id"], r["chunk_no"]): r["translated"] for r in looked.collect()}
    assert got == {(1, 0): "hello", (1, 1): "monde", (1, 2): "", (2, 0): ""}
    back = {r["doc_id"]: r["text"] for r in TR.reassemble(looked, ["doc_id"], "translated", "text").collect()}
    assert back == {1: "hello monde"}          # empty dropped; nothing left for doc 2 -> no row
    assert 2 not in back


def test_glossary_user_row_overrides_dictionary(spark):
    g = spark.createDataFrame([("fr", "de", "of", 0), ("fr", "de", "from", 1), ("fr", "la", "the", 0)],
                              TR.GLOSSARY_SCHEMA)
    texts = spark.createDataFrame([("fr", "h1", "De la  maison, la")], "src_lang string, chunk_hash string, source_text string")
    out = TR.glossary_translate(texts, g, ["src_lang", "chunk_hash"]).first()["translated_text"]
    assert out == "from the  maison, the"


def test_corrections_latest_wins(spark):
    mem = spark.createDataFrame([("fr", "h1", "bad"), ("fr", "h2", "ok")], "src_lang string, chunk_hash string, translated_text string")
    cor = spark.createDataFrame([("fr", "h1", "better", 1), ("fr", "h1", "best", 2)],
                                "src_lang string, chunk_hash string, translated_text string, priority int")
    got = {r["chunk_hash"]: (r["translated_text"], r["corrected"]) for r in TR.apply_corrections(mem, cor).collect()}
    assert got == {"h1": ("best", True), "h2": ("ok", False)}


def test_translate_texts_sends_only_unknown_distinct_chunks(spark):
    seen = []

    def upper(texts: pd.Series, lang: str) -> pd.Series:
        seen.extend(texts.tolist())
        return texts.str.upper()

    docs = spark.createDataFrame([(1, "fr", "abc"), (2, "fr", "abc"), (3, "fr", "known"), (4, "en", "stay")],
                                 "doc_id int, src_lang string, text string")
    mem = spark.createDataFrame([("fr", "known", "KNOWN!")], "src_lang string, source_text string, translated_text string") \
        .withColumn("chunk_hash", F.sha2("source_text", 256))
    tr, fresh = TR.translate_texts(docs, ["doc_id"], memory=mem, translator=upper)
    got = {r["doc_id"]: r["translated_text"] for r in tr.collect()}
    assert got == {1: "ABC", 2: "ABC", 3: "KNOWN!", 4: "stay"}
    assert sorted(r["source_text"] for r in TR.distinct_chunks(
        TR.chunk_texts(docs, ["doc_id", "src_lang"])).collect()) == ["abc", "known", "stay"]
    assert fresh.count() == 1                   # only the one unknown distinct chunk was translated


def test_split_hot_join_equals_plain_join(spark):
    from quire.operators.skew import split_hot_join
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("c1", 1), ("c2", 2), ("miss", 3)],
                                 "k string, v int")
    right = spark.createDataFrame([("hot", "H"), ("c1", "C1"), ("c2", "C2")], "k string, r string")
    for how in ("left", "inner", "left_anti", "left_semi"):
        got = sorted(map(tuple, split_hot_join(left, right, ["k"], how, hot_rows=10).collect()))
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()))
        assert got == want, how


def test_next_page_book_splits_on_ideographic_spaces(spark):
    from quire.plans.build import build_next_page_book
    html1 = '<html lang="zh"><body><article><p>　　第一段%e5%90%bb\r\n　　第二段</p></article></body></html>'
    html2 = '<html lang="zh"><body><article><p>末頁</p></article></body></html>'
    pages = spark.createDataFrame([(1, "u1", html1), (2, "u2", html2)], "page_id long, url string, html string")
    chain = spark.createDataFrame([("b", 1, "u1"), ("b", 2, "u2")], "book_id string, page_no long, url string")

    def mark(texts, lang):
        return "[" + texts + "]"

    got = {r["page_no"]: r["page_html"] for r in build_next_page_book(chain, pages, translator=mark).collect()}
    assert got[1] == '<h1>Page 1</h1>\n<div id="1"><p>[第一段]</p><p>[第二段]</p></div>\n'
    assert got[2] == '<h1>Page 2</h1>\n<div id="2"><p>[末頁]</p></div>\n'


def test_glossary_map_and_join_paths_agree(spark, monkeypatch):
    from quire.operators import translate as TRm
    texts = spark.createDataFrame([("fr", "h1", "De la  maison, la"), ("de", "h2", "Der Hund und die Katze"),
                                   ("en", "h3", "the de la")], "src_lang string, chunk_hash string, source_text string")
    g = TRm.glossary_frame(spark)
    via_map = {r["chunk_hash"]: r["translated_text"] for r in TRm.glossary_translate(texts, g, ["src_lang", "chunk_hash"]).collect()}
    monkeypatch.setattr(TRm, "MAP_MAX_ROWS", 0)
    via_join = {r["chunk_hash"]: r["translated_text"] for r in TRm.glossary_translate(texts, g, ["src_lang", "chunk_hash"]).collect()}
    assert via_map == via_join == {"h1": "from the  maison, the", "h2": "the Hund and the Katze", "h3": "the de la"}


def test_language_detection_agrees_with_declared_lang(spark):
    import __spark_entry__ as E
    rows = E.queries()["detect_language"](spark, "/root/testdata/sf0.01").collect()
    hits = sum(1 for r in rows if r["lang"] == r["html_lang"])
    assert len(rows) == 250 and hits / len(rows) >= 0.95


def test_spread_and_hot_join_fallback(spark):
    from quire.operators.skew import split_hot_join
    from quire.sources.pages import spread
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(spark.sparkContext.defaultParallelism * 2)
    assert spread(many) is many                               # enough splits: left alone, no shuffle
    left = spark.createDataFrame([("h", i) for i in range(20)] + [("c", 0)], "k string, v int")
    right = spark.createDataFrame([("h", "H")], "k string, r string")
    got = sorted(map(tuple, split_hot_join(left, right, ["k"], "left", hot_rows=5, max_hot_keys=0).collect()))
    assert got == sorted(map(tuple, left.join(right, ["k"], "left").collect()))


def test_unknown_language_reaches_the_translator(spark):
    texts = spark.createDataFrame([(1, None, "x y"), (2, "fr", "x y"), (3, "en", "x y")], "id long, src_lang string, text string")
    tr, fresh = TR.translate_texts(texts, ["id"], translator=lambda s, lang: s + f" [{lang}]")
    assert {r["id"]: r["translated_text"] for r in tr.collect()} == {1: "x y [None]", 2: "x y [fr]", 3: "x y"}
    assert sorted(str(r["src_lang"]) for r in fresh.collect()) == ["None", "fr"]
