"""J2 over a table: the target language stays where it lies, occurrences travel as hashes."""

import re

from quire.operators import translate as TR

SCHEMA = "doc_id long, src_lang string, text string"


def upper(texts, lang):
    return texts.str.upper()


def test_rows_keep_their_language(spark):
    long_en, long_fr = "a" * 500 + "b" * 3, "c" * 500 + "d" * 3
    rows = [(1, "en", "stay"), (2, "fr", "go"), (3, None, "who"), (4, "en", None), (5, "en", ""), (6, "fr", ""), (7, "fr", None),
            (8, "en", long_en), (9, "fr", long_fr), (10, "de", "go"), (11, "fr", "go")]
    got = {r.doc_id: r.translated_text for r in TR.translate_rows(spark.createDataFrame(rows, SCHEMA), ["doc_id"], translator=upper).collect()}
    assert got == {1: "stay", 2: "GO", 3: "WHO", 4: None, 5: None, 6: None, 7: None, 8: "a" * 500 + " bbb", 9: "C" * 500 + " DDD", 10: "GO", 11: "GO"}
    # the same as through the chunks
    tr, _ = TR.translate_texts(spark.createDataFrame(rows, SCHEMA), ["doc_id"], translator=upper)
    assert {r.doc_id: r.translated_text for r in tr.collect()} == {k: v for k, v in got.items() if v is not None}


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, "en", "one"), (1, "en", "two"), (1, "en", "one")]
    got = TR.translate_rows(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()
    assert sorted(r.translated_text for r in got) == ["one", "one", "two"]
    assert TR.translate_rows(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_second_run_calls_no_translator(spark):
    def never(texts, lang):
        raise AssertionError("called")

    df = spark.createDataFrame([(k, "fr", f"mot {k % 3}") for k in range(9)] + [(9, "en", "word"), (10, None, "x")], SCHEMA)
    first = TR.translate_rows(df, ["doc_id"], translator=upper).collect()
    _, memory = TR.translate_texts(df, ["doc_id"], translator=upper)
    memory = spark.createDataFrame(memory.collect(), memory.schema)
    assert memory.count() == 4
    assert sorted(TR.translate_rows(df, ["doc_id"], translator=never, memory=memory).collect()) == sorted(first)


def test_texts_are_not_shuffled_per_occurrence(spark):
    df = spark.createDataFrame([(k, "fr", f"mot {k}") for k in range(50)] + [(k, "en", f"word {k}") for k in range(50, 60)], SCHEMA)
    # the tables of a test would be broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = TR.translate_rows(df, ["doc_id"])
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # columns that each exchange on the lookup's key moves
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\(src_lang", plan)
    uses = [re.sub(r"#\d+L?", "", c).split(", ") for c in moved if "chunk_no" in c]
    assert uses and all(set(c) == {"doc_id", "src_lang", "chunk_no", "chunk_hash"} for c in uses)
