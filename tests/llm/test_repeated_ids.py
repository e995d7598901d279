"""Operator 1: one doc_id bearing several texts."""

from __future__ import annotations

from quire.llm import ngram_join

A = " ".join(f"apple{k}" for k in range(60))
B = " ".join(f"berry{k}" for k in range(60))
C = " ".join(f"cedar{k}" for k in range(60))


def test_texts_of_one_id(spark):
    # 5 bears A and B; 7 has A but for its last word, 9 has B, 3 has C and 8 bears C and nearly B
    rows = [(5, A, "x"), (5, B, "y"), (7, A + " more", "z"), (9, B, "z"), (3, C, "z"), (8, C, "z"), (8, B + " more", "z"), (5, A, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join.join(df).collect())
    assert got == [(3, 3, 1, True), (5, 5, 2, True), (5, 5, 2, True), (5, 5, 2, True), (7, 5, 2, False), (8, 3, 1, False), (8, 5, 2, False), (9, 5, 2, False)]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(3, C, "z"), (5, A, "x"), (5, B, "y")]


def test_other_text_of_an_id_loses_nothing(spark):
    # 4 is a copy of 2's text once and has a text of its own
    df = spark.createDataFrame([(2, A), (4, A), (4, B), (6, C)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.keep_one(df).collect())) == [(2, A), (4, B), (6, C)]
