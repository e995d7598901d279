"""Operator 11: the sums by enumeration, held-out accuracy, code-switched text, edge rows."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language_crf as crf

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, n_words int, labels string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return crf.fit(docs.where(~crf.held_out(F.col("doc_id"))))


def test_sums_are_the_enumeration():
    r = np.random.default_rng(3)
    sizes, k = [4, 1, 6, 2], 3
    cut = np.append(0, np.cumsum(sizes))
    psi, first, move = r.random((cut[-1], k)) + 0.1, r.random(k) + 0.1, r.random((k, k)) + 0.1
    p = crf.forward_backward(psi, cut, first, move)[2]
    for lo, n in zip(cut, sizes):
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            weight = first[y[0]] * np.prod([psi[lo + t, y[t]] for t in range(n)]) * np.prod([move[y[t - 1], y[t]] for t in range(1, n)])
            for t in range(n):
                want[t, y[t]] += weight
        assert np.allclose(p[lo : lo + n], want / want.sum(1, keepdims=True))


def test_held_out_accuracy(docs, model):
    got = crf.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_words(docs, model, spark):
    """Sentences made of held-out pieces of two languages, without a mark between."""
    rows = docs.where(crf.held_out(F.col("doc_id")) & (F.length("text") > 600)).select("lang", "text").collect()
    words = {}
    for r in rows:
        words.setdefault(r.lang, []).extend([w for w in r.text.replace("\n", " ").split() if w.strip(".,").isalpha()][3:60])
    langs = sorted(words)
    mixed, want = [], []
    for k in range(60):
        a, b = langs[k % len(langs)], langs[(k + 1 + k // len(langs) % (len(langs) - 1)) % len(langs)]
        parts = [(x, [w.strip(".,").lower() for w in words[x][12 * k % 400 : 12 * k % 400 + 10]]) for x in (a, b)]
        mixed.append((k, " ".join(w for _, p in parts for w in p)))
        want.append([x for x, p in parts for _ in p])
    runs = crf.label_runs(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    right = total = 0
    for k, text in mixed:
        own = sorted((r for r in runs if r.doc_id == k), key=lambda r: r.run)
        assert [r.run for r in own] == list(range(len(own))) and " ".join(r.text for r in own) == text
        got = [r.lang for r in own for _ in range(r.n_words)]
        assert len(got) == len(want[k])
        right += sum(g == w for g, w in zip(got, want[k]))
        total += len(got)
    assert right >= 0.93 * total


def test_labels_are_never_inputs(docs, model):
    some = docs.where("doc_id < 200")
    other = some.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in crf.identify(df, model).collect())
    assert key(some) == key(other)


def test_language_edges(spark, model):
    long = "the and of " * 40_000
    rows = [(1, None, "en"), (2, "", "en"), (3, long, None), (None, "the and of the", "en"), (4, "der die und", "de"), (4, "der die und", "de"), (5, " \n\t 12 ., ½ 👩 ", "fr"),
            (6, "日本語", None), (7, "é", None), (8, "a" * 50_000, "en"), (9, "the. die! 12? und", "xx")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    got = crf.identify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    for k in (1, 2, 5):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert all(by[k].lang_pred in model.labels for k in (3, 6, 7, 8, 9, None))
    assert (by[3].lang_pred, by[3].n_words, by[4].lang_pred) == ("en", 120_000, "de") and by[None].held_out
    none = spark.createDataFrame([], DOCS)
    assert crf.identify(none, model).count() == 0 and crf.label_runs(none, model).count() == 0
    for nothing in (none, df.where("lang is null"), df.where("text is null"), df.where("doc_id = 5")):
        empty = crf.fit(nothing)
        assert {(r.lang_pred, r.score) for r in crf.identify(df, empty).collect()} == {("und", 0.0)}
    alone = crf.fit(df.where("doc_id = 4"))
    assert {r.lang_pred for r in crf.identify(df, alone).collect()} == {"und", "de"}
