"""Operator 2: clean texts stay clean however often they repeat themselves."""

from __future__ import annotations

import pytest

from quire.llm import toxicity

CLEAN = ("word", "word another house table river", "the green house by the old river and its stone bridge")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_repetition_tells_nothing_new(spark, sf):
    model = toxicity.fit(*[spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels")])
    texts = [(k * 3 + j, " ".join([t] * n)) for k, t in enumerate(CLEAN) for j, n in enumerate((1, 50, 30_000))]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    print(sf, {k: round(r.p_toxic, 3) for k, r in got.items()})
    assert not any(r.toxic for r in got.values())
    # from the usual length on, repetition changes nothing at all
    for k in range(len(CLEAN)):
        n = len(CLEAN[k].split())
        if 50 * n >= model.usual:
            assert abs(got[3 * k + 1].p_toxic - got[3 * k + 2].p_toxic) < 1e-9


def test_toxic_texts_stay_toxic_when_repeated(spark):
    docs, labels = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    model = toxicity.fit(docs, labels)
    some = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id").where("doc_id % 5 = 0")
    long = some.selectExpr("doc_id", "repeat(concat(text, ' '), 200) AS text")
    once, often = [{r.doc_id for r in toxicity.score(d, model).where("toxic").collect()} for d in (some, long)]
    assert once and len(once - often) <= 0.02 * len(once)
