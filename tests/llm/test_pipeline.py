"""The corpus pipeline on whole small tables and on empty ones."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_and_their_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), "t")
        assert out.columns == docs.columns
        assert out.exceptAll(docs).count() == 0 or name == "source mix"
        assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
        docs = out
        sizes.append(out.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[-1]
    assert last.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
