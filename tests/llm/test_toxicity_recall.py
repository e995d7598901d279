"""Operator 2: toxic recall and clean retention apart, on ids it was not fitted on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity


@pytest.mark.parametrize("sf, recall, retention", [("sf0.01", 0.74, 0.99), ("sf0.1", 0.95, 0.998)])
def test_recall_and_retention(spark, sf, recall, retention):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    y = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("y"))
    model = toxicity.fit(docs, y.where("doc_id % 2 = 0").withColumnRenamed("y", "toxic"))
    got = toxicity.score(docs, model).join(y.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic, clean = [r.toxic for r in got if r.y == 1], [not r.toxic for r in got if r.y == 0]
    print(sf, "features", len(model.index), "toxic", len(toxic), "missed", len(toxic) - sum(toxic), "clean", len(clean), "rejected", len(clean) - sum(clean))
    assert sum(toxic) >= recall * len(toxic)
    assert sum(clean) >= retention * len(clean)
