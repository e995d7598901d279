"""A training corpus from ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next stage's
docs.  All but the last return the columns they were given; the last one adds
the token ids.  ``labels`` of the input folder train the two classifiers.

Defined results: an empty table stays empty; rows with a null doc_id or text
are judged as empty texts are (too short for the quality rules); repeated
rows are one group to the join stage; the mix may take a document up to three
times, and each time is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, ngram_join, quality, toxicity
from quire.llm.common import read
from quire.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row of the mix."""
    named = docs.select(F.struct("doc_id", "source").alias("row"), "text")
    coded = bpe.encode(named, id_col="row")
    return coded.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("bpe encoding", tokenize),
]

# the classifiers, the tokenizer and the grouping have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
