"""K1: ingest queue - take new pages as they arrive, land each URL once.

A file-source stream over the page folder, ``trigger(availableNow=True)``
so it can run as a scheduled job, a checkpoint in the shared folder, and
``foreachBatch`` that anti-joins each batch against the URLs already
landed before appending.  State lives in the landed table, not in
executor memory; pages carry no event time, so there is no watermark.
A replayed batch (after a failure) finds its URLs landed and adds nothing.

The landed table is laid out by URL bucket (a hash of the URL), so a batch
reads the URLs of the buckets it touches, no others.  Landed pages leave
before their text is extracted.  Of several pages with one URL in a batch the
smallest page_id lands (null last; then the smallest title and content); a
null URL is a URL like any other.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import decode_entities
from ..functions.markup import PARAGRAPH_JOIN
from ..functions.text import unicode_strip
from ..functions.urls import host
from ..operators.extract import page_features

# Largest micro-batch (rows) whose URLs are broadcast to the landed-table scan.
BROADCAST_MAX_BATCH = 5_000_000
# URL buckets of the landed table; fixed for the table's life.
BUCKETS = 64


def url_bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    """Path test through the cluster's file system (HDFS, object store, ...)."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
    except Exception:  # no JVM handle (e.g. Spark Connect): probe with a read
        try:
            spark.read.parquet(path).schema
            return True
        except Exception:
            return False


def landed_urls(spark: SparkSession, landed: str, buckets: list[int], query_id: str, epoch_id: int) -> DataFrame | None:
    """URLs of these buckets landed by other epochs and queries (this epoch's
    own folder is excluded, so a replay does not filter out what its first
    attempt wrote).  Buckets, query and epoch are folders: only those asked
    for are read."""
    if not _exists(spark, landed):
        return None
    own = (F.col("query") == query_id) & (F.col("epoch") == epoch_id)
    rows = spark.read.schema("url string, query string, epoch long, bucket int").parquet(landed)
    return rows.where(F.col("bucket").isin(buckets) & ~own).select("url")


def unseen(batch: DataFrame, landed: str, query_id: str, epoch_id: int) -> DataFrame:
    """The rows of a batch whose URL has not landed yet."""
    spark = batch.sparkSession
    urls = batch.select("url").distinct()
    # at most BUCKETS rows
    buckets = [r["bucket"] for r in urls.select(url_bucket(F.col("url")).alias("bucket")).distinct().collect()]
    seen = landed_urls(spark, landed, buckets, query_id, epoch_id)
    if seen is None:
        return batch
    if urls.count() <= BROADCAST_MAX_BATCH:
        # the batch is the small side: which of its URLs are landed is a
        # map-only scan of the touched buckets (broadcast semi join), not a
        # shuffle of their URLs
        u = urls.select(F.col("url").alias("u"))
        seen = seen.join(F.broadcast(u), F.col("url").eqNullSafe(F.col("u")), "left_semi")
    seen = seen.select(F.col("url").alias("u"))
    return batch.join(seen, F.col("url").eqNullSafe(F.col("u")), "left_anti")


def first_of_url(rows: DataFrame) -> DataFrame:
    """One row per URL, the same one on every run."""
    order = Window.partitionBy("url").orderBy(F.col("page_id").asc_nulls_last(), "title", "content")
    return rows.withColumn("_no", F.row_number().over(order)).where("_no = 1").drop("_no")


def ingest_pages(spark: SparkSession, source_dir: str, landed: str, checkpoint: str,
                 glob: str = "pages.parquet") -> DataFrame:
    """Land what is new in ``source_dir``; ``glob`` names its files, or folders
    of files (a table of many parts).  Returns all that is landed."""
    source = os.path.join(source_dir, glob)
    schema = spark.read.parquet(source).schema
    stream = (spark.readStream.schema(schema)
                   .option("maxFilesPerTrigger", 64)
                   # a stream takes a path without pattern to be a folder
                   .parquet(os.path.join(source_dir, f"{{{glob}}}")))

    started, ids = threading.Event(), []

    def land(batch: DataFrame, epoch_id: int) -> None:
        # the query's id is kept in its checkpoint: a new checkpoint counts
        # epochs from 0 again, but never writes into another query's folders
        started.wait()
        query_id = ids[0]
        # per-page work needs no other page: title and the joined body come
        # from array functions on the page's own paragraphs (no grouping)
        fresh = unseen(batch.select("page_id", "url", "html"), landed, query_id, epoch_id)
        feats = page_features(fresh.withColumn("book_id", host("url")).withColumn("n_chars", F.length("html").cast("long")))
        paras = F.filter(F.transform("paragraphs", decode_entities), lambda x: F.length(unicode_strip(x)) > 0)
        rows = first_of_url(feats.select("page_id", "url", "book_id", "n_chars", "title",
                                         F.array_join(paras, PARAGRAPH_JOIN).alias("content")))
        # one folder per query and epoch, overwritten: a replayed batch rewrites its own
        # output instead of appending a second copy; a bucket is one file of it
        (rows.withColumn("bucket", url_bucket(F.col("url"))).repartition("bucket").write.mode("overwrite")
             .partitionBy("bucket").parquet(os.path.join(landed, f"query={query_id}", f"epoch={epoch_id}")))

    q = (stream.writeStream.foreachBatch(land)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True)
               .start())
    ids.append(str(q.id))
    started.set()
    q.awaitTermination()
    # given, not read off the files: pages without a row land none
    columns = T.StructType([schema["page_id"], schema["url"], *T.StructType.fromDDL("book_id string, n_chars long, title string, content string")])
    if not _exists(spark, landed):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(landed).drop("query", "epoch", "bucket")
