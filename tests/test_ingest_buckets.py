"""K1: the landed table by URL buckets: pruned reads, one defined page a URL."""

from pyspark.sql import functions as F

from quire.session import scratch_path
from quire.streaming import ingest as IN

SCHEMA = "page_id long, url string, html string"


def page(k, url, word):
    return (k, url, f"<html><body><h1>{word}</h1><article><p>{word}</p></article></body></html>")


def land(spark, rows, landed, checkpoint=None):
    source = scratch_path(spark, "t-source")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(source)
    return IN.ingest_pages(spark, source, landed, checkpoint or scratch_path(spark, "t-ckpt"), glob="*.parquet")


def test_smallest_page_of_a_url_lands(spark):
    rows = [page(9, "http://a.b/1", "nine"), page(3, "http://a.b/1", "three"), page(None, "http://a.b/1", "none"),
            page(5, None, "five"), page(4, None, "four"), page(7, "http://a.b/2", "b"), page(7, "http://a.b/2", "a"), page(8, "", None)]
    landed = scratch_path(spark, "t-landed")
    got = {r.url: (r.page_id, r.title) for r in land(spark, rows, landed).collect()}
    assert got == {"http://a.b/1": (3, "three"), None: (4, "four"), "http://a.b/2": (7, "a"), "": (8, "None")}
    # a later batch adds its new URL only, null URLs included among the landed ones
    again = land(spark, [page(1, "http://a.b/1", "late"), page(2, None, "late"), page(1, "http://a.b/3", "new")], landed)
    assert sorted((r.page_id, r.url or "-") for r in again.collect()) == [(1, "http://a.b/3"), (3, "http://a.b/1"), (4, "-"), (7, "http://a.b/2"), (8, "-")]


def test_a_batch_reads_the_buckets_it_touches(spark):
    landed = scratch_path(spark, "t-landed")
    urls = [f"http://h{k % 5}.x/{k}" for k in range(600)]
    land(spark, [page(k, u, "t") for k, u in enumerate(urls)], landed)
    bucket = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("b", IN.url_bucket(F.col("url"))).where("url = 'http://h3.x/3'").first().b
    seen = IN.landed_urls(spark, landed, [bucket], "other", 0)
    plan = seen._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = {u for u, b in spark.createDataFrame([(u,) for u in urls], "url string").select("url", IN.url_bucket(F.col("url")).alias("b")).collect() if b == bucket}
    assert {r.url for r in seen.collect()} == want and len(want) < 40


def test_batch_with_nothing_new_and_an_empty_one(spark):
    landed = scratch_path(spark, "t-landed")
    first = land(spark, [page(1, "u1", "a"), page(2, "u2", "b")], landed).count()
    assert first == 2
    assert land(spark, [page(3, "u1", "c")], landed).count() == 2
    assert land(spark, [page(4, "u4", "d")], landed).count() == 3


def test_a_table_that_is_a_folder_of_parts(spark):
    import os

    from quire.plans.catalog import stream_ingest
    folder = scratch_path(spark, "t-tables")
    rows = [page(k, f"http://h{k % 3}.x/{k}", f"t{k}") for k in range(40)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(os.path.join(folder, "pages.parquet"))
    got = {(r.page_id, r.url, r.title) for r in stream_ingest(spark, folder).collect()}
    assert got == {(k, u, f"t{k}") for k, u, _ in rows}


def test_pages_without_a_row(spark):
    landed = scratch_path(spark, "t-landed")
    got = land(spark, [], landed)
    assert got.columns == ["page_id", "url", "book_id", "n_chars", "title", "content"] and got.count() == 0
    assert land(spark, [page(1, "u1", "a")], landed).count() == 1
