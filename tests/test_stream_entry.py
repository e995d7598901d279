"""K1 stream = batch (one and two availableNow runs), the driver contract,
and every registered query against its DuckDB oracle on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from quire.plans.catalog import load_pages
from quire.session import scratch_path
from quire.streaming.ingest import ingest_pages
from tools.oracle_check import TABLES, _digest

from .conftest import SF0001


def test_stream_equals_batch_and_is_idempotent(spark):
    landed, ckpt = scratch_path(spark, "t-landed"), scratch_path(spark, "t-ckpt")
    batch = {r["url"] for r in load_pages(spark, SF0001).select("url").collect()}
    first = ingest_pages(spark, SF0001, landed, ckpt)
    assert {r["url"] for r in first.collect()} == batch and first.count() == len(batch)
    again = ingest_pages(spark, SF0001, landed, ckpt)                          # same checkpoint: nothing new
    assert again.count() == len(batch)
    fresh = ingest_pages(spark, SF0001, landed, scratch_path(spark, "t-ckpt2"))  # files re-read: anti join
    assert fresh.count() == len(batch)


def test_new_checkpoint_keeps_what_is_landed(spark):
    pages = load_pages(spark, SF0001)
    landed = scratch_path(spark, "t-landed")
    for k in (0, 1):
        source = scratch_path(spark, "t-source")
        pages.where(f"page_id % 2 = {k}").write.parquet(source)
        out = ingest_pages(spark, source, landed, scratch_path(spark, "t-ckpt"), glob="*.parquet")
    assert {r["url"] for r in out.collect()} == {r["url"] for r in pages.select("url").collect()}


def test_entry_contract(spark):
    df = E.entry(spark)
    cols = df.columns
    assert df.count() > 0
    assert E.entry(spark).columns == cols
    assert set(E.oracle_sql()) <= set(E.queries())
    missing = set(E.QUERIES) - set(E.oracle_sql())  # the optional subpackage has its own tests
    assert missing == set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF0001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows)[0] == _digest(dcols, drows)[0]


def test_command_line_builds_books(spark, tmp_path):
    from quire.__main__ import main
    out = str(tmp_path / "out")
    main(["--pages", f"{SF0001}/pages.parquet", "--training-docs", f"{SF0001}/documents.parquet", "--out", out])
    from quire.sources import sinks as SK
    chapters = SK.read_chapter_files(spark, f"{out}/chapters")
    books = SK.read_books(spark, f"{out}/books")
    assert chapters.count() == 50
    assert books.count() == chapters.select("book_id").distinct().count()
    assert books.agg({"n_chapters": "sum"}).first()[0] == 50


def test_drop_scratch_removes_only_own_tables(spark):
    import os

    from quire.session import drop_scratch, materialize
    df = materialize(spark.range(10), "t-scratch")
    assert df.count() == 10
    path = df.inputFiles()[0]
    assert os.path.exists(path.replace("file:", ""))
    assert drop_scratch(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))


def test_stream_takes_new_pages_as_they_arrive(spark, tmp_path):
    import shutil

    from .conftest import SF001
    src = tmp_path / "incoming"
    src.mkdir()
    shutil.copy(f"{SF0001}/pages.parquet", src / "pages.parquet")
    landed, ckpt = scratch_path(spark, "t2-landed"), scratch_path(spark, "t2-ckpt")
    first = ingest_pages(spark, str(src), landed, ckpt, glob="pages*.parquet").count()
    assert first == 50
    shutil.copy(f"{SF001}/pages.parquet", src / "pages_2.parquet")          # a new file arrives
    after = ingest_pages(spark, str(src), landed, ckpt, glob="pages*.parquet")
    want = {r["url"] for r in load_pages(spark, SF0001).select("url").collect()} | \
           {r["url"] for r in load_pages(spark, SF001).select("url").collect()}
    assert after.count() == len(want)                                          # each URL landed once
    assert {r["url"] for r in after.select("url").collect()} == want
