"""Page sources: parquet scan, byte decoding, landing area."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import host

PAGE_COLUMNS = ("page_id", "url", "html")

# --- fixed values -----------------------------------------------------------
# Byte patterns that declare a GBK page.
GBK_DECLARATIONS = (b"charset=gbk", b'charset="gbk"')
# ---------------------------------------------------------------------------


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer splits than the cluster has
    cores (a single-row-group file is one split).  Large inputs already
    have many splits and are left as they are - no extra shuffle."""
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. Spark Connect): leave the scan as is
        return df
    return df.repartition(want) if have < want else df


def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: pages as (page_id, url, html) plus the book key (URL host)."""
    return (spread(read_table(spark, sf_dir, "pages").select(*PAGE_COLUMNS))
            .withColumn("book_id", host("url")))


def declares_gbk(content) -> F.Column:
    c = F.col(content) if isinstance(content, str) else content
    cond = None
    for pat in GBK_DECLARATIONS:
        t = F.contains(c, F.lit(pat))
        cond = t if cond is None else (cond | t)
    return cond


@F.pandas_udf(T.StructType([T.StructField("charset", T.StringType()),
                              T.StructField("text", T.StringType())]))
def _decode_slow(content: pd.Series) -> pd.DataFrame:
    """Arrow batch decoder for the rows the native UTF-8 path cannot take.

    Rows arrive as NULL unless they need it, so only those bytes cross to
    Python.  Ladder: declared GBK -> strict GBK, else strict UTF-8, else
    strict GBK, else UTF-8 with replacement characters."""
    charsets, texts = [], []
    for raw in content:
        if raw is None:
            charsets.append(None)
            texts.append(None)
            continue
        raw = bytes(raw)
        declared = any(p in raw for p in GBK_DECLARATIONS)
        order = ("gbk", "utf-8") if declared else ("utf-8", "gbk")
        for enc in order:
            try:
                texts.append(raw.decode(enc))
                charsets.append(enc)
                break
            except UnicodeDecodeError:
                continue
        else:
            texts.append(raw.decode("utf-8", errors="replace"))
            charsets.append("utf-8-replace")
    return pd.DataFrame({"charset": charsets, "text": texts})


def decode_pages(df: DataFrame, content: str = "content") -> DataFrame:
    """A2: bytes -> text.  Valid, undeclared UTF-8 stays in the JVM
    (``decode``); only the rest is handed to the Arrow UDF."""
    c = F.col(content)
    native = (~declares_gbk(c)) & F.is_valid_utf8(c.cast("string"))
    slow = _decode_slow(F.when(~native, c))
    return (df.withColumn("_slow", slow)
              .withColumn("charset", F.when(native, F.lit("utf-8")).otherwise(F.col("_slow.charset")))
              .withColumn("html", F.when(native, F.decode(c, "UTF-8")).otherwise(F.col("_slow.text")))
              .drop("_slow"))


def write_landing(df: DataFrame, path: str) -> None:
    """A3: land one row per fetched page, keyed by its list index."""
    df.write.mode("overwrite").parquet(path)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_page_files(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """A folder of fetched page files (one file per URL, as the reference's
    landing area keeps them) as pages: ``binaryFile`` source, bytes through
    the decode ladder.  ``idx`` is the list index in a 'page_<i>' file name
    (else NULL); ``page_id`` is that index, or a stable hash of the path."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                .option("recursiveFileLookup", "true").load(folder)
                .select(F.col("path").alias("url"), "content"))
    idx = F.regexp_extract("url", r"page_(\d+)\.[^/]*$", 1)
    idx = F.when(idx != "", idx.cast("long"))
    out = decode_pages(raw.withColumn("idx", idx), "content").drop("content")
    return out.withColumn("page_id", F.coalesce("idx", F.xxhash64("url")))


def load_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages stored as bytes (page_id, url, content binary): decoded, keyed by book."""
    raw = spark.read.parquet(path).select("page_id", "url", "content")
    return decode_pages(raw, "content").drop("content").withColumn("book_id", host("url"))
