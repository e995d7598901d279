"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space as the contracts spell it: space and \t \n \v \f \r
WORD = r"[^\x20\x09-\x0D]+"
# Arrow batches handed to Python helpers: rows and bytes per batch
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of the Python helpers small: a batch of long
    texts must fit a worker, whatever the row count of the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; after it, memory that nothing holds any more
    goes back to the system: a Python worker outlives its task."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # no glibc
            pass

    return tidied


def words(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in the whole text; null gives no words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + pattern + ")"), F.lit(1))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def null_safe_key(c: Column) -> Column:
    """A non-null string key that is different for null and every value."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
