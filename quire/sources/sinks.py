"""Sinks: chapter files per book (A4) and the book export (A5).

Rows are dealt over the tasks by ranges of (book, order): a book with a third
of all chapters spreads over many tasks, a task meets few books, so there are
about as many files as tasks and books together.  Folders per book keep its
files together on storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup as M

CHAPTER_FILE_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()), T.StructField("chapter_no", T.LongType()),
    T.StructField("chapter_html", T.StringType()), T.StructField("book_id", T.StringType())])

# What a book is made of, in reading order: navigation, title page, chapters.
PART_SCHEMA = T.StructType([
    T.StructField("part_no", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("file_name", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("book_id", T.StringType())])
# Chapters named by one navigation file.
NAV_ITEMS = 1000

BOOK_SCHEMA = T.StructType([
    T.StructField("book_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("cover_url", T.StringType()), T.StructField("language_code", T.StringType()),
    T.StructField("n_chapters", T.LongType())])


def write_chapter_files(chapters: DataFrame, path: str) -> None:
    (chapters.select("file_name", "chapter_no", "chapter_html", "book_id")
             .repartitionByRange("book_id", "chapter_no").sortWithinPartitions("book_id", "chapter_no")
             .write.mode("overwrite").partitionBy("book_id").parquet(path))


def read_chapter_files(spark: SparkSession, path: str) -> DataFrame:
    # explicit schema: the partition value stays a string (no type inference)
    return spark.read.schema(CHAPTER_FILE_SCHEMA).parquet(path)


def book_parts(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Every part of every book: book_id, part_no, kind, file_name, title,
    content.  Navigation comes in files of NAV_ITEMS chapters (numbered below
    0, so the longest book's list is no single value), then the title page (0),
    then the chapters (book_id, chapter_no, file_name, title, chapter_html).
    ``books``: book_id, title, author."""
    nav_no = F.floor((F.col("chapter_no") - 1) / NAV_ITEMS)
    item = F.concat(F.lit('<li><a href="'), F.col("file_name"), F.lit('">'), M.markup_text(F.coalesce("title", F.lit(""))), F.lit("</a></li>"))
    nav = (chapters.select("book_id", nav_no.alias("nav_no"), "chapter_no", item.alias("item")).groupBy("book_id", "nav_no")
                   .agg(F.sort_array(F.collect_list(F.struct("chapter_no", "item"))).alias("items")))
    listed = F.array_join(F.transform("items", lambda x: x["item"]), "")
    last = nav.groupBy("book_id").agg(F.max("nav_no").alias("last"))
    nav = nav.join(last, "book_id").select(
        "book_id", (F.col("nav_no") - F.col("last") - 1).alias("part_no"), F.lit("nav").alias("kind"),
        F.concat(F.lit("nav"), F.col("nav_no").cast("string"), F.lit(".html")).alias("file_name"), F.lit(None).cast("string").alias("title"),
        F.concat(F.lit("<nav><ol>"), listed, F.lit("</ol></nav>")).alias("content"))
    front = books.select("book_id", F.lit(0).cast("long").alias("part_no"), F.lit("title").alias("kind"), F.lit(M.TITLE_PAGE_FILE).alias("file_name"), "title",
                         M.title_page_html("title", "author").alias("content"))
    body = chapters.select("book_id", F.col("chapter_no").alias("part_no"), F.lit("chapter").alias("kind"), "file_name", "title", F.col("chapter_html").alias("content"))
    return nav.unionByName(front).unionByName(body)


def write_book_parts(parts: DataFrame, path: str) -> None:
    (parts.select(*PART_SCHEMA.names).repartitionByRange("book_id", "part_no").sortWithinPartitions("book_id", "part_no")
          .write.mode("overwrite").partitionBy("book_id").parquet(path))


def read_book_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PART_SCHEMA).parquet(path)


def export_books(books: DataFrame, path: str) -> None:
    books.select(*[f.name for f in BOOK_SCHEMA.fields]).write.mode("overwrite").json(path)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOOK_SCHEMA).json(path)
