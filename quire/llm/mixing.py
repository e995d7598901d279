"""Operator 7: mixing sources to target weights with hash-threshold histograms.

Each source's target is its share by weight of all words, stopped at
``MAX_REPEATS`` times the source's size (the excess is reshared by weight).
Every document gets a fixed hash.  A source is taken whole
``floor(target / size)`` times and the rest of its budget is met by the
documents whose hash lies under a threshold.  The threshold is found without
sorting: words are summed by source and the top ``LEVEL_BITS`` bits of the
hash, the running sums name the bucket that crosses the budget, and only that
bucket is summed again by the next bits.  The thresholds are nested - a
larger budget keeps every document that a smaller one keeps - and reruns agree.

A source may hold any share of the rows: its sums are partial aggregates over
``source x bucket``; no task sees a source whole.

Defined results: null text has size 0; a null source is a source of its own,
last in order; rows that share a doc_id share a hash and are taken together
(null ids too); a row without words is taken as often as its source is taken
whole, so a source without words takes nothing; an empty table gives an
empty result; other columns are not read by ``mix`` and pass through ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_within
from ..session import materialize
from .common import WORD, null_safe_key, read

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
LEVEL_BITS = 12
LEVELS = 3


def doc_hash(doc_id: Column) -> Column:
    """36 hash bits of a document's id as a long."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", null_safe_key(F.col("source")).alias("skey"), size.alias("size"),
                       doc_hash(F.col("doc_id")).alias("h"))


def source_targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(skey, source_size, target) of every source."""
    src = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    src = src.select("skey", "source_size", (F.col("skey") == "").alias("last"), F.lit(0).alias("g"))
    src = number_within(src, ["g"], ["last", "skey"], "no")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("no") - 1, F.lit(len(weights))).cast("int"))
    src = materialize(src.select("skey", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * MAX_REPEATS
    level, full = 0.0, -1
    while True:
        # the water level: words for a unit of weight once the full sources are set aside
        is_full = F.lit(level) * F.col("weight") > cap
        t = src.agg(F.sum("source_size").alias("all"), F.sum(F.when(is_full, cap)).alias("held"),
                    F.sum(F.when(~is_full, F.col("weight"))).alias("open"), F.count(F.when(is_full, 1)).alias("n")).first()
        if t["n"] == full or not t["open"]:
            break
        full, level = t["n"], float(t["all"] - (t["held"] or 0)) / t["open"]
    target = F.least(F.lit(level) * F.col("weight"), cap.cast("double"))
    return src.select("skey", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(skey, source_size, target, whole, below): documents of the source are
    taken ``whole`` times, and once more if their hash is less than ``below``."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.select("*", whole.alias("whole")).select(
        "*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        rows = sizes.select("skey", "size", F.shiftright("h", shift + LEVEL_BITS).alias("prefix"),
                            F.shiftright("h", shift).alias("bucket"))
        if level:
            rows = rows.join(state.select("skey", "prefix"), ["skey", "prefix"])
        hist = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
        # at most 2^LEVEL_BITS rows for a source, whatever its size
        upto = F.sum("n").over(Window.partitionBy("skey").orderBy("bucket"))
        hist = hist.select("skey", "bucket", "n", upto.alias("upto")).join(state.select("skey", "left"), "skey")
        cross = (hist.where(F.col("upto") > F.col("left")).groupBy("skey")
                     .agg(F.min(F.struct("bucket", "upto", "n")).alias("c"))
                     .select("skey", F.col("c.bucket").alias("bucket"), (F.col("c.upto") - F.col("c.n")).alias("before"),
                             F.col("c.n").alias("n")))
        last = level == LEVELS - 1
        # a source without a crossing bucket at this level keeps what lies before it
        state = state.join(cross, "skey", "left").select(
            "skey", "source_size", "target", "whole",
            F.coalesce(F.col("left") - F.col("before"), F.lit(0.0)).alias("left"),
            F.coalesce(F.col("bucket"), F.shiftleft(F.col("prefix") + (0 if level else 1), LEVEL_BITS)).alias("prefix"),
            *([F.col("n")] if last else []))
        if last:
            # the last bucket holds one hash: taken when that comes nearer the budget
            near = F.coalesce(F.col("n") - F.col("left") < F.col("left"), F.lit(False))
            state = state.select("skey", "source_size", "target", "whole", (F.col("prefix") + near.cast("long")).alias("below"))
        state = materialize(state, f"mix-level{level}")
    return state


def copies(worded: Column) -> Column:
    """How often a row is taken; without words it adds nothing to a budget, so
    the part under the threshold is not for it."""
    return F.col("whole") + (worded & (F.col("h") < F.col("below"))).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    sizes = materialize(sized(docs), "sizes")
    marks = thresholds(sizes, source_targets(sizes, weights))
    return sizes.join(marks, "skey").select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("size") > 0)).alias("taken"))


def apply_mix(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """The mixed rows: each document as often as the mix takes it."""
    sizes = materialize(sized(docs), "sizes")
    marks = thresholds(sizes, source_targets(sizes, weights)).select("skey", "whole", "below")
    kept = docs.select(F.struct("*").alias("row")).select(
        "row", null_safe_key(F.col("row.source")).alias("skey"), doc_hash(F.col("row.doc_id")).alias("h"),
        F.coalesce(F.col("row.text").cast("string").rlike(WORD), F.lit(False)).alias("worded"))
    kept = kept.join(marks, "skey").select("row", copies(F.col("worded")).alias("n")).where("n > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


# The same by sorting: documents in hash order, running sums, the nearest cut.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 9))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (ARRAY[5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         sum(source_size) OVER () AS all_words
  FROM s),
r AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k,
         (all_words - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w),
m AS (SELECT lvl FROM r WHERE lvl * weight <= 3 * source_size ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least((SELECT lvl FROM m) * weight, (3 * source_size)::DOUBLE) AS target FROM r),
t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (
  SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (
  SELECT g.source, g.h, g.n, t2.target - t2.whole * t2.source_size AS budget,
         sum(g.n) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
  FROM g JOIN t2 ON g.source IS NOT DISTINCT FROM t2.source),
e AS (
  SELECT source, h,
         upto <= budget
         OR (upto > budget AND upto - n <= budget AND upto - budget < budget - (upto - n)) AS extra
  FROM c)
SELECT d.doc_id, d.size, t2.source_size, t2.target, (d.size * (t2.whole + CASE WHEN e.extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source
JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
