"""Skew-safe ``row_number() OVER (PARTITION BY g ORDER BY o)``.

A window puts every row of a group into one task; a book (or host) can
hold a third of all pages.  Instead we range-sort on (g, o) - the range
exchange splits a hot group across many tasks - take each row's global
rank from ``monotonically_increasing_id`` plus per-partition offsets, and
subtract the group's first rank.  The sorted ids are written to the
shared folder so that a recomputed task cannot renumber rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_root

_LOW_BITS = (1 << 33) - 1
# Largest number of groups whose start ranks are broadcast.
BROADCAST_MAX_GROUPS = 2_000_000


def number_within(df: DataFrame, group_cols, order_cols, name: str = "row_no",
                  write_ids: bool = True) -> DataFrame:
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    shared_root(df.sparkSession)
    ids = (df.repartitionByRange(*[F.col(c) for c in group_cols + order_cols])
             .sortWithinPartitions(*group_cols, *order_cols)
             .withColumn("_mid", F.monotonically_increasing_id()))
    if write_ids:
        ids = materialize(ids, "numbered")
    ids = (ids.withColumn("_pid", F.shiftright("_mid", 33))
              .withColumn("_off", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    # one row per partition: bounded by the partition count, safe to broadcast
    parts = ids.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn(
        "_base",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
    ranked = (ids.join(F.broadcast(parts.select("_pid", "_base")), "_pid")
                 .withColumn("_g", F.col("_base") + F.col("_off")))
    # first global rank per group: a partial aggregate, one row per group
    starts = ranked.groupBy(*group_cols).agg(F.min("_g").alias("_g0"))
    # broadcast the group starts only when their count is within the bound;
    # otherwise a shuffle join, where AQE splits the partition of a hot group
    # groups <= rows: the row count of the written table (parquet metadata)
    # settles the common case without a pass over the data
    if (write_ids and ids.count() <= BROADCAST_MAX_GROUPS) or starts.count() <= BROADCAST_MAX_GROUPS:
        starts = F.broadcast(starts)
    out = ranked.join(starts, group_cols, "inner")
    return (out.withColumn(name, (F.col("_g") - F.col("_g0") + 1).cast("long"))
               .drop("_mid", "_pid", "_off", "_base", "_g", "_g0"))
