"""Joins that split hot keys off explicitly.

One chunk of boilerplate, one link target or one book may hold a third of
all rows.  A plain hash join sends all of a key's rows to one task; AQE can
split such a partition at run time, but only when its thresholds are met.
Here the hot keys are found first (a partial aggregate: one row per key),
their rows are joined against a broadcast copy of just the matching right
rows (map-only, no shuffle of the hot rows), and the rest takes the normal
shuffle join.  If there are too many hot keys to broadcast, the plain join
(with AQE skew handling) is used for everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more left rows than this is hot.
HOT_ROWS = 100_000
# Largest number of hot keys (and matching right rows) broadcast.
MAX_HOT_KEYS = 1_000_000


def split_hot_join(left: DataFrame, right: DataFrame, keys, how: str = "left",
                   hot_rows: int = HOT_ROWS, max_hot_keys: int = MAX_HOT_KEYS,
                   hot: DataFrame | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` for how in inner/left/left_anti/left_semi,
    with hot keys of ``left`` joined by broadcast.  ``right`` must be unique
    or small per key (a lookup table).  ``hot`` (the hot keys) may be passed
    in when an earlier aggregate already counted the keys."""
    keys = list(keys)
    if hot is None:
        hot = (left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > hot_rows).select(*keys))
    n_hot = hot.count()
    if n_hot == 0 or n_hot > max_hot_keys:
        return left.join(right, keys, how)
    hot_b = F.broadcast(hot)
    left_hot = left.join(hot_b, keys, "left_semi")
    left_cold = left.join(hot_b, keys, "left_anti")
    right_hot = right.join(hot_b, keys, "left_semi")
    right_cold = right.join(hot_b, keys, "left_anti")
    return (left_hot.join(F.broadcast(right_hot), keys, how)
                    .unionByName(left_cold.join(right_cold, keys, how)))
