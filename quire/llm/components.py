"""Connected components of a links table, by hooking and pointer jumping.

Every round, each node hooks to its smallest neighbour, chains of hooks are
shortened by joining the hook table with itself, and the links are rewritten
between the roots.  A round at least halves the nodes that still have links.
Each table is written to the shared folder; nothing is collected.  A node
with very many links is met by partial minima and by joins against a table
with one row per node, whose large side may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the smallest
    node of its component."""
    u, v = F.col("u"), F.col("v")
    links = materialize(links.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "links")
    out = None
    while not links.isEmpty():
        ends = links.select(v.alias("node"), u.alias("root")).union(links.select(u.alias("node"), u.alias("root")))
        hook = materialize(ends.groupBy("node").agg(F.min("root").alias("root")), "hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            hook = materialize(hook.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")), "hooks")
            if hook.where("moved").isEmpty():
                break
            hook = hook.select("node", "root")
        hook = hook.select("node", "root")
        if out is None:
            out = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            out = out.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        a = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        links = links.join(a, "u").join(b, "v").where("ru <> rv")
        links = materialize(links.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
    return links.select(u.alias("node"), v.alias("root")) if out is None else out
