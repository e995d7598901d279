"""Spark session and shared-folder helpers.

Everything the library writes (landing tables, checkpoints, stream state)
goes under the folder the cluster names in ``spark.checkpoint.dir``.  Only
when that setting is absent (local tests) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, app: str = "quire",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[int, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Root of the shared folder: ``spark.checkpoint.dir`` when the cluster
    sets it; otherwise (tests, local runs) a fresh folder made once per
    session.  Lineage is cut by tables written here (``materialize``)."""
    root = None
    try:
        root = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:
        root = None
    if not root:
        try:
            root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        except Exception:  # no SparkContext handle (e.g. Spark Connect)
            root = None
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = id(spark)
        root = _LOCAL_ROOTS.get(key)
        if not root:
            root = tempfile.mkdtemp(prefix="quire-shared-", dir="/tmp")
            _LOCAL_ROOTS[key] = root
    return root


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique table location under the shared root (remembered so
    ``drop_scratch`` can remove it once results are written)."""
    path = os.path.join(shared_root(spark), "quire", f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote.  Call only after
    every DataFrame that reads them has been written out (they are lazy)."""
    n = 0
    while _SCRATCH:
        path = _SCRATCH.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(p):
                fs.delete(p, True)
                n += 1
        except Exception:  # no JVM handle (e.g. Spark Connect): leave it
            continue
    return n


def materialize(df, name: str):
    """Cut lineage: write ``df`` once as parquet under the shared root and
    read it back (one job; survives lost executors, unlike localCheckpoint,
    and unlike ``checkpoint()`` does not compute the plan twice)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
