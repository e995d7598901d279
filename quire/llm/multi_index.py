"""Operator 8: embedding near-duplicates through an inverted multi-index.

Unit vectors are cut into two halves, each with its own codebook; a pair of
codes is a cell of the product grid, and every vector lives in one cell.  A
vector's search walks the grid by the multi-sequence order - cells by rising
sum of the two half distances - and visits as many cells as the target recall
needs: that number is measured on simulated partners at exactly the threshold
cosine.  Every visit is verified in double precision, so no link lies under
the threshold.

Codebooks are fitted on a bounded sample (``FIT_ROWS`` rows by a hash of
vec_id); every row is indexed.  Equal vectors are one class and stand for
their copies.  A cell's rows (those that live there and those that visit)
beyond ``BLOCK_ROWS`` are dealt into blocks, and each pair of blocks is one
unit of work, so a cell of any size is compared whole by tasks of bounded
size.  A pair that two cells see is counted by one of them: each row carries
the cells it visits.  Units return counts and a spanning set of ties per row,
never pairs.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing; vectors of different lengths are
never linked; rows without a vec_id are returned unlinked with a null
component; rows that repeat a vec_id are one row each in one component;
further columns pass by.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bounded_batches, read
from .components import components
from .ngram_join import Forest

THRESHOLD = 0.95
TARGET_RECALL = 0.99
FIT_ROWS = 20_000
TRIALS = 512
CELL_ROWS = 32
MAX_CODES = 512
ROUNDS = 8
BLOCK_ROWS = 2048


def unit(values: list | None) -> np.ndarray | None:
    """The vector scaled to length 1 in double precision; None if it has no direction."""
    if not values or None in values:
        return None
    x = np.array(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, key, vec (unit vector, doubles) of every row with a vec_id; key and vec null if it links with nothing."""
    bounded_batches(df.sparkSession)
    src = df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [unit(v) for v in b.column(1).to_pylist()]
            raw = [None if x is None else (x + 0.0).tobytes() for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r and hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                                              pa.array(raw, pa.binary())], names=["vec_id", "key", "vec"])

    return src.mapInArrow(run, "vec_id long, key binary, vec binary")


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None, :], 0)


def _codebook(x: np.ndarray, k: int, rng) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _distances(x, codes).argmin(1)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


def nearest_cells(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[int]:
    """Cells (i * codes + j) by rising d1[i] + d2[j]: the multi-sequence walk."""
    o1, o2, k = d1.argsort(kind="stable"), d2.argsort(kind="stable"), len(d2)
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, seen, out = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(o1[i] * k + o2[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < k and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


class Grid:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, rows: int):
        rng = np.random.default_rng(8)
        self.dim = sample.shape[1]
        self.half = max(1, self.dim // 2)
        k = int(min(MAX_CODES, max(1, round((rows / CELL_ROWS) ** 0.5)), len(sample)))
        parts = (sample[:, : self.half], sample[:, self.half :])
        self.codes = [_codebook(p, k if p.shape[1] else 1, rng) for p in parts]
        self.visits = self._needed(sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)], rng)

    def fit_length(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] == self.dim:
            return x
        out = np.zeros((len(x), self.dim))
        out[:, : min(self.dim, x.shape[1])] = x[:, : self.dim]
        return out

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        x = self.fit_length(x)
        return [_distances(x[:, : self.half], self.codes[0]), _distances(x[:, self.half :], self.codes[1])]

    def _needed(self, x: np.ndarray, rng) -> int:
        """Cells to visit so that of simulated pairs at the threshold the
        target share is met by one of the two searches."""
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.sqrt((noise * noise).sum(1)), 1e-12)[:, None]
        y = THRESHOLD * x + (1 - THRESHOLD**2) ** 0.5 * noise
        ranks = np.full(len(x), np.iinfo(np.int64).max)
        for a, b in ((self.distances(x), self.distances(y)), (self.distances(y), self.distances(x))):
            for r in range(len(x)):
                at = a[0][r][b[0][r].argmin()] + a[1][r][b[1][r].argmin()]
                ranks[r] = min(ranks[r], int((a[0][r][:, None] + a[1][r][None, :] < at).sum()))
        return int(np.quantile(ranks, TARGET_RECALL, method="higher")) + 1


def fit(classes: DataFrame) -> Grid | None:
    rows = classes.count()
    share = FIT_ROWS / max(1, rows)
    picked = classes.select("key", "vec") if share >= 1 else classes.where(
        F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))).select("key", "vec")
    # at most about FIT_ROWS vectors
    own = [np.frombuffer(r["vec"], np.float64) for r in sorted(picked.collect(), key=lambda r: bytes(r["key"]))]
    if not own:
        return None
    lengths = [len(x) for x in own]
    common = max(set(lengths), key=lambda n: (lengths.count(n), n))
    return Grid(np.array([x for x in own if len(x) == common]), rows)


def _assign(classes: DataFrame, grid: Grid) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(v, np.float64) for v in b.column(3).to_pylist()]
            cells = [nearest_cells(*(d[0] for d in grid.distances(x[None, :])), grid.visits) for x in own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int64()))], names=["vid", "key", "copies", "vec", "cells"])

    return classes.select("vid", "key", "copies", "vec").mapInArrow(run, "vid long, key binary, copies long, vec binary, cells array<long>")


def _compare(rows: list[dict]) -> list[tuple]:
    """(vid, key, links, tied) of the rows of a unit that are linked there."""
    cell, same = rows[0]["cell"], rows[0]["i"] == rows[0]["j"]
    rows.sort(key=lambda r: (r["vid"], r["key"]))
    length = np.array([len(r["vec"]) // 8 for r in rows])
    x = np.zeros((len(rows), length.max()))
    for k, r in enumerate(rows):
        x[k, : length[k]] = np.frombuffer(r["vec"], np.float64)
    homes = np.array([r["cells"][0] for r in rows])
    block = np.array([r["block"] for r in rows])
    copies = np.array([r["copies"] for r in rows], np.int64)
    links, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
    for k in np.flatnonzero(homes == cell).tolist():
        near = np.flatnonzero((x @ x[k] >= THRESHOLD) & (length == length[k]))
        # pairs of this unit; two that live here are met from the first
        near = near[((homes[near] != cell) | (near > k)) & (near != k) & (same | (block[near] != block[k]))]
        if len(near):
            there = np.isin(homes[near], rows[k]["cells"])
            near = near[(homes[near] == cell) | ~there | (cell < homes[near])]
        links[k] += copies[near].sum()
        links[near] += copies[k]
        for j in near.tolist():
            forest.join(k, j)
    return [(r["vid"], r["key"], int(links[k]), rows[forest.root(k)]["vid"]) for k, r in enumerate(rows) if links[k]]


def _verify(units: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        for _, own in groupby(rows, key=lambda r: (r["cell"], r["i"], r["j"])):
            if found := _compare(list(own)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
                                                 names=["vid", "key", "links", "tied"])

    key = ["cell", "i", "j"]
    return units.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "vid long, key binary, links long, tied long")


def near_duplicates(df: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = materialize(vectors(df), "vectors")
    classes = materialize(rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("vec_id").alias("vid"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "vector-classes")
    of_class = classes.select("key", "vid", F.col("vid").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
    grid = fit(classes)
    if grid is not None:
        placed = materialize(_assign(classes, grid), "placed")
        visits = placed.select("*", F.explode("cells").alias("cell"))
        size = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        dealt = visits.join(size, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = materialize(_verify(dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                                                 "vid", "key", "copies", "vec", "cells", "block")), "vector-links")
        twice = rows.where(F.col("key").isNotNull()).groupBy("vec_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b")
        again = twice.join(rows, "vec_id").join(classes.select("key", "vid"), "key").select(F.col("vec_id").alias("u"), F.col("vid").alias("v"))
        groups = components(found.select(F.col("vid").alias("u"), F.col("tied").alias("v")).union(again))
        links = found.groupBy("key").agg(F.sum("links").alias("links"))
        of_class = (classes.select("key", "vid", "copies").join(links, "key", "left").join(groups.withColumnRenamed("node", "vid"), "vid", "left")
                           .select("key", F.coalesce("root", "vid").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = rows.select("vec_id", "key").join(of_class.select("key", "component_id", "n_links"), "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    nameless = df.where(F.col("vec_id").isNull()).select(
        F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
