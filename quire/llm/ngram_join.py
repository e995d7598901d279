"""Operator 1: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two are linked if their Jaccard
similarity is ``THRESHOLD`` or more.

1. One pass over the texts gives each row its number of shingles, a key of
   the whole set and ``BANDS x ROWS`` MinHash values.  Rows with equal keys
   are one *class* (similarity 1); from here on classes stand for their copies.
2. Classes that agree in all values of a band are candidates.  In each set of
   candidates, pairs are compared value by value, ``STEP`` at a time: under a
   uniform prior the posterior of the similarity after m matches in n is
   Beta(m+1, n-m+1), and a pair is dropped as soon as the posterior
   probability of reaching the threshold is under ``TOLERANCE``.  What
   survives ties classes into clusters (a spanning set of pairs, never all).
   A band shared by more than ``SET_SIZE`` classes ties them all without
   comparing: that can only add comparisons later, it loses none.
3. Each cluster's texts meet once.  Clusters beyond ``BLOCK_ROWS`` rows or
   ``BLOCK_BYTES`` are dealt into blocks, and every pair of blocks is a unit
   of work of bounded size.  Pairs are pruned again as in 2, the rest is
   verified on the full shingle sets.  A unit returns one row per class: its
   number of verified links and the smallest class it is tied to.
4. Verified ties give the final groups.

The chance that a pair at exactly 0.8 agrees in no band is (1-0.8^5)^24 =
7e-5, at 0.9 1e-9.  Verification is on 64-bit shingle hashes of whole texts.

Defined results: words are runs of letters, digits and underscores in lower
case; a text of 1 to 4 words is one shingle of them all; null, empty and
wordless texts link with nothing; rows without a doc_id are returned
unlinked; rows that repeat a doc_id are one row each, and their groups are
one group; further columns pass by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bounded_batches, read, tidy
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
VALUES = BANDS * ROWS
STEP = 8
TOLERANCE = 1e-6
SET_SIZE = 64
BLOCK_ROWS = 256
BLOCK_BYTES = 4 << 20
CACHE_ENTRIES = 100_000

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_seed = np.random.default_rng(1)
_A = _seed.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_B = _seed.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_HIGH = np.uint64(32)
# room for the values of a few shingles at a time
_ROOM = np.empty((128, VALUES), np.uint64)


class Shingler:
    """Distinct shingle hashes of a text, with a memo of word hashes."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.memo) > CACHE_ENTRIES:
            self.memo.clear()
        memo, hashed = self.memo, []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh64_intdigest(w)
            hashed.append(h)
        h = np.array(hashed, np.uint64)
        size = min(SHINGLE, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
            out ^= out >> _HIGH
        return np.unique(out)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), len(_ROOM)):
        part = shingles[at : at + len(_ROOM), None]
        room = np.multiply(part, _A, out=_ROOM[: len(part)])
        room += _B
        np.minimum(low, room.min(axis=0), out=low)
    return (low >> _HIGH).astype(np.uint32)


def least_matches(values: int = VALUES, step: int = STEP) -> list[tuple[int, int]]:
    """(n, least m) after each step: with fewer matches in n the posterior
    probability of reaching the threshold, P(Binomial(n+1, t) <= m), is under
    the tolerance."""
    out = []
    for n in range(step, values + 1, step):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        out.append((n, m))
    return out


_LEAST = least_matches()


def surviving(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places in ``others`` whose values are never too unlike ``one``'s."""
    alive, matches, at = np.arange(len(others)), np.zeros(len(others), np.int64), 0
    for n, least in _LEAST:
        matches = matches + (others[alive, at:n] == one[at:n]).sum(axis=1)
        ok = matches >= least
        if not ok.all():
            alive, matches = alive[ok], matches[ok]
            if not len(alive):
                break
        at = n
    return alive


class Forest:
    """Union-find over 0..n-1; the root is the smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, sig and text_hash of every row that has a doc_id."""
    bounded_batches(docs.sparkSession)
    src = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                                            F.xxhash64(F.col("text").cast("string")).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            sets = [shingle(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([minhash(s).tobytes() for s in sets], pa.binary()), b.column(2)], names=["doc_id", "key", "n", "sig", "text_hash"])

    return src.mapInArrow(tidy(run), "doc_id long, key binary, n long, sig binary, text_hash long")


def _candidates(classes: DataFrame) -> DataFrame:
    """Links (u, v) that tie candidate classes into clusters."""
    width = 4 * ROWS
    bands = classes.select("cid", F.explode(F.array(*[
        F.xxhash64(F.lit(k), F.substring(F.col("sig"), 1 + width * k, width)) for k in range(BANDS)])).alias("band"))
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("first")).where("m > 1")
    shared = materialize(bands.join(full, "band"), "bands")
    large = shared.where(F.col("m") > SET_SIZE).select(F.col("first").alias("u"), F.col("cid").alias("v"))
    # most near copies share many bands: equal sets are compared once
    sets = (shared.where(F.col("m") <= SET_SIZE).groupBy("band").agg(F.sort_array(F.collect_set("cid")).alias("cids"))
                  .select(F.xxhash64("cids").alias("h"), "cids").where(F.size("cids") > 1).distinct())
    rows = sets.select(F.col("cids")[0].alias("first"), "h", F.explode("cids").alias("cid")).join(classes.select("cid", "sig"), "cid")
    grouped = rows.groupBy("first", "h").agg(F.collect_list(F.struct("cid", "sig")).alias("own")).select("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = []
            for own in b.column(0).to_pylist():
                own.sort(key=lambda x: x["cid"])
                sig = np.frombuffer(b"".join(x["sig"] for x in own), np.uint32).reshape(len(own), VALUES)
                forest = Forest(len(own))
                for k in range(len(own) - 1):
                    for j in surviving(sig[k], sig[k + 1 :]).tolist():
                        forest.join(k, k + 1 + j)
                links += [(own[forest.root(k)]["cid"], own[k]["cid"]) for k in range(len(own)) if forest.root(k) != k]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return grouped.mapInArrow(tidy(run), "u long, v long").union(large)


def _verify_unit(rows: list[dict], shingle: Shingler) -> list[tuple]:
    """(cid, key, links, tied) of the classes of one unit: two blocks of a
    cluster against each other, or one within itself."""
    own: dict[bytes, tuple] = {}
    for r in rows:
        s = shingle(r["text"])
        if r["key"] not in own and set_key(s) == r["key"]:  # a repeated doc_id may bring another text
            own[r["key"]] = (r["cid"], r["key"], r["copies"], r["block"], s, r["sig"])
    items = sorted(own.values(), key=lambda x: x[:2])
    if len(items) < 2:
        return []
    same = rows[0]["i"] == rows[0]["j"]
    block = np.array([x[3] for x in items])
    copies = np.array([x[2] for x in items], np.int64)
    sizes = np.array([len(x[4]) for x in items], np.int64)
    sig = np.frombuffer(b"".join(x[5] for x in items), np.uint32).reshape(len(items), VALUES)
    values, flat = np.unique(np.concatenate([x[4] for x in items]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    forest, links, mark = Forest(len(items)), np.zeros(len(items), np.int64), np.zeros(len(values), bool)
    for k in range(len(items) - 1):
        near = k + 1 + surviving(sig[k], sig[k + 1 :])
        if not same:
            near = near[block[near] != block[k]]
        if not len(near):
            continue
        mine = flat[starts[k] : starts[k + 1]]
        mark[mine] = True
        common = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j + 1]]]) for j in near.tolist()])
        mark[mine] = False
        # common / union >= threshold, as written: 0.8 is 4/5
        linked = near[common >= THRESHOLD * (sizes[k] + sizes[near] - common) - 1e-9]
        links[k] += copies[linked].sum()
        links[linked] += copies[k]
        for j in linked.tolist():
            forest.join(k, j)
    return [(x[0], x[1], int(links[k]), items[forest.root(k)][0]) for k, x in enumerate(items)]


def _verify(units: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        # a partition's rows are sorted by unit: one unit is held at a time
        for _, own in groupby(rows, key=lambda r: (r["root"], r["i"], r["j"])):
            if found := _verify_unit(list(own), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
                                                 names=["cid", "key", "links", "tied"])

    unit = ["root", "i", "j"]
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(tidy(run), "cid long, key binary, links long, tied long")


def _classes(signed: DataFrame) -> DataFrame:
    """key, doc (smallest doc_id), copies, sig and cid of each text class.  The
    cid is doc, but for a doc_id that comes with several texts: there the
    further classes go by a hash of their key, so that only verified links tie them."""
    classes = materialize(signed.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "classes")
    again = materialize(classes.groupBy("doc").agg(F.min("key").alias("own"), F.count(F.lit(1)).alias("m")).where("m > 1").select("doc", "own"), "repeated-ids")
    if again.isEmpty():
        return classes.withColumn("cid", F.col("doc"))
    own = F.col("own").isNull() | (F.col("own") == F.col("key"))
    return materialize(classes.join(again, "doc", "left").withColumn("cid", F.when(own, F.col("doc")).otherwise(F.xxhash64("key"))).drop("own"), "classes")


def _judged(docs: DataFrame) -> DataFrame:
    """What ``join`` returns of the rows with a doc_id, with their text_hash and text group."""
    signed = materialize(sign(docs), "signed")
    classes = _classes(signed)
    clusters = components(_candidates(classes)).select(F.col("node").alias("cid"), "root")
    # members with their texts, dealt into blocks of bounded size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    members = materialize(clusters.join(classes, "cid").join(texts, "doc"), "members")
    size = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(size, "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "key", "copies", "block", "sig", "text")
    found = materialize(_verify(units), "verified")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = materialize(components(found.select(F.col("cid").alias("u"), F.col("tied").alias("v"))).select(F.col("node").alias("cid"), F.col("root").alias("group")), "groups")
    # a group goes by its smallest doc_id
    named = groups.join(classes.select("cid", "doc"), "cid").groupBy("group").agg(F.min("doc").alias("class_id"))
    of_class = (classes.select("key", "cid", "doc", "copies").join(links, "key", "left").join(groups.join(named, "group"), "cid", "left")
                       .select("key", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("group", "cid").alias("group"),
                               (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows = signed.select("doc_id", "key", "text_hash").join(of_class, "key", "left")
    rows = rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group", "text_hash")
    return rows.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the near-duplicate group), n_links
    (other rows at or above the threshold) and kept, one row per row.  Texts
    that share a doc_id are judged each for itself."""
    nameless = docs.where(F.col("doc_id").isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return _judged(docs).select("doc_id", "class_id", "n_links", "kept").unionByName(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, all columns as they came; rows without a doc_id stay."""
    kept = _judged(docs).where("kept").groupBy("doc_id", "group").agg(F.min("text_hash").alias("_text_hash")).select("doc_id", "_text_hash").distinct()
    named = (docs.where(F.col("doc_id").isNotNull()).withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
                 .join(kept, ["doc_id", "_text_hash"], "left_semi").dropDuplicates(["doc_id", "_text_hash"]))
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
