"""Operator 13: frequent phrases and their collocation scores by dynamic
itemset counting.

The corpus is cut into shards, scanned in turn and over again.  Words are
counted from the start.  A phrase of k words becomes active as soon as both
its parts of k-1 words have reached the threshold, in the middle of a cycle;
it is counted from the next shard on until every shard has been its turn
once.  So lengths interleave: pairs are counted while the words' cycle still
runs.  The scans end when no shard has a phrase left to count.

Texts are cut into words once; the shards hold each text as the 64-bit hashes
of its words (language included), 0 after each piece.  During the scans a
phrase is a hash made of these: two that share one are counted together,
which makes a count too large, never too small.  One last scan, of the texts,
counts what reached the threshold by the phrases themselves, so the result is
exact.

Which phrases have reached the threshold is told to the tasks by a Bloom
filter of fixed size (FILTER_BITS), made by Spark.  It only ever grows, and
each shard remembers the filter of its last scan: an occurrence is counted
when its parts are in the filter now and were not both in it then, which is
once per phrase and shard.  A false positive counts a phrase that cannot
reach the threshold, as its parts have not: results are exact whatever the
filter's load.  The counts never leave Spark: partial counts of a group of
texts, merged with those of the rounds before, written to the shared folder;
phrases that end their cycle below the threshold go.

Texts: A-Z to lower case, cut at ``.,;:!?`` and line ends into pieces, these
into words at spaces and tabs.

Defined results: null and empty texts hold no words; a null language is
``und``; repeated rows count each; very long texts are whole; ties go by the
order of the result (score, count, phrase); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize, scratch_path

from .common import bounded_batches, read

MAX_WORDS = 5
MIN_COUNT = 100
# A phrase goes when a longer one holds it and has at least this percentage of its count.
SUBSUME_PERCENT = 100
TOP = 2000
SHARDS = 3
# Bits of the filter of phrases that reached the threshold (4 MB) and how many each sets.
FILTER_BITS = 1 << 25
FILTER_HASHES = 4
# Bytes of text, or of hashes, counted together in a task.
GROUP_BYTES = 8 << 20
# Rows of a task's spelled counts before they are summed up.
PARTIAL_ROWS = 1 << 20
# Splits of the texts that a task of the last scan sums up at most.
LAST_SPLITS = 16
# The language's best are found in so many parts first.
TOP_PARTS = 64

# 0 word, 1 space, 2 end of a piece
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)

HASHED = "h long, n long"
SPELLED = "lang string, k int, phrase string, n long"


class Filter:
    """Bloom filter over 64-bit phrase hashes, as 64-bit blocks of bits."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    def has(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.blocks) * 64 - 1)
        at, step = h & mask, ((h >> np.uint64(32)) & mask) | np.uint64(1)
        out = np.ones(len(h), bool)
        for _ in range(FILTER_HASHES):
            out &= ((self.blocks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            at = (at + step) & mask
        return out


def filter_blocks(reached: DataFrame, bits: int) -> np.ndarray:
    """The filter of the rows' hashes ``h``: Spark sets the bits; at most bits / 64 rows come to the driver."""
    mask = bits - 1
    at, step = F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(1).cast("long"))
    places = F.array(*[(at + step * k).bitwiseAND(F.lit(mask)) for k in range(FILTER_HASHES)])
    rows = (reached.select(F.explode(places).alias("p"))
                   .groupBy(F.shiftright("p", 6).alias("block"))
                   .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("word")).toArrow())
    blocks = np.zeros(bits // 64, np.uint64)
    blocks[rows["block"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return blocks


def _hash(parent: np.ndarray, last: np.ndarray) -> np.ndarray:
    x = (parent ^ (parent >> np.uint64(29))) * _MIX + last
    return x ^ (x >> np.uint64(32))


class Places:
    """Words in order: the piece and the id of each, the hash of each id."""

    def __init__(self, hashes: np.ndarray):
        """``hashes``: of the words in order, 0 after each piece."""
        ends = hashes == 0
        self.piece = np.cumsum(ends, dtype=np.int32)[~ends]
        coded = pa.array(hashes[~ends].view(np.int64)).dictionary_encode()
        self.id, self.hash = coded.indices.to_numpy(), coded.dictionary.to_numpy().view(np.uint64)

    def phrases(self, now: Filter, then: Filter | None) -> Iterator[tuple]:
        """Per length from 2 on, the phrases whose parts are in ``now``: for
        each (part, last word, hash), and the id of each place with whether
        its parts were not both in ``then``.  A part is an id of the length before."""
        ident, h = self.id, self.hash
        is_now = now.has(h)[ident]
        is_then = then.has(h)[ident] if then is not None else np.zeros(len(ident), bool)
        for k in range(2, MAX_WORDS + 1):
            m = max(len(self.id) - k + 1, 0)
            at = np.flatnonzero(is_now[:m] & is_now[1 : m + 1] & (self.piece[:m] == self.piece[k - 1 :]))
            if not len(at):
                return
            coded = pa.array((ident[at].astype(np.int64) << 32) + self.id[at + k - 1]).dictionary_encode()
            idx, own = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            part, last = own >> 32, own & 0xFFFFFFFF
            h = _hash(h[part], self.hash[last])
            yield k, part, last, h, idx, ~(is_then[at] & is_then[at + 1])
            ident = np.zeros(m, np.int32)
            ident[at] = idx
            is_now, is_then = np.zeros(m, bool), np.zeros(m, bool)
            is_now[at] = now.has(h)[idx]
            if then is not None:
                is_then[at] = then.has(h)[idx]


class Texts(Places):
    """The words of a group of texts, with their document and language, and
    the spelling and language of each id."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = pc.binary_join_element_wise(pc.cast(texts, pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        self.doc = np.searchsorted(offsets[1:] - offsets[0], start, side="right")
        cut = np.append(0, np.cumsum(stop - start)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(cut), pa.py_buffer(raw[inside])).dictionary_encode()
        lang = langs.dictionary_encode()
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy()[self.doc]
        coded = pa.array((self.lang.astype(np.int64) << 32) + words.indices.to_numpy()).dictionary_encode()
        self.id, own = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        self.word_lang, self.word = self.langs.take(pa.array(own >> 32)), words.dictionary.take(pa.array(own & 0xFFFFFFFF))
        prefix = [x.encode() + b"\x00" for x in self.langs.to_pylist()]
        # 0 ends a piece
        self.hash = np.array([xxhash.xxh64_intdigest(prefix[c] + w.as_buffer().to_pybytes()) or 1 for c, w in zip((own >> 32).tolist(), self.word)], np.uint64)


def hashed(langs: pa.Array, texts: pa.Array) -> pa.ListArray:
    """Each text as the hashes of its words, 0 after each piece."""
    t = Texts(langs, texts)
    ends = np.flatnonzero(np.diff(t.piece, append=-1))  # the last word of each piece
    flat = np.insert(t.hash[t.id], ends + 1, np.uint64(0))
    size = np.bincount(t.doc, minlength=len(texts)) + np.bincount(t.doc[ends], minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat.view(np.int64)))


def count_hashes(places: Places, now: Filter | None, then: Filter | None) -> pa.RecordBatch:
    """(h, n): words in a shard's first scan (no ``then``), longer phrases whose
    parts are in ``now`` and not both in ``then``."""
    found = [(places.hash, np.bincount(places.id, minlength=len(places.hash)))] if then is None else []
    if now is not None:
        found += [(h, np.bincount(idx[fresh], minlength=len(h))) for *_, h, idx, fresh in places.phrases(now, then)]
    h, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keep = n > 0
    return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["h", "n"])


def count_phrases_of(places: Texts, reached: Filter) -> Iterator[pa.RecordBatch]:
    """(lang, k, phrase, n) of the phrases in the filter; k = 0: the words of a language in all."""
    names = ["lang", "k", "phrase", "n"]

    def rows(k: int, lang: pa.Array, text: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), k, np.int32)), pc.cast(text, pa.string()), pa.array(n.astype(np.int64))], names=names)

    total = np.bincount(places.lang, minlength=len(places.langs))
    yield rows(0, places.langs, pa.array([""] * len(total), pa.string()), total)
    # the spelling of the phrases of one length that are in the filter, and where each id's is
    own = np.flatnonzero(reached.has(places.hash))
    spelled, where = places.word.take(pa.array(own)), np.zeros(len(places.hash), np.int64)
    where[own] = np.arange(len(own))
    yield rows(1, places.word_lang.take(pa.array(own)), spelled, np.bincount(places.id, minlength=len(places.hash))[own])
    for k, part, last, h, idx, _ in places.phrases(reached, None):
        own = np.flatnonzero(reached.has(h))
        end = pa.array(last[own])
        spelled = pc.binary_join_element_wise(spelled.take(pa.array(where[part[own]])), places.word.take(end), pa.scalar(" ", pa.large_string()))
        where = np.zeros(len(h), np.int64)
        where[own] = np.arange(len(own))
        yield rows(k, places.word_lang.take(end), spelled, np.bincount(idx, minlength=len(h))[own])


def shard_words(docs: DataFrame, shards: int) -> DataFrame:
    """(words, shard): the hashed texts, dealt over the shards row by row,
    written once to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _cuts(pa.chunked_array([b.column(1)])):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([hashed(*part.columns)], names=["words"])

    path = scratch_path(docs.sparkSession, "phrase-shards")
    (docs.mapInArrow(run, "words array<long>").withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
         .write.option("compression", "zstd").partitionBy("shard").parquet(path))
    return docs.sparkSession.read.schema("words array<long>, shard int").parquet(path)


def scan_round(shard: DataFrame, now, then) -> DataFrame:
    """(h, n) of a shard; ``now`` and ``then`` are broadcast filter blocks or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = Filter(now.value) if now is not None else None
        old = Filter(then.value) if then is not None else None
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            return count_hashes(Places(np.concatenate(held)), new, old)

        for b in batches:
            held.append(pc.list_flatten(b.column(0)).to_numpy().view(np.uint64))
            if sum(x.nbytes for x in held) >= GROUP_BYTES:
                yield counted()
                held = []
        if held:
            yield counted()

    return shard.select("words").mapInArrow(run, HASHED)


def scan_last(docs: DataFrame, reached) -> DataFrame:
    """(lang, k, phrase, n) of the phrases in the broadcast filter, summed up per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(reached.value)
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "k", "phrase"], use_threads=False).aggregate([("n", "sum")])
            return t.select(["lang", "k", "phrase", "n_sum"]).rename_columns(["lang", "k", "phrase", "n"])

        for b in batches:
            for lo, hi in _cuts(pa.chunked_array([b.column(1)])):
                texts = Texts(*b.slice(lo, hi - lo).columns)
                if len(texts.id):
                    held.append(pa.Table.from_batches(list(count_phrases_of(texts, known))))
            if sum(t.num_rows for t in held) > PARTIAL_ROWS:
                t = summed()
                if t.num_rows > PARTIAL_ROWS // 2:
                    yield from t.to_batches()
                    t = t.slice(0, 0)
                held = [t]
        if held:
            yield from summed().to_batches()

    return docs.mapInArrow(run, SPELLED)


def gathered(docs: DataFrame) -> DataFrame:
    """The texts in no more tasks than run at once, but few splits in each: a
    phrase that comes everywhere is a row of every task's counts."""
    splits = docs.rdd.getNumPartitions()
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-splits // LAST_SPLITS)))


def _cuts(texts: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Row ranges of about GROUP_BYTES of text."""
    size = pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())).to_numpy()
    lo = 0
    while lo < len(size):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + GROUP_BYTES, side="right")))
        yield lo, hi
        lo = hi


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, k, phrase, n: exact counts of all phrases of 1 to MAX_WORDS words
    that come at least ``min_count`` times, and of a language's words (k = 0)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = shard_words(texts, shards)
    totals = spark.createDataFrame([], HASHED + ", since int")
    blocks, version = np.zeros(filter_bits // 64, np.uint64), 0
    seen: list[int | None] = [None] * shards  # version of the filter at each shard's last scan
    last: list[np.ndarray | None] = [None] * shards
    r = 0
    while any(v != version for v in seen):
        s = r % shards
        if seen[s] != version:
            now = spark.sparkContext.broadcast(blocks) if version else None
            # before the first scan nothing has been counted: words count, and all that is active
            then = spark.sparkContext.broadcast(last[s]) if last[s] is not None else None
            found = scan_round(words.where(F.col("shard") == s), now, then)
            totals = totals.unionByName(found.withColumn("since", F.lit(r))).groupBy("h").agg(F.sum("n").alias("n"), F.min("since").alias("since"))
            # a phrase first met in round q was active in it: round q + shards - 1 ends its cycle
            totals = materialize(totals.where((F.col("n") >= min_count) | (F.col("since") + (shards - 1) > r)), "phrase-counts")
            last[s], seen[s] = blocks, version
            for sent in (now, then):
                if sent is not None:
                    sent.unpersist()
            grown = blocks | filter_blocks(totals.where(F.col("n") >= min_count), filter_bits)
            if not np.array_equal(grown, blocks):
                blocks, version = grown, version + 1
        r += 1
    exact = scan_last(gathered(texts), spark.sparkContext.broadcast(blocks)).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return materialize(exact.where((F.col("k") == 0) | (F.col("n") >= min_count)), "phrases")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, subsume_percent: int = SUBSUME_PERCENT, top: int = TOP,
                 shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each language's ``top`` phrases of 2 to MAX_WORDS words by score:
    lang, rank, phrase, a, l, r, n, score."""
    counts = count_phrases(docs, min_count, shards, filter_bits)
    known = counts.where("k > 0").select("lang", "k", "phrase", F.col("n").alias("a"))
    # words hold no space: a phrase's parts are found by its spaces
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    long = known.where("k >= 2")
    parts = long.select("lang", "phrase", "k", "a", cut.alias("cut")).select(
        "*", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right"))
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    parts = parts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    # one row per language
    parts = parts.join(F.broadcast(counts.where("k = 0").select("lang", "n")), "lang")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    # 1000 a n and l r in up to 38 digits; the quotient is at most 1000 n / min_count
    whole = (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).alias("over"), (wide("l") * wide("r")).alias("under")
    parts = parts.select("lang", "phrase", "k", "a", "n", "cut", "l", "r", *whole).withColumn("score", F.expr("over div under"))
    best = parts.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # a longer phrase that holds it holds it in one a word longer, at least as frequent
    inner = long.where("k >= 3").select("lang", "a", F.explode(
        F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < F.lit(subsume_percent) * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    few = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# The same in SQL, every phrase counted: for tables one machine holds.
OP13_SQL = r"""
WITH words AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
occ AS (
  SELECT lang, unnest(flatten([list_transform(range(1, len(w) - k + 2), lambda i: {'k': k, 'phrase': array_to_string(w[i:i + k - 1], ' ')}) for k in range(1, 6)])) AS o
  FROM words),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
f AS (SELECT lang, o.k AS k, o.phrase AS phrase, count(*) AS a FROM occ GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT f.*, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k >= 2),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, t.n, c.j, x.a AS l, y.a AS r, ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ') JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = b.lang AND g.k > b.k AND 100 * g.a >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""


def op13_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
