"""Operator 2: toxicity as cumulative-link ordinal regression.

Severity is an ordered grade 0 < 1 < 2.  One weight vector is shared by all
thresholds: ``P(grade > k) = sigmoid(w.x - theta_k)`` with theta_0 <= theta_1,
and the expected severity is the sum of these probabilities.  ``x`` is sparse:
one value for each selected word or beginning of words in the text,
``log(1 + count)`` with the count of a text longer than usual (the median of
the sample) scaled down to that length, so repeating a text tells no more
than the text.  No value goes beyond the greatest that learning has seen for
its feature (``SEEN`` counts at least): the model does not extrapolate.

Labels give two grades (``labels.toxic``).  Toxic rows are divided at the
median count of marked words: grade 2 at or above it, grade 1 below.

Learning reads a bounded sample of the labelled rows (``FIT_ROWS``, taken by
a hash of doc_id).  Words are counted by Spark over that sample; those whose
chi-square against the label stands out from chance become features: by rank,
as far as ``FALSE_SHARE`` of them at most are expected by chance among all
words counted (Benjamini-Hochberg), so the cut follows the sample's size (at
most ``FEATURES``, the only thing the driver sees besides the sample's few
selected counts).
Scoring runs over the whole text of every row in ``mapInArrow``; nothing is
shuffled.

Defined results: null and empty texts have no features and get the severity
of an empty text (below the cut); labels that are null or neither 0 nor 1 are
left out; with labels of one kind only, every severity is 0; repeated rows
score alike; other columns pass by (``keep_clean`` returns them as they came).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import bounded_batches, read, tidy

FIT_ROWS = 20_000
FEATURES = 8_192
MIN_DOCS = 3
# Expected share of chance among the chosen features.
FALSE_SHARE = 0.4
BEGINNINGS = (3, 4, 5, 6, 7)
GRADES = 3
CUT = 0.5
CACHE_ENTRIES = 60_000
STEPS = 400
# Penalty over the whole sample: a prior on the weights, alike at every size.
RIDGE = 0.1
# Counts at a usual length up to which a feature grows, seen in learning or not.
SEEN = 3

_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[str, ...]:
    """The word, and how it begins."""
    return (word, *[word[:k] + "~" for k in BEGINNINGS if len(word) > k])


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def values(counts, words, usual: float):
    """Feature values of counts in texts of so many words."""
    return np.log1p(counts * np.minimum(1.0, usual / np.maximum(words, 1)))


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    theta: np.ndarray
    usual: float
    most: np.ndarray

    def score(self, counts: Counter, words: int) -> tuple[float, float, int]:
        """Expected severity, P(grade > 0), most likely grade."""
        n = len(counts)
        own = np.fromiter(counts.keys(), np.int64, n)
        z = self.weights[own] @ np.minimum(values(np.fromiter(counts.values(), np.float64, n), words, self.usual), self.most[own])
        above = 1 / (1 + np.exp(np.clip(self.theta - z, -50, 50)))
        if not len(above):
            return 0.0, 0.0, 0
        each = np.append(1.0, above) - np.append(above, 0.0)
        return float(above.sum()), float(above[0]), int(each.argmax())


def counter(index: dict[str, int]):
    """A function from a text to counts by feature number and its words."""
    memo: dict[str, tuple[int, ...]] = {}

    def count(text: str | None) -> tuple[Counter, int]:
        if len(memo) > CACHE_ENTRIES:
            memo.clear()
        out: Counter = Counter()
        words = words_of(text)
        for w, n in Counter(words).items():
            own = memo.get(w)
            if own is None:
                own = memo[w] = tuple(index[f] for f in features_of(w) if f in index)
            for k in own:
                out[k] += n
        return out, len(words)

    return count


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = FIT_ROWS / max(1, labels.count())
    if share < 1:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # at most about FIT_ROWS narrow rows
    return materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id"), "toxic-sample")


def select_features(sample: DataFrame) -> list[tuple[str, bool]]:
    """(feature, marks toxic rows) by chi-square over the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows and toxic rows of each feature, summed before the shuffle
        rows: Counter = Counter()
        toxic: Counter = Counter()

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([toxic[f] for f in rows], pa.int64()),
                                               pa.array(list(rows.values()), pa.int64())], names=["f", "a", "m"])

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {f for w in set(words_of(t)) for f in features_of(w)}
                rows.update(found)
                if y:
                    toxic.update(found)
                if len(rows) > CACHE_ENTRIES:
                    yield summed()
                    rows.clear()
                    toxic.clear()
        yield summed()

    seen = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(tidy(run), "f string, a long, m long")
    n = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    total, pos = n["n"], n["t"] or 0
    if not pos or pos == total:
        return []
    c = seen.groupBy("f").agg(F.sum("a").cast("double").alias("a"), F.sum("m").cast("double").alias("m"))
    a, m = F.col("a"), F.col("m")
    chi = total * F.pow(a * total - m * pos, 2) / (m * (total - m) * float(pos) * (total - pos))
    c = materialize(c.where((m >= MIN_DOCS) & (m < total)).withColumn("chi", chi), "toxic-features")
    top, tried = c.orderBy(F.desc("chi"), "f").limit(FEATURES).collect(), c.count()
    passed = [k for k, r in enumerate(top, 1) if math.erfc(math.sqrt(r["chi"] / 2)) <= FALSE_SHARE * k / tried]
    top = top[: passed[-1]] if passed else []
    return [(r["f"], r["a"] * total > r["m"] * pos) for r in top]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    bounded_batches(docs.sparkSession)
    sample = _sample(docs, labels)
    chosen = select_features(sample)
    if not chosen:
        return Model({}, np.zeros(0), np.zeros(0), 1.0, np.zeros(0))
    index = {f: k for k, (f, _) in enumerate(chosen)}
    marks = np.array([m for _, m in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(index)
        for b in batches:
            got = [count(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(g) for g, _ in got], pa.list_(pa.int32())),
                                              pa.array([list(g.values()) for g, _ in got], pa.list_(pa.int32())),
                                              pa.array([w for _, w in got], pa.int32()), b.column(1)], names=["k", "n", "words", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(tidy(run), "k array<int>, n array<int>, words int, toxic int").collect()
    grades = _grades([(r["k"], r["n"], r["toxic"]) for r in rows], marks)
    return _fit(index, [(r["k"], r["n"], r["words"]) for r in rows], grades)


def _grades(rows, marks) -> np.ndarray:
    hits = np.array([sum(n for k, n in zip(ks, ns) if marks[k]) for ks, ns, _ in rows])
    toxic = np.array([t == 1 for *_, t in rows])
    middle = np.median(hits[toxic]) if toxic.any() else 0
    return np.where(toxic, np.where(hits >= max(middle, 1), 2, 1), 0)


def _fit(index, rows, grades: np.ndarray) -> Model:
    """Full-batch Adam on the cumulative-link likelihood."""
    doc = np.repeat(np.arange(len(rows)), [len(k) for k, *_ in rows])
    col = np.array([x for k, *_ in rows for x in k], dtype=np.int64)
    words = np.array([w for *_, w in rows], dtype=np.float64)
    usual = float(np.median(words[words > 0])) if (words > 0).any() else 1.0
    val = values(np.array([x for _, n, _ in rows for x in n], dtype=np.float64), words[doc], usual)
    most = np.full(len(index), np.log1p(SEEN))
    np.maximum.at(most, col, val)
    over = grades[:, None] > np.arange(GRADES - 1)[None, :]
    w, raw = np.zeros(len(index)), np.array([1.0, 0.0])  # theta = raw_0, raw_0 + exp(raw_1), ...
    m, v = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    for step in range(1, STEPS + 1):
        theta = raw[0] + np.append(0.0, np.cumsum(np.exp(raw[1:])))
        z = np.bincount(doc, val * w[col], len(rows)) if len(col) else np.zeros(len(rows))
        s = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -50, 50)))
        # P(grade) = P(> grade-1) - P(> grade); the gradient of its log
        up = np.where(grades > 0, s[np.arange(len(s)), np.maximum(grades - 1, 0)], 1.0)
        down = np.where(grades < GRADES - 1, s[np.arange(len(s)), np.minimum(grades, GRADES - 2)], 0.0)
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        gz = d_up - d_down
        g_theta = np.zeros(GRADES - 1)
        np.add.at(g_theta, np.maximum(grades - 1, 0)[grades > 0], -d_up[grades > 0])
        np.add.at(g_theta, np.minimum(grades, GRADES - 2)[grades < GRADES - 1], d_down[grades < GRADES - 1])
        g_raw = np.append(g_theta.sum(), [g_theta[k:].sum() * np.exp(raw[k]) for k in range(1, GRADES - 1)])
        gw = np.bincount(col, val * gz[doc], len(w)) if len(col) else np.zeros(len(w))
        g = np.append(gw - RIDGE * w, g_raw) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = w + move[: len(w)], raw + move[len(w):]
    return Model(index, w, raw[0] + np.append(0.0, np.cumsum(np.exp(raw[1:]))), usual, most)


def score(df: DataFrame, model: Model, keep=("doc_id",), text_in: str | None = None) -> DataFrame:
    """The kept columns with severity, p_toxic, grade and toxic of every row.
    ``text_in``: the kept column, a struct, whose field ``text`` is judged."""
    bounded_batches(df.sparkSession)
    # the text goes to the workers once, also where the kept row holds it
    src = df.select(*keep) if text_in else df.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*(src.schema[c] for c in keep), T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()),
                           T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])

    at = src.schema[text_in].dataType.names.index("text") if text_in else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.index)
        for b in batches:
            texts = b.column(len(keep)) if text_in is None else b.column(list(keep).index(text_in)).flatten()[at]
            got = [model.score(*count(t)) for t in texts.to_pylist()]
            sev, p, grade = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(sev, pa.float64()), pa.array(p, pa.float64()), pa.array(grade, pa.int32()),
                 pa.array([x >= CUT for x in p], pa.bool_())], names=schema.names)

    return src.mapInArrow(tidy(run), schema)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they came."""
    model = fit(docs, labels)
    scored = score(docs.select(F.struct("*").alias("row")), model, keep=("row",), text_in="row")
    return scored.where(~F.col("toxic")).select("row.*")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
