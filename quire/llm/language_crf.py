"""Operator 11: language of words and texts by a linear-chain conditional
random field.

Every word of a sentence gets a label.  Its features are its beginnings and
ends (affixes), its character n-grams with the word's borders, and the word
itself where the lexicon of the training sample has it; what follows what is
a learned matrix of transitions.  Forward and backward sums give each word
the probability of each language.  A text's language is the one with the
greatest sum over its words, the score its mean probability.

Training texts are of one language each, so the field would learn that
languages never change within a sentence: a part of the training sequences
(SWITCH_SHARE) is made of two pieces of different languages.

The sample is bounded: SAMPLE_DOCS texts a language, of these SAMPLE_WORDS
words; languages beyond the LANGS most frequent are not learned.  It is
fitted on the driver (full-batch Adam) and the table of features seen goes
to every task.  Texts are judged whole, in ``mapInArrow``; nothing is
shuffled.  All sentences of a batch advance together, the longest last.

Words are runs of letters and other non-ASCII characters; sentences end at
``. ! ?`` and line ends; A-Z and a-z count as one.

Defined results: null texts, and texts without a letter, are ``und`` with
score 0, as all texts are when there is nothing to learn from; a null id is
held out; repeated rows are judged each; ties go to the label first in code
points; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, read

UNKNOWN = "und"
FOLDS = 5
# Bounds of the training sample.
LANGS = 500
SAMPLE_DOCS = 400
SAMPLE_WORDS = 25_000
# Longest training sequence in words, longest training sentence in characters.
SEQUENCE_WORDS = 40
SENTENCE_CHARS = 10_000
# Part of the training sequences that changes its language once.
SWITCH_SHARE = 0.2
# A word comes so often in the sample to be in the lexicon.
LEXICON_COUNT = 3
AFFIX_CHARS = 4
GRAM_CHARS = 3
STEPS = 60
RATE = 0.2
RIDGE = 0.02
# Words a worker remembers the scores of; words whose sums are held at once.
CACHE_WORDS = 400_000
BLOCK_WORDS = 1 << 20

# 0 part of a word, 1 between words, 2 end of a sentence
_KIND = np.ones(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_KIND[[*b".!?\n\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def features(word: str, lexicon) -> set[str]:
    """A word's features: its n-grams between border marks, its affixes (which
    hold a mark), and the whole word where ``lexicon`` has it."""
    marked = f"^{word}$"
    found = {marked[k : k + n] for n in range(1, GRAM_CHARS + 1) for k in range(len(marked) - n + 1)}
    for n in range(GRAM_CHARS + 1, AFFIX_CHARS + 2):
        found.add(marked[:n])
        found.add(marked[-n:])
    if word in lexicon:
        found.add(marked)
    return found


def letters(word: str) -> str:
    """The letters of a word in lower case; '' where it has none."""
    word = word.lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class Words:
    """The words of a column of texts: sentence, document, byte range and code of each."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        self.texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        t = self.texts
        offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
        self.raw = np.frombuffer(t.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(t) else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        kind = _KIND[self.raw]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        self.sentence = np.cumsum(kind == 2, dtype=np.int64)[self.start]
        self.doc = np.searchsorted(self.offsets[1:], self.start, side="right")
        cut = np.append(0, np.cumsum(self.stop - self.start)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(cut), pa.py_buffer(_LOWER[self.raw[inside]])).dictionary_encode()
        self.code, self.unique = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()

    def keep(self, mask: np.ndarray) -> None:
        for name in ("start", "stop", "sentence", "doc", "code"):
            setattr(self, name, getattr(self, name)[mask])

    def sequences(self) -> np.ndarray:
        """Where each sentence's words begin, and the end."""
        return np.append(np.flatnonzero(np.diff(self.sentence, prepend=-1)), len(self.start))


def forward_backward(psi: np.ndarray, cut: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward sums, backward sums (both scaled to 1 a word) and label
    probabilities of each word.  ``psi``: label weights of each word;
    ``cut``: where sequences begin, and the end; ``first``, ``move``: weights
    of a sequence's first label and of one label after another."""
    n, k = psi.shape
    fore, back = np.empty((n, k)), np.full((n, k), 1.0 / k)
    size = np.diff(cut)
    order = np.argsort(-size, kind="stable")
    begin, end, size = cut[:-1][order], cut[1:][order] - 1, size[order]
    longest = int(size[0]) if len(size) else 0
    # how many sequences are longer than t: all advance together
    live = np.searchsorted(-size, -np.arange(longest), side="left")
    for t in range(longest):
        at = begin[: live[t]] + t
        a = psi[at] * (first if t == 0 else fore[at - 1] @ move)
        fore[at] = a / a.sum(1, keepdims=True)
    for t in range(1, longest):
        at = end[: live[t]] - t
        b = (psi[at + 1] * back[at + 1]) @ move.T
        back[at] = b / b.sum(1, keepdims=True)
    both = fore * back
    return fore, back, both / both.sum(1, keepdims=True)


class Model:
    """Labels, place of each feature seen, weights, lexicon and transitions."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, lexicon: frozenset, first: np.ndarray, move: np.ndarray):
        self.labels, self.index, self.weights, self.lexicon, self.first, self.move = labels, index, weights, lexicon, first, move


class Scorer:
    """Label weights of words under a model, remembered up to CACHE_WORDS."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.labels)))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: weights of the labels, and whether it has a letter."""
        if len(self.place) + len(words) > CACHE_WORDS:
            self.place.clear()
        new = [w for w in words if w not in self.place]
        if new:
            self._learn(new)
        at = np.array([self.place[w] for w in words], np.int64)
        return self.table[at], self.table[at, 0] > 0

    def _learn(self, new: list[str]) -> None:
        m, base = self.model, len(self.place)
        while base + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        index, flat, row, size = m.index, [], [], np.zeros(len(new))
        for k, w in enumerate(new):
            c = letters(w)
            if c:
                found = features(c, m.lexicon)
                size[k] = len(found)
                known = [index[f] for f in found if f in index]
                flat += known
                row += [k] * len(known)
        at, row = np.array(flat, np.int64), np.array(row, np.int64)
        share = 1 / np.sqrt(np.maximum(size, 1))
        score = np.stack([np.bincount(row, w[at], len(new)) for w in m.weights.T], 1) * share[:, None]
        psi = np.exp(score - score.max(1, keepdims=True))
        # no letter, no label: zeros
        self.table[base : base + len(new)] = np.where(size[:, None] > 0, np.maximum(psi, 1e-12), 0)
        self.place |= {w: base + k for k, w in enumerate(new)}


def _probabilities(words: Words, scorer: Scorer) -> np.ndarray:
    """Label probabilities of each word; words without a letter are taken out."""
    psi, lettered = scorer(words.unique)
    if not lettered.all():
        words.keep(lettered[words.code])
    cut = words.sequences()
    out = np.empty((len(words.start), len(scorer.model.labels)))
    lo = 0
    while lo < len(cut) - 1:
        # whole sentences, about BLOCK_WORDS words at a time
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + BLOCK_WORDS, side="right")) - 1)
        here = slice(cut[lo], cut[hi])
        out[here] = forward_backward(psi[words.code[here]], cut[lo : hi + 1] - cut[lo], scorer.model.first, scorer.model.move)[2]
        lo = hi
    return out


def held_out(doc_id: Column) -> Column:
    """Fold 0 of FOLDS; rows without an id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, sentence) of at most SAMPLE_DOCS texts a language, by hash."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h")).where("lang is not null and text is not null")
    count = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not count:
        return []
    share = F.create_map(*[F.lit(x) for r in count for x in (r["lang"], int(min(1.0, SAMPLE_DOCS / r["count"]) * (1 << 30)))])
    some = rows.where(F.col("h") < F.try_element_at(share, F.col("lang"))).limit(2 * SAMPLE_DOCS * len(count))
    said = some.select("lang", "h", F.posexplode(F.split("text", r"[.!?\n\r]+")).alias("pos", "sentence"))
    said = said.where(F.length("sentence").between(1, SENTENCE_CHARS)).withColumn("h", F.xxhash64("sentence", "h", "pos"))
    # sentences of at least one word each: no more of them are needed than words
    return [(r["lang"], r["sentence"]) for r in said.orderBy("h", "sentence").limit(SAMPLE_WORDS * len(count)).select("lang", "sentence").collect()]


def _sequences(sample: list[tuple[str, str]], labels: list[str]) -> tuple[list[list[str]], list[list[int]]]:
    """Training sequences (words, label of each): pieces of sentences, some of two languages."""
    pick = np.random.default_rng(11)
    pieces: list[list[list[str]]] = [[] for _ in labels]
    left = [SAMPLE_WORDS] * len(labels)
    index = {x: k for k, x in enumerate(labels)}
    for lang, text in sample:
        y = index[lang]
        w = Words(pa.array([text]))
        own = [c for k in w.code.tolist() if (c := letters(w.unique[k]))][: left[y]]
        left[y] -= len(own)
        pieces[y] += [own[k : k + SEQUENCE_WORDS] for k in range(0, len(own), SEQUENCE_WORDS)]
    words, ys = [], []
    for y, own in enumerate(pieces):
        others = [k for k in range(len(labels)) if k != y and pieces[k]]
        for p in own:
            if others and len(p) > 1 and pick.random() < SWITCH_SHARE:
                z = int(pick.choice(others))
                q = pieces[z][int(pick.integers(len(pieces[z])))]
                i, j = int(pick.integers(1, len(p) + 1)), int(pick.integers(0, len(q)))
                words.append(p[:i] + q[j:])
                ys.append([y] * i + [z] * (len(q) - j))
            else:
                words.append(p)
                ys.append([y] * len(p))
    return words, ys


def fit(docs: DataFrame) -> Model:
    """The field learned from ``doc_id``, ``text`` and ``lang`` of ``docs``."""
    sample = _sample(docs)
    labels = sorted({lang for lang, _ in sample})
    words, ys = _sequences(sample, labels)
    words, ys = [w for w in words if w], [y for w, y in zip(words, ys) if w]
    k = len(labels)
    if not words:
        return Model([], {}, np.zeros((0, 0)), frozenset(), np.zeros(0), np.zeros((0, 0)))
    cut = np.append(0, np.cumsum([len(w) for w in words]))
    coded = pa.array([w for own in words for w in own], pa.large_string()).dictionary_encode()
    code, unique = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    y = np.array([z for own in ys for z in own])
    seen = np.bincount(code)
    lexicon = frozenset(w for w, n in zip(unique, seen) if n >= LEXICON_COUNT)
    found = [features(w, lexicon) for w in unique]
    size = np.array([len(f) for f in found])
    index: dict[str, int] = {}
    col = np.array([index.setdefault(x, len(index)) for f in found for x in sorted(f)])
    row = np.repeat(np.arange(len(unique)), size)
    share = 1 / np.sqrt(size)
    inner = np.ones(len(code), bool)
    inner[cut[:-1]] = False  # words with one before them
    later = np.flatnonzero(inner)
    target = np.zeros((len(code), k))
    target[np.arange(len(code)), y] = 1
    true_first, true_move = target[cut[:-1]].mean(0), np.zeros((k, k))
    np.add.at(true_move, (y[later - 1], y[later]), 1)
    w, first, move = np.zeros((len(index), k)), np.zeros(k), np.zeros((k, k))
    params, moments = [w, first, move], [(np.zeros_like(p), np.zeros_like(p)) for p in (w, first, move)]
    for step in range(1, STEPS + 1):
        score = np.stack([np.bincount(row, w[col, c], len(unique)) for c in range(k)], 1) * share[:, None]
        psi = np.exp(score - score.max(1, keepdims=True))[code]
        start, turn = np.exp(first - first.max()), np.exp(move - move.max())
        fore, back, p = forward_backward(psi, cut, start, turn)
        ahead = psi[later] * back[later]
        scale = ((fore[later - 1] @ turn) * ahead).sum(1)
        expected = turn * (fore[later - 1].T @ (ahead / scale[:, None]))
        miss = target - p
        of_word = np.stack([np.bincount(code, miss[:, c], len(unique)) for c in range(k)], 1) * share[:, None]
        grads = [np.stack([np.bincount(col, of_word[row, c], len(index)) for c in range(k)], 1) - RIDGE * w,
                 (true_first - p[cut[:-1]].mean(0)) * len(words) - RIDGE * first, true_move - expected - RIDGE * move]
        for q, g, (m, v) in zip(params, grads, moments):
            g = g / len(words)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(labels, index, w, lexicon, np.exp(first - first.max()), np.exp(move - move.max()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, and n_words, the words judged."""
    bounded_batches(docs.sparkSession)
    src = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            rows = b.num_rows
            lang, score, n = np.full(rows, UNKNOWN, object), np.zeros(rows), np.zeros(rows, np.int64)
            if model.labels and rows:
                words = Words(b.column(2))
                p = _probabilities(words, scorer)
                sums = np.stack([np.bincount(words.doc, p[:, c], rows) for c in range(len(model.labels))], 1)
                n = np.bincount(words.doc, minlength=rows)
                best = sums.argmax(1)
                lang = np.where(n > 0, np.array(model.labels, object)[best], UNKNOWN)
                score = np.minimum(sums[np.arange(rows), best] / np.maximum(n, 1), 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def label_runs(docs: DataFrame, model: Model) -> DataFrame:
    """Code-switched text as runs of words of one language: doc_id, run (from
    0), lang, n_words, text (from the run's first word to its last), score
    (the words' mean probability).  A run ends with its sentence."""
    bounded_batches(docs.sparkSession)
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("run", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            if not model.labels or not b.num_rows:
                continue
            words = Words(b.column(1))
            p = _probabilities(words, scorer)
            if not len(p):
                continue
            best = p.argmax(1)
            new = (np.diff(words.sentence, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0)
            lo = np.flatnonzero(new)
            size = np.diff(np.append(lo, len(best)))
            doc = words.doc[lo]
            number = np.arange(len(lo)) - np.searchsorted(doc, doc)
            text = [words.raw[i:j].tobytes().decode() for i, j in zip(words.start[lo].tolist(), words.stop[lo + size - 1].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(number, pa.int64()), pa.array([model.labels[k] for k in best[lo]], pa.string()), pa.array(size, pa.int64()),
                 pa.array(text, pa.string()), pa.array(np.add.reduceat(p[np.arange(len(best)), best], lo) / size)], names=schema.names)

    return src.mapInArrow(run, schema)


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out(F.col("doc_id")))))
