"""Operator 4: BPE encoding and decoding with forced-boundary splitting.

A merge can only ever join two neighbours that stand side by side inside
some vocabulary token.  A pair of neighbouring bytes that no token contains
is therefore a certain cut: no merge crosses it, so the fragments left and
right of it are encoded on their own and their ids concatenated.  Fragments
are short and repeat, so a bounded table remembers them.

The work runs in ``mapInArrow``: rows are independent, nothing is shuffled,
a lost task is recomputed from its input split alone.

Defined results: null and empty texts give no ids and an empty decoded
text; repeated rows are encoded once each; further columns pass by.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, read, tidy

# A worker's word and fragment tables hold twice so many entries at most, none
# of a longer key: some tens of MB, whatever the texts.
CACHE_ENTRIES = 150_000
CACHE_KEY = 48
# Texts of about so many bytes are encoded before their rows are sent on.
SLICE_BYTES = 1 << 20
# A text is cut before white space into pieces of about this many characters.
PIECE_CHARS = 1 << 20
# Longer fragments are merged with a heap instead of repeated scans.
SCAN_SYMBOLS = 64

# Texts with characters outside Latin (to U+024F) and common punctuation take
# the library's own normalizer and splitter; NFC leaves the others alone.
_UNUSUAL = regex.compile(r"[^\x00-ɏ‐-‧‰-⁞€]")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0D\x20\x85\xA0\p{L}\p{N}]+")
_SPACE = regex.compile(r"[\x09-\x0D\x20]")
_END = "</w>"


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others count up from U+0100."""
    table = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - 188)
    return [table[b] for b in range(256)]


class Table(dict):
    """A bounded memo: computes what it lacks.  When full, it starts anew with
    the keys that are met again."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        self.older = {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
            if len(key) > CACHE_KEY:
                return value
        if len(self) >= CACHE_ENTRIES:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = self.vocab | self.added
        self.names = {i: t for t, i in self.ids.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.inside = {p for t in self.vocab for p in self._pairs(self._symbols(t))}
        self.library = Tokenizer.from_file(path)
        self.bytes = byte_chars()
        self.fragments = Table(self._merge)
        self.plain = Table(lambda w: self._word("".join([self.bytes[b] for b in w.encode("utf-8")])))
        self.mapped = Table(self._word)

    @staticmethod
    def _symbols(token: str) -> list[str]:
        if not token.endswith(_END):
            return list(token)
        own = list(token[: -len(_END)])
        return [*own[:-1], own[-1] + _END]

    @staticmethod
    def _pairs(symbols: list[str]):
        return zip(symbols, symbols[1:])

    def cut(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Fragments between the certain cuts."""
        if self.inside.issuperset(self._pairs(symbols)):
            return [tuple(symbols)]
        out, start = [], 0
        for k, pair in enumerate(self._pairs(symbols), 1):
            if pair not in self.inside:
                out.append(tuple(symbols[start:k]))
                start = k
        out.append(tuple(symbols[start:]))
        return out

    def _word(self, word: str) -> str:
        """Token names, joined by a space, which no token holds: they take the
        least room in the tables."""
        cut = self.cut(self._symbols(word + _END))
        # the word tables remember a word that is one fragment
        return self._merge(cut[0]) if len(cut) == 1 else " ".join([self.fragments[f] for f in cut])

    def _merge(self, symbols: tuple[str, ...]) -> str:
        if len(symbols) > SCAN_SYMBOLS:
            return self._merge_long(symbols)
        parts, rank, never = list(symbols), self.rank, 1 << 60
        ranks = [rank.get(p, never) for p in self._pairs(parts)]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((parts[k - 1], parts[k]), never)
            if k < len(ranks):
                ranks[k] = rank.get((parts[k], parts[k + 1]), never)
        return " ".join(parts)

    def _merge_long(self, symbols: tuple[str, ...]) -> str:
        parts: list[str | None] = list(symbols)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap = [(self.rank[p], k, *p) for k, p in enumerate(self._pairs(symbols)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            n = after[k]
            if parts[k] != a or n < 0 or parts[n] != b:
                continue
            parts[k], parts[n], after[k] = a + b, None, after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (p := (parts[left], parts[right])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], left, *p))
        return " ".join([p for p in parts if p is not None])

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS:
            stop = _SPACE.search(text, at + PIECE_CHARS)
            if stop is None:
                break
            yield text[at : stop.start()]
            at = stop.start()
        yield text[at:] if at else text

    def words(self, text: str) -> Iterator[list[str]]:
        """Lists of the words of the text as token names, in order."""
        parts = [text]
        if self.split_added and "<|" in text:
            parts = self.split_added.split(text)
        for part in parts:
            if part in self.added:
                yield [part]
                continue
            for piece in self._pieces(part):
                if _UNUSUAL.search(piece):
                    lib = self.library
                    found = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(piece))
                    yield [self.mapped[w] for w, _ in found]
                else:
                    yield list(map(self.plain.__getitem__, _WORDS.findall(piece.lower())))

    def encode(self, text: str | None) -> tuple[array, str]:
        """Ids and decoded text."""
        ids, decoded = array("i"), []
        for found in self.words(text or ""):
            if found:
                names = " ".join(found)
                ids.extend(map(self.ids.__getitem__, names.split(" ")))
                decoded.append(names)
        return ids, " ".join(decoded)

    def decode(self, ids) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def load(path: str) -> ForcedBoundaryBPE:
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose texts take about SLICE_BYTES: ids and
    decoded texts in Python take many times the room of the text."""
    at = taken = 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist(), 1):
        taken += n or 0
        if taken >= SLICE_BYTES or k == batch.num_rows:
            yield batch.slice(at, k - at)
            at, taken = k, 0


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` (array<int>) and ``decoded`` of every row.  The
    vocabulary file is read by each worker at ``path``."""
    path = path or tokenizer_path()
    bounded_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                ids, decoded = zip(*[bpe.encode(text.as_py()) for text in part.column(1)])
                offsets = [0, *accumulate(map(len, ids))]
                flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array(decoded, pa.string())],
                    names=[id_col, "ids", "decoded"])

    schema = T.StructType([T.StructField(id_col, src.schema["_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])
    return src.mapInArrow(tidy(run), schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        F.col(id_col), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op4_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    return digests(encode(read(spark, sf_dir, "documents")))
