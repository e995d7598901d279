"""Operator 12: align the tokens of two tokenizers over the same bytes.

A is a byte-level BPE, B a sentence-piece BPE.  Both cut the same bytes (a
space and the text), so a token is known by the byte at which it ends.  The
work is columns in Arrow, a batch of texts at a time:

* the ids of a batch are one list column; flattened, with parent indices,
  their byte lengths summed up give every token's end.  The sum runs on over
  the batch, and a text starts where the one before it ended, so (text, end)
  is one number: the document-end key;
* an Acero hash join of A and B on that key gives the ends both have (the
  groups); the full outer join, in key order, is the list of links: between
  two neighbouring ends lie one A and one B token, which are the next ones
  that end;
* ``group_by`` counts the id pairs of a text, and again of a task; Spark
  merges these partial counts.

The counts of all pairs are a table.  Its frequent head - pairs with at least
1 / HEAD_PAIRS of all links, so never more than HEAD_PAIRS of them - goes to
every task; what is left of each text meets the table in a shuffle join.  The
best count of each B id has at most as many rows as B has ids.

The links of each text are written once to the shared folder: nothing is
encoded twice, and a lost task repeats its own input split only.

Defined results: null and empty texts, and texts that either tokenizer does
not give back byte by byte, have no tokens: zeros and '' as digest.  Repeated
rows and ids are rows of their own and each counts; a null doc_id stays; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import scratch_path

from .bpe import byte_chars
from .common import bounded_batches, read

BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
# Pairs that go to every task: a pair among them holds at least this part of all links.
HEAD_PAIRS = 1 << 19
# Rows of a task's partial counts before they are summed up.
PARTIAL_ROWS = 1 << 20

# fixed value: how the byte-level tokenizer splits a text before merging
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DIGEST = ("n_a", "n_b", "n_groups", "n_links")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokenizer:
    """Tokenizer A: ids of space + text; special tokens' strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_chars())}
        special = {t["content"] for t in spec["added_tokens"]}
        entries = {t: k for t, k in spec["model"]["vocab"].items() if t not in special}
        self.names: list[bytes] = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, k in entries.items():
            self.names[k] = bytes(back[c] for c in t)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        order = [entries["".join(m)] for m in merges]
        split = spec["pre_tokenizer"]
        ranked = order == sorted(order) and spec["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if ranked:
            # ids count up in merge order: they are the ranks, and the quicker encoder gives the same ids
            import tiktoken

            self.encode = tiktoken.Encoding("a", pat_str=BYTE_SPLIT, mergeable_ranks={b: k for k, b in enumerate(self.names) if b}, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(path)
            lib.encode_special_tokens = True
            lib.no_truncation()
            lib.no_padding()
            self.encode = lambda text: lib.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(" " + t) for t in texts]


class PieceTokenizer:
    """Tokenizer B: ids of text; the tokenizer puts the space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.lib
        self.names = [bytes([int(p[3:5], 16)]) if lib.is_byte(k) else b"" if lib.is_control(k) or lib.is_unknown(k)
                      else p.replace("▁", " ").encode() for k, p in ((k, lib.id_to_piece(k)) for k in range(lib.get_piece_size()))]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, num_threads=1) if texts else []


class Side:
    """A tokenizer with the bytes, byte lengths and decimal names of its ids as Arrow columns."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.bytes = pa.array(tokenizer.names, pa.large_binary())
        self.length = pc.cast(pc.binary_length(self.bytes), pa.int64())
        self.decimal = pc.cast(pa.array(range(len(tokenizer.names)), pa.int32()), pa.large_string())

    def ids(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.tokenizer(texts), pa.list_(pa.int32()))

    def given_back(self, ids: pa.ListArray, want: list[bytes]) -> np.ndarray:
        """Which lists of ids stand for the wanted bytes."""
        flat = pc.list_flatten(ids)
        whole = pc.take(self.bytes, flat)
        ends = np.append(0, np.cumsum(pc.take(self.length, flat).to_numpy()))
        cut = ends[ids.offsets.to_numpy()]
        data = memoryview(whole.buffers()[2] or b"").cast("B")[: ends[-1]]
        if data == b"".join(want) and np.array_equal(np.diff(cut), [len(w) for w in want]):
            return np.ones(len(want), bool)
        return np.array([data[i:j] == w for i, j, w in zip(cut[:-1].tolist(), cut[1:].tolist(), want)], bool)

    def ends(self, ids: pa.ListArray, name: str) -> pa.Table:
        """Document-end key and id of every token, in order."""
        flat = pc.list_flatten(ids)
        return pa.table({"key": pc.cumulative_sum(pc.take(self.length, flat)), name: flat})


@functools.cache
def sides(byte_path: str, piece_path: str) -> tuple[Side, Side]:
    """Both tokenizers, made once per worker."""
    return Side(ByteTokenizer(byte_path)), Side(PieceTokenizer(piece_path))


def mark(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _joined(side: Side, ids: pa.ChunkedArray, ends: np.ndarray) -> pa.Array:
    """Decimal ids up to each end, joined by commas."""
    names = pc.take(side.decimal, ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids)
    cut = pa.array(np.append(0, np.flatnonzero(ends) + 1), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(cut, names), mark(","))


def align_batch(a: Side, b: Side, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
    """Per text: the counts, the groups' digest; and (doc, a, b, n), the links of each id pair in each text."""
    want = [b" " + t.encode() for t in texts]
    ids_a, ids_b = a.ids(texts), b.ids(texts)
    whole = a.given_back(ids_a, want) & b.given_back(ids_b, want)
    if not whole.all():
        keep = pa.array(whole)
        none = pa.array([[]], pa.list_(pa.int32()))[0]
        ids_a, ids_b = pc.if_else(keep, ids_a, none), pc.if_else(keep, ids_b, none)
    n = len(texts)
    counts = {"n_a": pc.list_value_length(ids_a).to_numpy().astype(np.int64), "n_b": pc.list_value_length(ids_b).to_numpy().astype(np.int64)}
    # the document of every key: keys run on over the batch
    stop = np.cumsum([len(w) * bool(k) for w, k in zip(want, whole)], dtype=np.int64)
    links = a.ends(ids_a, "a").join(b.ends(ids_b, "b"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    key = links["key"].to_numpy()
    doc = np.searchsorted(stop, key)  # the first text that ends at or after the key and holds bytes
    has_a, has_b = links["a"].is_valid().to_numpy(), links["b"].is_valid().to_numpy()
    both = has_a & has_b
    counts["n_groups"], counts["n_links"] = np.bincount(doc[both], minlength=n), np.bincount(doc, minlength=n)
    # groups: each side's ids up to a common end
    one = pc.binary_join_element_wise(_joined(a, links["a"].drop_null(), both[has_a]), _joined(b, links["b"].drop_null(), both[has_b]), mark("|"))
    cut = pa.array(np.append(0, np.cumsum(counts["n_groups"])), pa.int64())
    text = pc.binary_join(pa.LargeListArray.from_arrays(cut, one), mark(";"))
    shas = [hashlib.sha256(t.as_buffer()).hexdigest() if k else "" for t, k in zip(text, counts["n_groups"])]
    # between two ends stand the tokens that end next
    pairs = pa.table({"doc": pa.array(doc, pa.int64()), "a": pc.fill_null_backward(links["a"]), "b": pc.fill_null_backward(links["b"])})
    pairs = pairs.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
    return counts, shas, pairs


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the id
    pairs linked in it as three lists (pair_a, pair_b, pair_n)."""
    bounded_batches(docs.sparkSession)
    byte_path, piece_path = byte_path or tokenizer_path(BYTE_FILE), piece_path or tokenizer_path(PIECE_FILE)
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in DIGEST), T.StructField("groups_sha256", T.StringType()),
                           *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("pair_a", "pair_b", "pair_n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(byte_path, piece_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = [k for k, t in enumerate(texts) if t]
            counts, shas, pairs = align_batch(a, b, [texts[k] for k in at])
            digest = {c: np.zeros(len(texts), np.int64) for c in DIGEST}
            sha, width = [""] * len(texts), np.zeros(len(texts), np.int64)
            for c in DIGEST:
                digest[c][at] = counts[c]
            for k, s in zip(at, shas):
                sha[k] = s
            if at:
                width[at] = np.bincount(pairs["doc"].to_numpy(), minlength=len(at))
            cut = pa.array(np.append(0, np.cumsum(width)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pc.cast(pairs[c], pa.int32()).combine_chunks()) for c in ("a", "b", "count_all")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(digest[c]) for c in DIGEST), pa.array(sha, pa.string()), *lists], names=schema.names)

    return src.mapInArrow(run, schema)


def _flat(batch: pa.RecordBatch, names=("pair_a", "pair_b", "pair_n")) -> list[pa.Array]:
    return [pc.list_flatten(batch.column(batch.schema.get_field_index(c))) for c in names]


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count): links of every id pair, partial counts of each task merged by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            return t.rename_columns(["a", "b", "n"])

        for batch in batches:
            a, b, n = _flat(batch)
            held.append(pa.table({"a": a, "b": b, "n": pc.cast(n, pa.int64())}))
            if sum(t.num_rows for t in held) > PARTIAL_ROWS:
                t = summed()
                if t.num_rows > PARTIAL_ROWS // 2:
                    yield from t.to_batches()
                    t = t.slice(0, 0)
                held = [t]
        if held:
            yield from summed().to_batches()

    part = links.select("pair_a", "pair_b", "pair_n").mapInArrow(run, "a int, b int, n long")
    return part.groupBy("a", "b").agg(F.sum("n").alias("count"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder; id lists compress well."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _headed(links: DataFrame, head: pa.Table) -> DataFrame:
    """n_best and count_sum of each row over the head's pairs; the other pairs stay as lists (rest_a, rest_b, rest_n)."""
    head = head.append_column("key", pc.add(pc.shift_left(pc.cast(head["a"], pa.int64()), 32), pc.cast(head["b"], pa.int64()))).sort_by("key")
    sent = links.sparkSession.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("key", "count", "best")))
    kept = ["uid", "doc_id", *DIGEST, "groups_sha256"]
    src = links.select(*kept, "pair_a", "pair_b", "pair_n")
    rest = ("rest_a", "rest_b", "rest_n")
    schema = T.StructType([*(src.schema[c] for c in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = sent.value
        for batch in batches:
            a, b, n = _flat(batch)
            rows = batch.num_rows
            doc = pc.list_parent_indices(batch.column(len(kept))).to_numpy()
            key, n = (a.to_numpy().astype(np.int64) << 32) + b.to_numpy(), n.to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            sums = [np.zeros(rows, np.int64), np.zeros(rows, np.int64)]
            np.add.at(sums[0], doc[known], (n * best[at])[known] if len(keys) else n[known])
            np.add.at(sums[1], doc[known], (n * count[at])[known] if len(keys) else n[known])
            cut = pa.array(np.append(0, np.cumsum(np.bincount(doc[~known], minlength=rows))), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pc.cast(x, pa.int32()).filter(pa.array(~known))) for x in (a, b, pa.array(n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(pa.array, sums), *lists], names=schema.names)

    return src.mapInArrow(run, schema)


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    # uid: rows may share a doc_id; fixed once the links are written
    links = _written(aligned(docs, byte_path, piece_path).withColumn("uid", F.monotonically_increasing_id()), "links")
    counts = _written(pair_counts(links), "pair-counts")
    # at most one row per id of B
    best = counts.groupBy("b").agg(F.max("count").alias("top"))
    counts = counts.join(F.broadcast(best), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    head = counts.where(F.col("count") * head_pairs >= F.lit(total)).withColumn("best", F.col("best").cast("long")).toArrow()
    rows = _written(_headed(links, head), "links-head")
    rest = rows.select("uid", F.explode(F.arrays_zip("rest_a", "rest_b", "rest_n")).alias("p"))
    rest = rest.select("uid", F.col("p.rest_a").alias("a"), F.col("p.rest_b").alias("b"), F.col("p.rest_n").cast("long").alias("n"))
    # no pair of the rest is frequent: the join has no hot key
    sums = (rest.join(counts, ["a", "b"])
                .groupBy("uid")
                .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum")))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "uid", "left").select(
        "doc_id", *DIGEST, (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256")


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))
