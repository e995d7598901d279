"""The encoder's tables and its rows in work stay small, whatever the texts."""

import random
import sys

import pyarrow as pa
from tokenizers import Tokenizer

from quire.llm import bpe


def test_tables_stay_small_and_ids_are_the_librarys(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    b = bpe.ForcedBoundaryBPE(bpe.tokenizer_path())
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    rnd = random.Random(3)
    often = ["the", "naïve", "weather", "ñoño", "l'été"]
    for k in range(60):
        new = ["".join(rnd.choices("abcdefghiéñ字😀'9-", k=rnd.randint(1, 90))) for _ in range(20)]
        text = " ".join(rnd.sample(often + new, 25)) + (" <|endoftext|> x" if k % 7 == 0 else "")
        ids, decoded = b.encode(text)
        assert list(ids) == (want := lib.encode(text, add_special_tokens=False).ids)
        assert decoded == b.decode(ids) == lib.decode(want, skip_special_tokens=False)
    for table in (b.plain, b.mapped, b.fragments):
        assert len(table) <= 50 and len(table.older) <= 50
        # long keys are not kept
        assert max(map(len, [*table, *table.older]), default=0) <= bpe.CACHE_KEY
    assert b.encode(None) == b.encode("") == (b.encode(" ")[0], "") and not len(b.encode(None)[0])


def test_words_met_again_are_kept(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    made = []
    table = bpe.Table(lambda k: made.append(k) or k.upper())
    for k in range(200):
        assert table["often"] == "OFTEN" and table[f"w{k}"] == f"W{k}"
    assert made.count("often") == 1 and len(made) == 201


def test_an_entry_takes_little_room():
    """A few hundred thousand entries must fit beside an executor's heap."""
    b = bpe.ForcedBoundaryBPE(bpe.tokenizer_path())
    words = [f"{x}{y}inging" for x in ("th", "qu", "br", "sl") for y in ("aum", "orr", "eeth", "ib")]
    for w in words:
        b.encode(w)
    assert len(b.plain) == len(words)
    assert sum(sys.getsizeof(v) + sum(sys.getsizeof(x) for x in v if not isinstance(v, str)) for v in b.plain.values()) < 100 * len(words)


def test_rows_are_encoded_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    texts = ["abcdef", None, "abcdef", "", "x" * 50, "é", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["_id", "_text"])
    runs = [x.column(0).to_pylist() for x in bpe.slices(batch)]
    assert runs == [[0, 1, 2], [3, 4], [5, 6]]
    assert list(bpe.slices(batch.slice(0, 0))) == []
