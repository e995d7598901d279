"""Operator 12 against brute force with the named libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from quire.llm import alignment

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_a long, uid string, a int"
EDGE = [
    (1, None, 1, "x", 1), (2, "", 1, "x", 1), (3, "word " * 30_000, 1, "x", 1), (None, "one two", 1, "x", 1), (4, "tie tie", 1, "x", 1), (4, "tie tie", 1, "x", 1),
    (5, " \n\t ", 1, "x", 1), (6, "<|endoftext|> <s> </s> <unk> <0x41> a\x00b ▁ lower▁bar", 1, "x", 1), (7, "a" * 5_000, 1, "x", 1),
    (8, "日本語 👩‍👩 é ﬁ Ａ  　x  y\r\n  z", 1, "x", 1), (9, "﻿​­", 1, "x", 1), (10, " ", 1, "x", 1),
]


@pytest.fixture(scope="module")
def tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.tokenizer_path(alignment.BYTE_FILE))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=alignment.tokenizer_path(alignment.PIECE_FILE))
    back = {c: k for k, c in enumerate(alignment.byte_chars())}

    def piece(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    def both(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [[bytes(back[c] for c in a.id_to_token(k)) for k in ids[0]], [piece(k) for k in ids[1]]]
        whole = (" " + text).encode()
        return [list(zip(i, r)) for i, r in zip(ids, raw)] if text and all(b"".join(r) == whole for r in raw) else [[], []]

    return both


def spans(side):
    at, out = 0, []
    for k, raw in side:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, tokens):
    docs, count = [], Counter()
    for d, text in rows:
        a, b = (spans(s) for s in tokens(text or ""))
        # a sweep over both lists: overlap of byte ranges, by its definition
        links, j = [], 0
        for ka, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            i = j
            while i < len(b) and b[i][1] < e:
                links.append((ka, b[i][0]))
                i += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(k) for k, s, e in side if lo <= s and e <= hi) for side in (a, b)) if len(a) < 2000 else None)
            lo = hi
        docs.append((d, len(a), len(b), cuts, links, groups))
        count.update(links)
    best = Counter()
    for (_, kb), n in count.items():
        best[kb] = max(best[kb], n)
    out = []
    for d, na, nb, cuts, links, groups in docs:
        sha = "" if not na else hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        out.append((d, na, nb, len(cuts), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


def agree(df, tokens, **options):
    got = sorted((tuple(r) for r in alignment.align(df, **options).collect()), key=str)
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()], tokens), key=str)
    # the brute force leaves the digest of very long texts out
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want) if w[7] is not None)


def test_alignment_is_brute_force(spark, tokens):
    agree(spark.read.parquet(f"{SF}/documents.parquet"), tokens)


def test_alignment_edges(spark, tokens):
    df = spark.createDataFrame(EDGE, DOCS)
    agree(df, tokens)
    # no head, a small head: the rest meets the counts in the join
    agree(df, tokens, head_pairs=1)
    agree(df, tokens, head_pairs=40)
    got = {r.doc_id: r for r in alignment.align(df).collect()}
    for k in (1, 2):
        assert tuple(got[k])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0


def test_encoders_are_the_libraries(tokens):
    """Random strings of mixed scripts, spaces and marks: ids as the named library gives them."""
    pick = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'RE", "7", "½", "é", "é", "ß", "日", "　", " ", "👩", "‍", "!", "▁", "<|endoftext|>", "\x00", "\x1c", "\x85", "ſ", "İ", "ـ", "ก็"]
    texts = ["".join(pick.choices(parts, k=pick.randint(1, 30))) for _ in range(3000)]
    own = alignment.ByteTokenizer(alignment.tokenizer_path(alignment.BYTE_FILE))
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(alignment.tokenizer_path(alignment.BYTE_FILE))
    lib.encode_special_tokens = True
    assert own(texts) == [e.ids for e in lib.encode_batch([" " + t for t in texts], add_special_tokens=False)]
