"""Operator 13 against brute force; the whole query against its SQL."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

from quire.llm import phrases

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, phrase string, k int, n string"
TEXTS = [
    ("a b c a b c. a b c a b; A B C!", "en"), ("a b c d e f " * 40, "en"), ("x y\tx  y, x y\nx y\rz x\x0by", "en"), (None, "en"), ("", None), ("x y " * 30, None), ("x y " * 3, "und"),
    ("é É ß, 日本 日本 日本", "de"), ("a b c a b c. a b c a b; A B C!", "en"), ("   \t ,;. ", "fr"), ("a\xa0b a\xa0b a\xa0b", "fr"), ("one", "it"), ("tie tie " * 20_000, "ti"),
]


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, min_count, percent=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {x: c for x, c in f.items() if c >= min_count}
    best = Counter()  # for a phrase: the greatest count of a longer one that holds it
    for (lang, p), c in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                best[lang, p[i : i + k]] = max(best[lang, p[i : i + k]], c)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or 100 * best[lang, p] >= percent * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j, f[lang, p[:j]], f[lang, p[j:]]) for j in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r, n[lang]))
    rank, rows = Counter(), []
    for lang, score, a, p, l, r, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, l, r, n, -score))
    return rows


@pytest.mark.parametrize("bits", [phrases.FILTER_BITS, 64])
def test_phrases_are_brute_force(spark, bits):
    """A filter that says yes to everything changes the work, not the result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.text, r.lang) for r in docs.collect()], 8, 90, 300)
    got = [tuple(r) for r in phrases.collocations(docs, 8, 90, 300, 4 if bits == 64 else 3, bits).collect()]
    assert sorted(got) == sorted(want) and len(want) > 200


def test_phrase_edges(spark):
    df = spark.createDataFrame([(k, t, lang, "x", 1, "y") for k, (t, lang) in enumerate(TEXTS)], DOCS)
    for least, shards in ((2, 3), (3, 1), (40, 2)):
        assert sorted(tuple(r) for r in phrases.collocations(df, least, shards=shards).collect()) == sorted(brute(TEXTS, least))
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(df.where("text is null or text = ''"), 1).count() == 0


def test_query_is_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = phrases.op13_phrase_mining(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({phrases.OP13_SQL})").fetchall())


def test_products_past_64_bits(spark):
    """Counts whose products pass 64 bits: the quotient stays exact."""
    a, n, l, r = 10**12 + 7, 9 * 10**13 + 1, 10**12 + 9, 10**12 + 11
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    row = df.selectExpr("(cast(a as decimal(15,0)) * cast(n as decimal(15,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as s").first()
    assert row.s == 1000 * a * n // (l * r)
