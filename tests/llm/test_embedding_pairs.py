"""Operator 8: planted pairs against brute force, cells dealt into blocks, repeated ids, clashing columns."""

from __future__ import annotations

from collections import Counter

import numpy as np

from quire.llm import multi_index

from .test_operators import roots

SCHEMA = "vec_id long, embedding array<double>, cell long, key string, block int, vid long"


def planted(n=1500, partners=400, dim=32):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, dim))
    # a dense bulk that shares cells
    x[: n // 3] = x[0] + 0.45 * x[: n // 3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    of = rng.choice(n, partners, replace=False)
    noise = rng.standard_normal((partners, dim))
    noise -= (noise * x[of]).sum(1)[:, None] * x[of]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.9505, 0.9995, partners)[:, None]
    return np.vstack([x, c * x[of] + (1 - c * c) ** 0.5 * noise])


def judged(spark, rows):
    df = spark.createDataFrame([(k, v, 1, "x", 2, 3) for k, v in rows], SCHEMA).repartition(3)
    return multi_index.near_duplicates(df).collect()


def check(spark, x):
    a, b = np.where(np.triu(x @ x.T >= 0.95, 1))
    pairs = list(zip(a.tolist(), b.tolist()))
    assert len(pairs) >= 400
    n, root = Counter(v for p in pairs for v in p), roots(range(len(x)), pairs)
    got = {r.vec_id: r for r in judged(spark, [(k, v.tolist()) for k, v in enumerate(x)])}
    assert set(got) == set(range(len(x)))
    # no false link, and at least 0.9 of the true ones
    assert all(got[k].n_links <= n[k] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values())
    assert sum(got[k].component_id == root[k] for k in got) >= 0.9 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    return got


def test_planted_pairs(spark):
    check(spark, planted())


def test_cells_in_blocks_are_the_same(spark, monkeypatch):
    x = planted()
    whole = {k: (r.n_links, r.component_id) for k, r in check(spark, x).items()}
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 40)
    assert {k: (r.n_links, r.component_id) for k, r in check(spark, x).items()} == whole


def test_repeated_ids_are_one_component(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.01, 1.0]
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, None), (5, a)]
    got = sorted((r.vec_id, r.component_id, r.n_links) for r in judged(spark, rows))
    assert [g[:2] for g in got] == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 1), (5, 5)]
    assert [g[2] for g in got if g[0] in (1, 3, 4)] == [2, 1, 1, 1]
