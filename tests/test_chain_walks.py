"""C6 where walks share pages and cycles."""

from __future__ import annotations

import random

from quire.operators.chains import follow_chain, unreached
from tests.test_decode_chains import _run, _walk


def test_shared_tail(spark):
    edges = [("a", "c"), ("b", "c"), ("c", "d"), ("d", None)]
    assert _run(spark, edges) == {"a": ["a", "c", "d"], "b": ["b", "c", "d"]}
    assert _run(spark, edges, ["a", "c", "x"]) == {"a": ["a", "c", "d"], "c": ["c", "d"]}


def test_walk_into_a_cycle(spark):
    edges = [("z", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("k", "l"), ("l", "k"), ("s", "s")]
    assert _run(spark, edges) == {"z": ["z", "c", "d", "e"]}
    df = spark.createDataFrame(edges, "from_url string, to_url string")
    assert {r.node for r in unreached(df, follow_chain(df)).collect()} == {"k", "l", "s"}


def test_random_links(spark):
    rnd = random.Random(3)
    edges = [(f"n{i}", rnd.choice([None, *[f"n{rnd.randrange(120)}"] * 12])) for i in range(120)]
    heads = {a for a, _ in edges} - {b for _, b in edges if b}
    assert _run(spark, edges) == {h: _walk(edges, h) for h in heads}
