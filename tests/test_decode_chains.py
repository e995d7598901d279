"""A2 decoding ladder (raw_pages) and C6 chains (chains fixture) against a
brute-force walk."""

import random


from quire.operators.chains import follow_chain
from quire.sources.pages import decode_pages


def test_decode_ladder(spark):
    zh = "第一章 天下"
    rows = [
        (1, "a", b'<meta charset="gbk">' + zh.encode("gbk")),        # declared GBK
        (2, "b", zh.encode("gbk")),                                  # undeclared GBK
        (3, "c", ("<p>" + zh + "</p>").encode("utf-8")),             # plain UTF-8
        (4, "d", b'<meta charset="utf-8">' + zh.encode("gbk")),      # declared UTF-8, GBK bytes
        (5, "e", b"\xff\xfe\xfa"),                                   # broken bytes
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, content binary")
    got = {r["page_id"]: (r["charset"], r["html"]) for r in decode_pages(df).collect()}
    assert got[1] == ("gbk", '<meta charset="gbk">' + zh)
    assert got[2] == ("gbk", zh)
    assert got[3] == ("utf-8", "<p>" + zh + "</p>")
    assert got[4] == ("gbk", '<meta charset="utf-8">' + zh)
    assert got[5][0] == "utf-8-replace" and "�" in got[5][1]


def _walk(edges, start):
    nxt = {}
    for a, b in edges:
        if b is not None and a not in nxt:
            nxt[a] = b
    out, seen, cur = [], set(), start
    while cur is not None and cur not in seen:
        out.append(cur)
        seen.add(cur)
        cur = nxt.get(cur)
    return out


def _run(spark, edges, starts=None):
    df = spark.createDataFrame(edges, "from_url string, to_url string")
    st = None if starts is None else spark.createDataFrame([(s,) for s in starts], "node string")
    got = {}
    for r in follow_chain(df, st).collect():
        got.setdefault(r["head"], []).append((r["page_no"], r["node"]))
    return {h: [n for _, n in sorted(v)] for h, v in got.items()}


def test_chain_fixture(spark):
    long_chain = [(f"L{i}", f"L{i + 1}") for i in range(149)] + [("L149", None)]
    edges = ([("S0", None)]
             + [(f"F{i}", f"F{i + 1}") for i in range(4)] + [("F4", None)]
             + long_chain)
    got = _run(spark, edges)
    assert got["S0"] == ["S0"]
    assert got["F0"] == [f"F{i}" for i in range(5)]
    assert got["L0"] == _walk(long_chain, "L0") and len(got["L0"]) == 150


def test_chain_cycle_needs_a_start_and_stops(spark):
    edges = [("A", "B"), ("B", "A")]
    assert _run(spark, edges) == {}                   # no page without an incoming link
    assert _run(spark, edges, ["A"]) == {"A": ["A", "B"]}


def test_chain_random_lists(spark):
    rnd = random.Random(7)
    nodes = [f"n{i}" for i in range(300)]
    rnd.shuffle(nodes)
    edges, pos = [], 0
    while pos < len(nodes):
        k = rnd.randint(1, 40)
        part = nodes[pos:pos + k]
        edges += list(zip(part, part[1:] + [None]))
        pos += k
    got = _run(spark, edges)
    heads = {a for a, _ in edges} - {b for _, b in edges if b}
    assert set(got) == heads
    for h in heads:
        assert got[h] == _walk(edges, h)


def test_read_page_files(spark, tmp_path):
    from quire.sources.pages import read_page_files
    zh = "第一章 天下"
    (tmp_path / "page_0.txt").write_bytes(("<p>" + zh + "</p>").encode("utf-8"))
    (tmp_path / "page_1.txt").write_bytes(b'<meta charset="gbk">' + zh.encode("gbk"))
    (tmp_path / "notes.md").write_bytes(b"ignored")
    got = {r["idx"]: (r["charset"], r["html"]) for r in read_page_files(spark, str(tmp_path)).collect()}
    assert got == {0: ("utf-8", "<p>" + zh + "</p>"), 1: ("gbk", '<meta charset="gbk">' + zh)}
