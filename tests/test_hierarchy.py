import random

import pytest

from setwise.operators import hierarchy as hi


def brute(links):
    parent = {}
    for n, p in links:
        if n is None:
            continue
        if n not in parent:
            parent[n] = None
        if p is not None and (parent[n] is None or p < parent[n]):
            parent[n] = p
    parent = {n: p if p in parent and p != n else None for n, p in parent.items()}
    out = {}
    for n in parent:
        path = [n]
        while parent[path[-1]] is not None and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        end = parent[path[-1]]
        out[n] = ("ok", path[-1], len(path) - 1, path[::-1]) if end is None else ("circle", "", -1, None) if end == n else ("below", "", -2, None)
    return out


def random_links(seed, n):
    rng = random.Random(seed)
    links = [(f"n{i}", rng.choice([None, f"n{max(0, i - rng.choice([1, 1, 1, 5, 40]))}", f"n{rng.randrange(n)}", "gone"] + [f"n{i - 1}"] * 6)) for i in range(n)]
    links += [("hub%d" % i, "n3") for i in range(n // 3)]  # one parent holds a quarter of all
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("d1", "d2"), ("d2", "d1"), ("e1", "c1"), ("e2", "e1"), ("self", "self"), ("n5", None), (None, "n1"), ("n7", "zz")]
    return links + links[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    links = random_links(seed, 150)
    want = brute(links)
    h = hi.build_hierarchy(spark.createDataFrame(links, "node string, parent string").selectExpr("*", "1 as chain", "2 as size", "'x' as root"))
    got = {r.node: r for r in h.nodes.collect()}
    assert {n: (r.status, r.root, r.depth) for n, r in got.items()} == {n: w[:3] for n, w in want.items()}
    paths = {r.node: r.path.split("/") for r in h.path_text().collect()}
    assert paths == {n: w[3] for n, w in want.items() if w[0] == "ok"}
    below = {n: set() for n, w in want.items() if w[0] == "ok"}
    for n, p in paths.items():
        for a in p[:-1]:
            below[a].add(n)
    found = {n: set() for n in below}
    for r in h.descendants(h.nodes.select("node")).collect():
        assert r.descendant not in found[r.node]
        found[r.node].add(r.descendant)
    assert found == below
    assert all(got[n].size == len(b) + 1 for n, b in below.items())
    assert max(len(r.segments) for r in h.segments().collect()) <= 9


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    made = []
    stage = hi.stage
    monkeypatch.setattr(hi, "stage", lambda df, tag: made.append(tag) or stage(df, tag))
    links = [(f"{i:05d}", f"{i - 1:05d}" if i else None) for i in range(1500)]
    h = hi.build_hierarchy(spark.createDataFrame(links, "node string, parent string"))
    assert h.nodes.agg({"depth": "max"}).collect()[0][0] == 1499
    assert len(made) < 40


def test_empty_and_single(spark):
    h = hi.build_hierarchy(spark.createDataFrame([], "node string, parent string"))
    assert h.nodes.count() == 0 and h.path_text().count() == 0
    h = hi.build_hierarchy(spark.createDataFrame([("a", None)], "node string, parent string"))
    assert [(r.root, r.depth, r.size) for r in h.nodes.collect()] == [("a", 0, 1)]
    h = hi.build_hierarchy(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))
    assert {r.depth for r in h.nodes.collect()} == {-1}


def test_key_and_account_rows(spark):
    keys = spark.createDataFrame([("K1", None), ("k2", " k1\t"), ("k2", " k1\t"), ("k3", "(undefined)"), ("k4", ""), ("k5", "nobody")], "api_key string, issuer_key string")
    accs = spark.createDataFrame([("0000000007", None), ("0000000008", "7"), ("0000000009", " 0000000008 "), ("0000000010", "x"), ("0000000011", "k1")], "account_id string, parent_id string")
    got = {(r.entity, r.node_id): (r.root_id, r.depth) for r in hi.hierarchy_rows(keys, accs).collect()}
    assert got == {
        ("api_key", "K1"): ("K1", 0), ("api_key", "k2"): ("K1", 1), ("api_key", "k3"): ("k3", 0), ("api_key", "k4"): ("k4", 0), ("api_key", "k5"): ("k5", 0),
        ("account", "0000000007"): ("0000000007", 0), ("account", "0000000008"): ("0000000007", 1), ("account", "0000000009"): ("0000000007", 2), ("account", "0000000010"): ("0000000010", 0), ("account", "0000000011"): ("0000000011", 0),
    }
