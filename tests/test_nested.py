import json
import random

from setwise.operators import nested


def brute(rows):
    out = set()
    for key, text in rows:
        if not text:
            continue
        j = text.lstrip("﻿ \n")
        for _ in range(2):
            try:
                j = json.loads(j) if isinstance(j, str) else j
            except ValueError:
                break
        todo = [("", j)]
        while todo:
            p, n = todo.pop()
            if not isinstance(n, dict):
                continue
            f = n.get("fields")
            pairs = f.items() if isinstance(f, dict) else [(x["name"], x.get("tree")) for x in f if x.get("name") is not None] if isinstance(f, list) else []
            for k, v in pairs:
                out.add((key, "field", f"{p}.{k}", p))
                todo.append((f"{p}.{k}", v))
            for i, v in enumerate(n.get("indices") or []):
                if v is not None:
                    out.add((key, "index", f"{p}[{i}]", p))
                    todo.append((f"{p}[{i}]", v))
    return out


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return {"types": {"CLong": 1}}
    n = {}
    names = ["a", "x[1]", 'q"q', "", "é", "0", "a.b"]
    if rng.random() < 0.8:
        kids = {rng.choice(names): tree(rng, depth - 1) if rng.random() < 0.9 else None for _ in range(3)}
        n["fields"] = kids if rng.random() < 0.7 else [{"name": k, "tree": v} for k, v in kids.items()]
    if rng.random() < 0.5:
        n["indices"] = [tree(rng, depth - 1) if rng.random() < 0.7 else None for _ in range(3)]
    return n


def test_trees_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        t = json.dumps(tree(rng, 7), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        t = json.dumps(t) if i % 7 == 0 else "﻿ " + t if i % 5 == 0 else t
        rows.append((i, t))
    deep = {"types": {}}
    for k in range(150):
        deep = {"fields": {f"n{k}": deep}}
    rows += [(100, None), (101, ""), (102, "{broken"), (103, "[]"), (104, '{"fields": 5, "indices": {"a": 1}}'), (105, json.dumps(deep)), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "tree_id bigint, ctree string").selectExpr("*", "'x' as kind", "'y' as node_path", "1 as _key")
    got = {tuple(r) for r in nested.tree_nodes(df, "tree_id", "ctree").collect()}
    assert got == brute([r for r in rows if r[0] < 102 or r[0] == 105])


def test_empty_trees(spark):
    df = spark.createDataFrame([], "tree_id bigint, ctree string")
    assert nested.tree_nodes(df, "tree_id", "ctree").count() == 0


def test_shred_keeps_positions(spark):
    df = spark.sql(
        "select * from values (1, array(named_struct('a', 'x', 'c', array(named_struct('n', 1), null, named_struct('n', 3))), null, named_struct('a', 'y', 'c', null))), (2, null), (3, array()) as t(k, s)"
    )
    assert [tuple(r) for r in nested.shred(df, ["k"], "s").orderBy("s_pos").collect()] == [(1, 0, "x"), (1, 2, "y")]
    assert [tuple(r) for r in nested.shred(df, ["k"], "s", ["c"]).orderBy("c_pos").collect()] == [(1, 0, 0, 1), (1, 0, 2, 3)]


def test_columns(spark):
    df = spark.sql("select 1 as tree_id, array(named_struct('selector', '.a', 'ctype', 'CLong'), null, named_struct('selector', null, 'ctype', 'CNum'), named_struct('selector', '', 'ctype', null)) as c")
    assert sorted(tuple(r) for r in nested.tree_columns(df, "tree_id", "c").collect()) == [(1, "column", ".a:CLong", ".a"), (1, "column", ":", "")]
