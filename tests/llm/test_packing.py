from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setwise.llm import packing


def check_plan(hist, capacity):
    plan = packing.solve_configurations(hist, capacity)
    got = Counter()
    for config, times in zip(plan.configs, plan.times):
        assert times > 0 and sum(k * n for k, n in config.items()) <= capacity
        for k, n in config.items():
            got[k] += n * times
    assert got == Counter({k: v for k, v in hist.items() if v})
    assert plan.containers >= plan.lower_bound
    return plan


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=12))
def test_every_item_once_and_none_too_full(hist):
    check_plan(hist, 60)


def test_close_to_the_bound():
    hist = {k: 1000 // k + 5 for k in range(3, 200)}
    plan = check_plan(hist, 256)
    assert plan.containers <= 1.01 * plan.lower_bound + 1


def test_large_items_need_one_container_each():
    assert check_plan({60: 7, 55: 3}, 100).containers == 10


def test_one_length_only():
    assert check_plan({30: 100}, 100).containers == 34
    assert packing.solve_configurations({}, 10).containers == 0


def packed(spark, rows, capacity):
    df, plan = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), capacity)
    return [r.asDict() for r in df.collect()], plan


def test_round_trip(spark):
    rows = [(i, (i * 37) % 150) for i in range(400)] + [(1000 + i, 70) for i in range(300)]
    got, plan = packed(spark, rows, 100)
    fill = Counter()
    parts = {}
    for r in got:
        fill[r["container_id"]] += r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part_no"], r["start"], r["n_tokens"]))
    assert max(fill.values()) <= 100 and len([c for c in fill if fill[c]]) == plan.containers
    assert set(parts) == {k for k, _ in rows}
    for k, n in rows:
        own = sorted(parts[k])
        assert sum(p[2] for p in own) == n
        assert len(own) == 1 if n <= 100 else len(own) == 2
        assert [p[1] for p in own] == [100 * i for i in range(len(own))]


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (None, "lost"), (3, "some words here"), (3, "some words here"), (4, "x " * 3000)], "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "2 as start")
    wins = spark.createDataFrame([("w", 64), ("none", None), (None, 5), ("w", 64)], "window_name string, capacity_tokens int")
    rows = packing.pack_windows(docs, wins)[0].collect()
    assert {r.doc_id for r in rows} == {1, 3, 4}
    assert [r.n_tokens for r in rows if r.doc_id == 1] == [0]
    assert sum(r.doc_id == 3 for r in rows) == 2
    fill = Counter()
    for r in rows:
        fill[r.container_id] += r.n_tokens
    assert max(fill.values()) <= 64


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    wins = spark.createDataFrame([("w", 64)], "window_name string, capacity_tokens int")
    assert packing.pack_windows(docs, wins)[0].count() == 0
    assert packing.pack_windows(docs, wins.limit(0))[0].count() == 0


def test_token_counts_are_of_whole_texts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    long = "Word " * 50_000 + "end"
    docs = spark.createDataFrame([(1, long), (2, "ein kurzer Text, ¿no? 123")], "doc_id bigint, text string")
    got = dict(packing.count_tokens(docs, "doc_id", "text").collect())
    with open(packing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got[2] == len(enc.encode_ordinary("ein kurzer Text, ¿no? 123"))
    assert got[1] == len(enc.encode_ordinary(long))
