import random

import pytest

from setwise.llm import leakage
from setwise.llm.words import words

random.seed(11)
VOCAB = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "tu", "me", "la") for b in ("n", "r", "st", "l") for c in ("ado", "ip", "ex", "ung", "ola")]


def sentence(n, rng):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


PASSAGES = {i: sentence(48, random.Random(1000 + i)) for i in range(1, 9)}


def garble(text, rng, every=9):
    ws = text.split()
    for i in range(4, len(ws), every):
        k = rng.randrange(1, len(ws[i]) - 1)
        ws[i] = rng.choice([ws[i][:k] + ws[i][k + 1 :], ws[i][:k] + ws[i][k] + ws[i][k:], ws[i][: k - 1] + ws[i][k] + ws[i][k - 1] + ws[i][k + 1 :]])
    return " ".join(ws)


def corpus():
    rng = random.Random(3)
    docs, true = [], set()
    for d in range(200):
        body = [sentence(30, rng), sentence(30, rng)]
        if d % 4 == 0:
            i = 1 + d // 4 % 8
            ws = PASSAGES[i].split()
            how = d // 4 % 6
            if how == 0:
                mid = PASSAGES[i]
            elif how == 1:
                mid = garble(PASSAGES[i], rng)
            elif how == 2:
                mid = "> " + " ".join(ws[:18]).upper() + "\n> " + " ".join(ws[18:30])
            elif how == 3:
                mid = " ".join(ws[:20]) + " <b>" + ws[20] + "</b> " + sentence(12, rng) + " " + " ".join(ws[21:44])
            elif how == 4:
                mid = " ".join(ws[10:19])  # too short to count
            else:
                mid = " ".join(w if k % 4 else rng.choice(VOCAB) for k, w in enumerate(ws))  # same build, other words
            if how < 4:
                true.add((d, i))
            body.insert(1, mid)
        docs.append((d, "\n".join(body)))
    return docs, true


def brute(docs, items):
    return {(d, i) for d, t in docs for i, p in items.items() if t and p and len(words(p)) >= 3 and leakage.is_leak(words(t), words(p))}


def test_finds_all_planted_and_equals_brute_force(spark):
    docs, true = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(list(PASSAGES.items()), "item_id bigint, passage string")
    got = {tuple(r) for r in leakage.leaked_items(df, items).collect()}
    assert got == true == brute(docs, PASSAGES)


def test_repeated_items_and_a_stored_index(spark):
    docs, true = corpus()
    index = leakage.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    items = spark.createDataFrame(list(PASSAGES.items()) * 2, "item_id bigint, passage string")
    assert {tuple(r) for r in leakage.search(index, items).collect()} == true
    assert {tuple(r) for r in leakage.search(index, items.where("item_id < 3")).collect()} == {x for x in true if x[1] < 3}


def test_short_passages(spark):
    passages = {n: " ".join(VOCAB[10 * n : 10 * n + n]) for n in (3, 4, 5, 8)}
    docs = [(n, f"{sentence(9, random.Random(n))} {p} {sentence(9, random.Random(50 + n))}") for n, p in passages.items()] + [(20, sentence(40, random.Random(9)))]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(passages.items()), "item_id bigint, passage string"))
    assert {tuple(r) for r in got.collect()} >= {(n, n) for n in passages}


def test_garbled_short_stretches_against_brute_force(spark):
    """Stretches of 15 to 20 words of real passages, every sixth word garbled: what brute force accepts is found."""
    passages = {r.item_id: r.passage for r in spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").collect()}
    posts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 200 and 600").orderBy("doc_id").limit(240).collect()]
    rng = random.Random(8)
    docs = []
    for n, (i, p) in enumerate(sorted(passages.items())):
        need = max(15, -(-len(words(p)) // 3))
        long = rng.randrange(need, need + 6)
        at = rng.randrange(max(1, len(p.split()) - long))
        part = " ".join(p.split()[at : at + long])
        docs.append((n, posts[n % len(posts)] + "\n" + (garble(part, rng, 6) if all(len(w) > 2 for w in part.split()[4::6]) else part)))
    want = brute(docs, passages)
    got = {tuple(r) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(passages.items()), "item_id bigint, passage string")).collect()}
    assert got <= want and len(want) > 100 and len(got) >= 0.97 * len(want), (len(got), len(want))


def test_one_item_in_most_documents(spark):
    docs = [(i, f"start {i} {PASSAGES[1]} end") for i in range(90)] + [(100 + i, sentence(60, random.Random(i))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(list(PASSAGES.items()), "item_id bigint, passage string")
    assert {r.doc_id for r in leakage.leaked_items(df, items).collect()} == set(range(90))


def test_nulls_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, PASSAGES[1]), (3, PASSAGES[2]), (3, PASSAGES[2]), (4, "x " * 200_000 + PASSAGES[3])], "doc_id bigint, text string").selectExpr("*", "7 as item_id", "'a' as passage", "1 as term", "1 as pos")
    items = spark.createDataFrame([(1, PASSAGES[1]), (2, PASSAGES[2]), (2, PASSAGES[2]), (3, PASSAGES[3]), (4, None), (None, PASSAGES[2]), (5, ""), (6, "two words")], "item_id bigint, passage string").selectExpr("*", "1 as doc_id", "'x' as text")
    assert sorted(map(tuple, leakage.leaked_items(docs, items).collect())) == [(3, 2), (4, 3)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, PASSAGES[1])], "item_id bigint, passage string")
    assert leakage.leaked_items(docs, items).count() == 0
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,near", [("leaky", "leeaky", True), ("salpel", "salepl", True), ("staircase", "staicase", True), ("12", "13", False), ("kellerpumpe", "kellerlampe", False), ("cat", "bat", False)])
def test_garbled_words(a, b, near):
    assert leakage._near(a, b) is near
