import datetime as dt

import pytest

from setwise.operators import dedup, references

T = dt.datetime(2020, 1, 1)
H = dt.timedelta(hours=1)
SCHEMA = "delivery_id bigint, agent_id int, msg_offset bigint, event string, delivered_at timestamp"


def write(spark, tmp_path, rows, name, files=3):
    path = f"file://{tmp_path}/{name}"
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "delivery_id * 2 as _block", "'w' as w").drop("_block").repartition(files).write.parquet(path)
    return path


def test_one_delivery_of_each_message(spark, tmp_path):
    rows = [
        (1, 1, 5, "{}", T + H), (2, 1, 5, "{}", T), (3, 1, None, '{"offset": 5}', T), (4, 2, 5, "{}", T), (5, None, 5, "{}", T), (6, None, 5, "{}", T),
        (7, 1, None, "broken", T), (8, 1, None, None, T), (9, 3, 1, "{}", None), (10, 3, 1, "{}", T), (11, 4, 1, "{}", None), (12, 4, 1, "{}", None),
    ]
    path = write(spark, tmp_path, rows, "a")
    assert sorted(r[0] for r in dedup.surplus_deliveries(spark, path).collect()) == [1, 3, 9, 12]
    kept = dedup.deduplicated_messages(spark, path)
    assert sorted(r.delivery_id for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 10, 11]
    assert kept.columns == ["delivery_id", "agent_id", "msg_offset", "event", "delivered_at", "w"]


def test_hot_message_and_file_groups(spark, tmp_path, monkeypatch):
    rows = [(i, 1 if i % 3 == 0 else i, 1, "x" * 50, T + i * H) for i in range(1, 400)]
    path = write(spark, tmp_path, rows, "b", files=9)
    want = sorted({3, *[i for i in range(1, 400) if i % 3]} - {3} | {1})
    assert sorted(r.delivery_id for r in dedup.deduplicated_messages(spark, path).collect()) == want
    monkeypatch.setattr(dedup, "BROADCAST_BITMAPS", 4)
    assert sorted(r.delivery_id for r in dedup.deduplicated_messages(spark, path).collect()) == want
    assert sorted(r[0] for r in dedup.surplus_deliveries(spark, path).collect()) == sorted(set(range(1, 400)) - set(want))
    events, bitmaps = dedup.message_winners(spark, path)
    assert dedup.write_deduplicated(events, bitmaps, f"file://{tmp_path}/out") > 1
    assert sorted(r.delivery_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == want


def test_blocks_of_a_file(spark, tmp_path, monkeypatch):
    n = 70_000  # three bitmaps in one file
    path = f"file://{tmp_path}/c"
    spark.range(n).selectExpr("id as delivery_id", "1 as agent_id", "id div 2 as msg_offset", "'{}' as event", f"timestamp'2020-01-01' as delivered_at").coalesce(1).write.parquet(path)
    got = dedup.surplus_deliveries(spark, path)
    assert got.count() == n // 2 and got.where("delivery_id % 2 = 0").count() == 0


def test_no_deliveries(spark, tmp_path):
    path = write(spark, tmp_path, [], "d", files=1)
    assert dedup.surplus_deliveries(spark, path).count() == 0


# --- references ------------------------------------------------------------------------------


def orphans(spark, refs, targets, match):
    r = spark.createDataFrame(refs, "id int, a string, b string").selectExpr("*", "1 as _there", "2 as created_at")
    t = spark.createDataFrame(targets, "a string, b string").selectExpr("*", "7 as id", "'x' as kind")
    return sorted((x.id, x.kind) for x in references.find_orphans(r, t, ["a", "b"], match).collect())


REFS = [(1, "x", "y"), (2, "x", "z"), (3, "x", None), (4, "q", None), (5, None, "y"), (6, None, None), (7, "x", "y")]
TARGETS = [("x", "y"), ("x", "y"), ("w", None), (None, None)]


def test_match_semantics(spark):
    assert orphans(spark, REFS, TARGETS, "simple") == [(2, "missing")]
    assert orphans(spark, REFS, TARGETS, "partial") == [(2, "missing"), (4, "missing")]
    assert orphans(spark, REFS, TARGETS, "full") == [(2, "missing"), (3, "mixed"), (4, "mixed"), (5, "mixed")]
    assert orphans(spark, REFS, [], "simple") == [(1, "missing"), (2, "missing"), (7, "missing")]
    assert orphans(spark, [], TARGETS, "partial") == []
    with pytest.raises(ValueError):
        orphans(spark, REFS, TARGETS, "loose")


def test_life_times(spark):
    refs = spark.createDataFrame([(1, "k", T), (2, "k", T + 2 * H), (3, "k", T + 5 * H), (4, "k", None), (5, "m", None), (6, "n", T)], "id int, k string, at timestamp")
    targets = spark.createDataFrame([("k", T + H, None), ("k", T + 3 * H, T + 5 * H), ("n", None, None)], "k string, created_at timestamp, removed_at timestamp")
    got = {r.id: r.kind for r in references.find_orphans(refs, targets, ["k"], "simple", "at").collect()}
    assert got == {1: "late", 3: "deleted", 5: "missing", 6: "late"}


def test_declared_tables(spark):
    keys = spark.createDataFrame([("K", ["G1 ", None, "g1", "gone", ""], T, None)], "api_key string, grants array<string>, created_at timestamp, removed_at timestamp")
    msgs = spark.createDataFrame([(1, " J\n", T), (2, None, T), (3, "", T)], "message_id bigint, job_id string, sent_at timestamp")
    stats = spark.createDataFrame([(1, "j", T - H), (1, "j", T - H)], "status_id bigint, job_id string, reported_at timestamp")
    tasks = spark.createDataFrame([("t", "k", T), ("u", "l", T)], "task_id string, api_key string, scheduled_at timestamp")
    grants = spark.createDataFrame([("g1", T, None)], "grant_id string, created_at timestamp, removed_at timestamp")
    jobs = spark.createDataFrame([("J", T, None), ("j ", T, T + H)], "job_id string, created_at timestamp, removed_at timestamp")
    got = references.orphan_references(keys, msgs, stats, tasks, grants, jobs)
    assert sorted(map(tuple, got.collect())) == [
        ("api_keys", "K", "", "missing", "2020-01"), ("api_keys", "K", "gone", "missing", "2020-01"), ("job_messages", "3", "", "missing", "2020-01"),
        ("job_statuses", "1", "j", "late", "2019-12"), ("scheduled_tasks", "u", "l", "missing", "2020-01"),
    ]
    assert {tuple(r) for r in references.orphan_report(got).collect()} >= {("api_keys", "2020-01", "missing", 2)}
