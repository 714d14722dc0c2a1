import random

import pytest
from pyspark.sql import functions as F

from setwise import scale
from setwise.operators import incremental as inc


def test_intervals_and_gaps_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(inc, "BUCKET", 16)
    rng = random.Random(1)
    rows = [(k, rng.randrange(-50, 200)) for k in range(3) for _ in range(150)] + [(None, 3), (1, None)] * 2
    df = spark.createDataFrame(rows, "k int, s bigint")
    have = {(k, s) for k, s in rows if k is not None and s is not None}
    ivs = [tuple(r) for r in inc.to_intervals(df, ["k"], "s").collect()]
    covered = {(k, x) for k, lo, hi in ivs for x in range(lo, hi + 1)}
    assert covered == have
    for k, lo, hi in ivs:
        assert (k, lo - 1) not in have and (k, hi + 1) not in have
    done = spark.createDataFrame([(0, -1000, 20), (0, 40, 60), (1, 10, 5), (1, 0, 3), (1, 4, 9), (7, 1, 2)], "k int, lo bigint, hi bigint")
    flagged = inc.flag_pending(df, inc.merge_intervals(done, ["k"]), ["k"], "s").collect()
    taken = lambda k, s: k is not None and s is not None and ((k == 0 and (s <= 20 or 40 <= s <= 60)) or (k == 1 and 0 <= s <= 9))
    assert len(flagged) == len(rows)
    assert all(r.pending == (not taken(r.k, r.s)) for r in flagged)


def test_ledger_survives_a_failure(spark, tmp_path):
    led = inc.IntervalLedger(spark, f"file://{tmp_path}/led", ["k"], ["int"])
    rows = spark.createDataFrame([(k, s) for k in range(2) for s in range(10)], "k int, s bigint")
    rows = rows.selectExpr("*", "1 as gaps", "2 as _bucket", "3 as pending", "4 as _s", "5 as lo")
    first = led.pending(rows.where("s < 5"), "s")
    with pytest.raises(RuntimeError):
        led.commit(first, first, "s", fail_before_marker=True)
    assert led.output() is None
    first = led.pending(rows.where("s < 5 or s = 8"), "s")
    led.commit(first, first, "s", "r1")
    with pytest.raises(ValueError):
        led.commit(first, first, "s", "r1")
    late = led.pending(rows, "s")  # 5..7 and 9, the late ones below 8 included
    assert sorted({r.s for r in late.collect()}) == [5, 6, 7, 9]
    led.commit(late, late, "s", "r2")
    assert led.pending(rows, "s").count() == 0
    assert sorted((r.k, r.s) for r in led.output().collect()) == sorted((k, s) for k in range(2) for s in range(10))
    assert len(led.interval_sets()) == 2
    led.compact()
    assert len(led.interval_sets()) == 1 and led.compact() is None
    assert not {"r1", "r2"} & {p.name for p in (tmp_path / "led" / "intervals").iterdir()}
    assert [tuple(r) for r in led.committed().orderBy("k").collect()] == [(0, 0, 9), (1, 0, 9)]
    assert led.output().count() == 20


def test_ledger_takes_what_it_wrote(spark, tmp_path):
    """Rows that reach the source while a run writes are neither in its output nor marked as taken."""
    src = f"file://{tmp_path}/src"
    spark.range(5).selectExpr("1 as k", "id as s").write.parquet(src)
    led = inc.IntervalLedger(spark, f"file://{tmp_path}/led", ["k"], ["int"])
    taken = led.pending(spark.read.parquet(src), "s")

    def make(rows):
        spark.range(5, 8).selectExpr("1 as k", "id as s").write.mode("append").parquet(src)
        return rows

    led.commit(make, taken, "s")
    assert sorted(r.s for r in led.output().collect()) == [0, 1, 2, 3, 4]
    rest = led.pending(spark.read.parquet(src), "s")
    assert sorted(r.s for r in rest.collect()) == [5, 6, 7]


def test_one_of_two_runs_counts(spark, tmp_path):
    rows = spark.range(4).selectExpr("1 as k", "id as s")
    one, two = (inc.IntervalLedger(spark, f"file://{tmp_path}/led", ["k"], ["int"]) for _ in range(2))
    a, b = one.pending(rows, "s"), two.pending(rows, "s")
    one.commit(a, a, "s")
    with pytest.raises(RuntimeError):
        two.commit(b, b, "s")
    assert two.pending(rows, "s").count() == 0 and two.output().count() == 4


def test_numbers_far_apart(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2**45), ("a", -(2**62)), ("a", 2**62), ("b", 5), ("b", 2**45)], "k string, s bigint")
    done = spark.createDataFrame([("a", 0, 2**44), ("b", -(2**62), 2**50)], "k string, lo bigint, hi bigint")
    got = {(r.k, r.s): r.pending for r in inc.flag_pending(rows, done, ["k"], "s").collect()}
    assert got == {("a", 1): False, ("a", 2**45): True, ("a", -(2**62)): True, ("a", 2**62): True, ("b", 5): False, ("b", 2**45): False}


def events(spark, rows):
    return spark.createDataFrame(rows, "agent_id int, msg_offset bigint, event string, producer_id int, sequence_id int, changed_at timestamp")


CLOCK = "array<struct<producer_id:int,sequence_id:int>>"
SCHEMA = f"run_no bigint, agent_id int, started_at timestamp, saved_at timestamp, outcome string, msg_offset bigint, message_clock {CLOCK}"


def test_pending_messages(spark, monkeypatch):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    h = dt.timedelta(hours=1)
    rows = [
        (1, 10, "{}", 7, 3, None),  # taken in
        (1, 11, "{}", 7, 4, None),  # beyond the clock
        (1, None, '{"offset": 9}', 7, 1, None),  # taken in, offset in the event
        (1, 30, "{}", 7, 2, None),  # beyond the offset
        (1, 30, "{}", 7, 2, None),
        (1, 8, "{}", 8, 1, None),  # a producer without an entry
        (1, 7, "{}", 7, 2, t + 2 * h),  # changed later
        (1, 6, "{}", 7, 9, None),  # one delivery beyond ...
        (1, 6, "{}", 7, 1, None),  # ... another within: taken in
        (2, 1, "{}", 1, 1, None),  # no good run
        (None, 5, "{}", 7, 1, None),
        (1, None, "no json", 7, 1, None),
        (1, 5, "{}", None, None, None),
    ]
    runs = [
        (5, 1, t, t + h, " OK", 12, [(7, 3), (7, 2)]),
        (6, 1, t, None, "ok", 99, [(7, 99)]),
        (7, 1, t, t, "failed", 99, [(7, 99)]),
        (4, 1, t, t, "ok", 99, [(7, 99)]),
        (1, 2, t, t, "failed", 9, None),
        (None, 2, t, t, "ok", 9, [(1, 9)]),
    ]
    ev = events(spark, rows).selectExpr("*", "1 as pending", "2 as _bucket", "3 as gaps")
    cp = spark.createDataFrame(runs, SCHEMA)
    want = [(1, 5), (1, 7), (1, 8), (1, 11), (1, 30), (2, 1)]
    assert sorted(map(tuple, inc.pending_messages(ev, cp).collect())) == want
    # without any broadcast: the same rows by the split join
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(scale.skew_join, "__defaults__", ("left", 0))
    assert sorted(map(tuple, inc.pending_messages(ev, cp).collect())) == want


def test_pending_of_empty_tables(spark):
    ev = events(spark, [])
    cp = spark.createDataFrame([], SCHEMA)
    assert inc.pending_messages(ev, cp).count() == 0
    assert inc.pending_messages(events(spark, [(1, 1, "{}", 1, 1, None)]), cp).count() == 1


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_equals_join(spark, how):
    left = spark.range(3000).selectExpr("case when id % 3 = 0 then 1 when id % 50 = 1 then null else id end as k", "id as v")
    right = spark.range(2500).selectExpr("id as k", "id * 2 as w")
    want = sorted(map(str, left.join(right, ["k"], how).select("k", "v", "w").collect()))
    for rows in (0, 10_000):
        assert sorted(map(str, scale.skew_join(left, right, ["k"], how, rows=rows).select("k", "v", "w").collect())) == want


def test_prefix_of_each_key(spark):
    from pyspark.sql import Window

    df = spark.range(500).selectExpr("id", "(id * 7919) % 101 as x", "case when id % 3 = 0 then 0 else id % 17 end as k")
    got = scale.prefix(df, [F.col("x"), F.col("id")], {"n": ("count", F.lit(1)), "m": ("max", F.col("x"))}, parts=5, by=["k"])
    w = Window.partitionBy("k").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"n": F.count(F.lit(1)).over(w), "m": F.max("x").over(w)})
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_broadcasts_are_bounded_in_bytes(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 1000) as t", "array(id, id) as a")
    assert scale.fits_broadcast(df) and not scale.fits_broadcast(df, size=9_000) and not scale.fits_broadcast(df, rows=9)


def test_prefix_equals_window(spark):
    from pyspark.sql import Window

    df = spark.range(500).selectExpr("id", "(id * 7919) % 101 as x")
    got = scale.prefix(df, [F.col("x"), F.col("id")], {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("min", F.col("id"))}, parts=5)
    w = Window.orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"n": F.count(F.lit(1)).over(w), "s": F.coalesce(F.sum("x").over(w), F.lit(0)), "m": F.max("x").over(w), "l": F.min("id").over(w)})
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
