"""Processing only what is new or changed (problem 2).

What a consumer has taken in is kept as disjoint intervals of sequence numbers
per key. Subtracting them from the available ranges leaves gaps; rows in a gap
are pending, late commits below the high mark included. ``IntervalLedger``
commits the merged intervals together with the run's output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..manifest import Manifest
from ..scale import _delete, discard, prefix, skew_join, stage

#: Sequence numbers per work unit: gaps are kept per bucket, so no group of them outgrows half of it.
BUCKET = 4_096


def to_intervals(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Disjoint intervals (keys, lo, hi) that hold exactly the sequence numbers of rows.

    Runs are found inside buckets of BUCKET numbers (so a key with any share of
    the rows is spread), then adjoining runs of neighbouring buckets are merged.
    Null keys or numbers are skipped; repeats don't matter.
    """
    distinct = rows.select(*keys, F.col(seq).cast("bigint").alias("_s")).dropna().distinct()
    bucket = bucket_of(F.col("_s")).alias("_b")
    w = Window.partitionBy(*keys, "_b").orderBy("_s")
    runs = (
        distinct.select("*", bucket)
        .withColumn("_g", F.col("_s") - F.row_number().over(w))
        .groupBy(*keys, "_b", "_g")
        .agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
        .select(*keys, "lo", "hi")
    )
    return merge_intervals(runs, keys)


def merge_intervals(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Union of possibly overlapping or adjoining intervals (keys, lo, hi), as disjoint ones; empty ones (hi < lo) vanish.

    The greatest end before each interval, and the number of intervals that begin
    anew, are running aggregates (scale.prefix), so a key may hold any share of them.
    """
    some = intervals.where("lo <= hi").select(*keys, "lo", "hi")
    reach = prefix(some, [F.col("lo"), F.col("hi")], {"_reach": ("max", F.col("hi"))}, by=keys)
    fresh = reach.select(*keys, "lo", "hi", F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach") + 1), 1).otherwise(0).alias("_new"))
    nth = prefix(fresh, [F.col("lo"), F.col("hi"), -F.col("_new")], {"_before": ("sum", F.col("_new"))}, by=keys)
    return nth.groupBy(*keys, (F.col("_before") + F.col("_new")).alias("_g")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def gaps(rows: DataFrame, committed: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Available ranges minus committed intervals, per bucket: (keys, _bucket, gaps array<struct<lo,hi>>).

    Available is, per key and bucket that occurs, the range from the least to the
    greatest number present. committed: (keys, lo, hi), disjoint per key. A bucket
    that is wholly taken in has an empty array. An interval meets the buckets of its
    two ends by their numbers, and those it covers by a running maximum over the
    buckets that occur, so far-off numbers cost no more than near ones. The group
    that is folded is one bucket of one key: at most BUCKET / 2 intervals.
    """
    avail = (
        rows.select(*keys, F.col(seq).cast("bigint").alias("_s"))
        .dropna(subset=[*keys, "_s"])
        .groupBy(*keys, bucket_of(F.col("_s")).alias("_bucket"))
        .agg(F.min("_s").alias("_from"), F.max("_s").alias("_to"))
    )
    avail = stage(avail, "available")
    done = committed.where("lo <= hi").select(*keys, "lo", "hi", bucket_of(F.col("lo")).alias("_first"), bucket_of(F.col("hi")).alias("_last"))
    # A bucket is covered where an interval that begins in an earlier bucket ends in a later one.
    line = avail.select(*keys, F.col("_bucket").alias("_at"), F.lit(0).alias("_tag"), F.lit(None).cast("bigint").alias("_last"))
    line = line.unionByName(done.where("_last - _first > 1").select(*keys, F.col("_first").alias("_at"), F.lit(1).alias("_tag"), "_last"))
    over = prefix(line, [F.col("_at"), F.col("_tag")], {"_reach": ("max", F.col("_last"))}, by=keys)
    covered = over.where("_tag = 0 and _reach > _at").select(*keys, F.col("_at").alias("_bucket"), F.lit(True).alias("_covered"))
    ends = done.select(*keys, "lo", "hi", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_bucket"))
    ends = ends.join(avail.select(*keys, "_bucket"), [*keys, "_bucket"], "left_semi")
    taken = ends.groupBy(*keys, "_bucket").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_taken"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    start = F.struct(none.alias("out"), F.col("_from").alias("next"))
    cut = F.aggregate(
        F.coalesce("_taken", none),
        start,
        lambda acc, t: F.struct(
            F.when((acc["next"] < t["lo"]) & (acc["next"] <= F.col("_to")), F.concat(acc["out"], F.array(F.struct(acc["next"].alias("lo"), F.least(t["lo"] - 1, F.col("_to")).alias("hi"))))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["next"], t["hi"] + 1).alias("next"),
        ),
    )
    rest = F.when(F.col("_cut.next") <= F.col("_to"), F.concat("_cut.out", F.array(F.struct(F.col("_cut.next").alias("lo"), F.col("_to").alias("hi"))))).otherwise(F.col("_cut.out"))
    return (
        avail.join(taken, [*keys, "_bucket"], "left")
        .join(covered, [*keys, "_bucket"], "left")
        .withColumn("_cut", cut)
        .select(*keys, "_bucket", F.when(F.col("_covered"), none).otherwise(rest).alias("gaps"))
    )


def bucket_of(c: Column) -> Column:
    """The bucket of a sequence number, exact for all 64-bit numbers."""
    return F.shiftright(c, BUCKET.bit_length() - 1)


def flag_pending(rows: DataFrame, committed: DataFrame, keys: list[str], seq: str, flag: str = "pending", available: DataFrame | None = None) -> DataFrame:
    """rows with a boolean column: is the row's number in a gap? A null key or number is always pending.

    available: where the ranges come from, if not rows; a narrow scan of the same
    numbers spares reading what rows computes.
    """
    gap = stage(gaps(rows if available is None else available, committed, keys, seq), "gaps")
    # The rest of a row travels in one struct, so that no name of it can clash.
    keep = [c for c in rows.columns if c != flag]
    at = rows.select(*keys, F.col(seq).cast("bigint").alias("_s"), bucket_of(F.col(seq).cast("bigint")).alias("_bucket"), F.struct(*keep).alias("_row"))
    joined = skew_join(at, gap, [*keys, "_bucket"], "left")
    inside = F.exists("gaps", lambda g: F.col("_s").between(g["lo"], g["hi"]))
    return joined.select("_row", F.coalesce(inside, F.lit(True)).alias("_flag")).select("_row.*", F.col("_flag").alias(flag))


class IntervalLedger:
    """Committed intervals of a consumer, kept beside its output in a folder all executors share.

    A run writes its output and its intervals under its own id and then publishes the
    next version of the ledger, which makes both count at once. A run that dies before
    that leaves nothing visible; running it again, under any id, neither skips nor
    repeats. Of two runs that took their rows from one version only the first to commit
    counts; the other is refused and takes its rows again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], key_types: list[str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.types = key_types or ["bigint"] * len(keys)
        self.manifest = Manifest(spark, f"{self.path}/versions")
        self._base: int | None = None

    def runs(self) -> list[str]:
        """Ids of the committed runs."""
        return self.manifest.latest()[1].get("runs", [])

    def interval_sets(self) -> list[str]:
        """Names of the interval sets that the newest version reads: one a run since the last compaction, and its result."""
        return self.manifest.latest()[1].get("intervals", [])

    def _intervals(self, sets: list[str]) -> DataFrame:
        schema = ", ".join(f"{k} {t}" for k, t in zip(self.keys, self.types)) + ", lo bigint, hi bigint"
        if not sets:
            return self.spark.createDataFrame([], schema)
        return merge_intervals(self.spark.read.schema(schema).parquet(*[f"{self.path}/intervals/{x}" for x in sets]), self.keys)

    def committed(self) -> DataFrame:
        """Merged intervals (keys, lo, hi) of all committed runs."""
        return self._intervals(self.interval_sets())

    def pending(self, rows: DataFrame, seq: str) -> DataFrame:
        """The rows that no committed run has taken in; a commit that follows counts only if none came between."""
        self._base, content = self.manifest.latest()
        return flag_pending(rows, self._intervals(content.get("intervals", [])), self.keys, seq).where("pending").drop("pending")

    def commit(self, output: DataFrame | Callable[[DataFrame], DataFrame], taken: DataFrame, seq: str, run_id: str | None = None, fail_before_marker: bool = False) -> str:
        """Write output and the intervals of the numbers in taken, then make both count. fail_before_marker is for tests.

        taken is written once and read back, so it cannot change between the two; output
        is best a function of those rows. A DataFrame other than taken itself must come
        from a source that stays the same.
        """
        run = run_id or uuid.uuid4().hex
        version, content = self.manifest.latest()
        if run in content.get("runs", []):
            raise ValueError(f"run {run} is committed already")
        base = version if self._base is None else self._base
        snapshot = stage(taken, "taken")
        made = output(snapshot) if callable(output) else snapshot if output is taken else output
        made.write.mode("overwrite").parquet(f"{self.path}/output/{run}")
        to_intervals(snapshot, self.keys, seq).write.mode("overwrite").parquet(f"{self.path}/intervals/{run}")
        discard(snapshot)
        if fail_before_marker:
            raise RuntimeError("stopped before the commit marker")
        self._base = None
        new = {"runs": [*content.get("runs", []), run], "intervals": [*content.get("intervals", []), run]}
        if version != base or not self.manifest.publish(base + 1, new):
            raise RuntimeError("another run was committed since the rows were taken; take them again")
        return run

    def output(self) -> DataFrame | None:
        """The output of all committed runs."""
        paths = [f"{self.path}/output/{r}" for r in self.runs()]
        return self.spark.read.parquet(*paths) if paths else None

    def compact(self) -> str | None:
        """Merge the intervals of all runs into one set, whose size follows the gaps and not the runs, and delete the sets it replaces.

        A run that is committed meanwhile keeps its set; None where there is nothing to merge.
        """
        sets, name = self.interval_sets(), f"compact-{uuid.uuid4().hex}"
        if len(sets) < 2:
            return None
        self._intervals(sets).write.parquet(f"{self.path}/intervals/{name}")
        self.manifest.update(lambda c: {**c, "intervals": [name, *[x for x in c["intervals"] if x not in sets]]})
        for x in sets:
            _delete(self.spark, f"{self.path}/intervals/{x}")
        return name


def message_offset():
    """A delivery's offset: msg_offset, or the event's own where that is null."""
    return F.coalesce(F.col("msg_offset"), F.get_json_object("event", "$.offset").try_cast("bigint"))


def pending_messages(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(agent_id, msg_offset) of the messages that each agent's next run has still to take in.

    The last good run of an agent (greatest run_no, outcome ok, saved_at set)
    gives its processed intervals: per producer the sequence numbers up to the
    clock's entry, and the offsets up to msg_offset. A message is done when one of
    its deliveries lies in both; it is pending anyway when some changed_at is
    later than the start of that run.

    Defined cases: no good run - all messages pending; a producer without a clock
    entry, or a null producer, sequence or clock value - nothing taken in; several
    entries for a producer - the greatest; repeated runs with one run_no - one of
    them, the greatest by (saved_at, started_at, msg_offset); a delivery without
    agent or offset names no message and is left out.
    """
    order = F.struct("run_no", "saved_at", "started_at", "msg_offset")
    runs = (
        checkpoints.where((F.lower(F.trim("outcome")) == "ok") & F.col("saved_at").isNotNull() & F.col("agent_id").isNotNull() & F.col("run_no").isNotNull())
        .groupBy("agent_id")
        .agg(F.max_by(F.struct("msg_offset", "started_at", "message_clock"), order).alias("r"))
        .select("agent_id", F.col("r.msg_offset").alias("_done_to"), F.col("r.started_at").alias("_started"), F.col("r.message_clock").alias("_clock"))
    )
    runs = stage(runs, "runs")
    committed = (
        runs.select("agent_id", F.inline("_clock"))
        .groupBy("agent_id", "producer_id")
        .agg(F.max("sequence_id").cast("bigint").alias("hi"))
        .dropna()
        .withColumn("lo", F.lit(-(2**62)))
    )
    rows = events.select("agent_id", message_offset().alias("_offset"), "producer_id", F.col("sequence_id").cast("bigint").alias("sequence_id"), "changed_at")
    rows = rows.where(F.col("agent_id").isNotNull() & F.col("_offset").isNotNull())
    flagged = flag_pending(rows, committed, ["agent_id", "producer_id"], "sequence_id", available=events)
    flagged = skew_join(flagged, runs.drop("_clock"), ["agent_id"], "left")
    taken = ~F.col("pending") & (F.col("_offset") <= F.col("_done_to"))
    changed = F.col("changed_at") > F.col("_started")
    return (
        flagged.groupBy("agent_id", F.col("_offset").alias("msg_offset"))
        .agg(F.bool_or(F.coalesce(taken, F.lit(False))).alias("taken"), F.bool_or(F.coalesce(changed, F.lit(False))).alias("changed"))
        .where("changed or not taken")
        .select("agent_id", "msg_offset")
    )


def relay_runs(events: DataFrame, path: str) -> DataFrame:
    """Two runs of a consumer of the relay events, the second with everything that came late.

    The first run takes in what was delivered in the first half of the time that the
    table spans, the second whatever is there and not yet taken in, numbers below those
    of the first run included. Output and merged intervals of offsets per agent are
    committed to a ledger at path. Gives (run, agent_id, messages, lowest, highest) of
    each run's output and, as run 0, the number and range of the agent's intervals.
    """
    ledger = IntervalLedger(events.sparkSession, path, ["agent_id"], ["int"])
    rows = events.select("agent_id", message_offset().alias("offset"), "delivered_at").dropna(subset=["agent_id", "offset"])
    ends = rows.agg(F.min("delivered_at").alias("a"), F.max("delivered_at").alias("b"))
    half = F.timestamp_seconds((F.unix_seconds(F.col("a").cast("timestamp")) + F.unix_seconds(F.col("b").cast("timestamp"))) / 2)
    early = rows.crossJoin(F.broadcast(ends)).where(F.col("delivered_at").cast("timestamp") <= half).drop("a", "b")
    for n, source in ((1, early), (2, rows)):
        taken = ledger.pending(source, "offset")
        ledger.commit(lambda r, n=n: r.groupBy("agent_id", "offset").agg(F.lit(n).alias("run")), taken, "offset", f"run-{n}")
    ledger.compact()
    per = ledger.output().groupBy("run", "agent_id").agg(F.count("*").alias("messages"), F.min("offset").alias("lowest"), F.max("offset").alias("highest"))
    merged = ledger.committed().groupBy("agent_id").agg(F.count("*").alias("messages"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"))
    return per.unionByName(merged.select(F.lit(0).alias("run"), "agent_id", "messages", "lowest", "highest"))
