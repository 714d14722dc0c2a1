"""Continuous ingest and queries over streams, on Structured Streaming.

The checkpoint folder holds the offsets, so a run that dies goes on where it was and
every batch is known by its checkpoint and number - delivering one again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import SetwiseError
from ..manifest import Manifest
from ..sources.catalog import Catalog


def stream_files(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def ingest(source: DataFrame, catalog: Catalog, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> StreamingQuery:
    """Append (or, with mode 'replace', keep only the newest of) what has arrived to a dataset, once each.

    Batches are numbered per checkpoint: each checkpoint folder has an id of its own, so
    several ingests may feed one dataset, and one that lost its checkpoint starts anew.
    """
    own = Manifest(catalog.spark, f"{checkpoint}/_source")
    scope = own.update(lambda c: c or {"id": uuid.uuid4().hex})["id"]

    def write(batch: DataFrame, no: int) -> None:
        catalog.write(path, transform(batch) if transform else batch, mode=mode, batch=(scope, no))

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(source: DataFrame, time: str, width: str, keys: list[str], aggs: list, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates per tumbling or sliding window and keys; rows later than `late` are dropped by the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return source.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(*aggs)


def sessions(source: DataFrame, time: str, gap: str, keys: list[str], aggs: list, late: str = "10 minutes") -> DataFrame:
    """Aggregates per session: runs of rows of the same keys with no pause longer than `gap`."""
    return source.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggs)


def run_scheduled(catalog: Catalog, text: str, sink: str, base: str = "/", **options) -> str:
    """One run of a scheduled query: its result replaces the content of the sink path. Any scheduler may call it."""
    from ..lang.compiler import query

    return catalog.write(sink, query(catalog.spark, text, {}, base, catalog.resolve, **options), mode="replace")


#: Least and greatest values of the five fields: minute, hour, day of month, month, day of week (0 and 7 are Sunday).
_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


class Cron:
    """A repetition in five fields, each *, a value, a range a-b, a list, or one of these with /step; or in six, with seconds first and days of the week from 1, Sunday."""

    def __init__(self, text: str):
        parts = text.split()
        if len(parts) not in (5, 6):
            raise SetwiseError(f"five or six fields, not {len(parts)}: {text}")
        first = 1 if len(parts) == 6 else 0
        self.seconds = self._field(parts[0], 0, 59) if first else {0}
        parts = parts[first:]
        self.any = [p[0] in "*?" for p in parts]
        self.sets = [self._field(p, *b) for p, b in zip(parts, _FIELDS[:4])]
        self.sets.append({(x - first) % 7 for x in self._field(parts[4], first, 7)})

    @staticmethod
    def _field(text: str, lo: int, hi: int) -> set[int]:
        out: set[int] = set()
        for item in text.split(","):
            span, _, step = item.partition("/")
            a, dash, b = span.partition("-")
            try:
                first, last = (lo, hi) if span in ("*", "?") else (int(a), int(b) if dash else hi if step else int(a))
                out |= set(range(first, last + 1, int(step or 1)))
            except ValueError:
                raise SetwiseError(f"no repetition: {text}") from None
        if not out or min(out) < lo or max(out) > hi:
            raise SetwiseError(f"out of range: {text}")
        return out

    def after(self, t: datetime) -> datetime:
        """The first time after t that fits; if both days are given, either may fit."""
        later = [s for s in sorted(self.seconds) if s > t.second]
        t = t.replace(second=0, microsecond=0)
        if later and self._fits(t):
            return t.replace(second=later[0])
        t += timedelta(minutes=1)
        end = t + timedelta(days=366 * 9)
        while t < end:
            if not self._day_fits(t):
                t = t.replace(hour=0, minute=0) + timedelta(days=1)
            elif t.hour not in self.sets[1]:
                t = t.replace(minute=0) + timedelta(hours=1)
            elif t.minute not in self.sets[0]:
                t += timedelta(minutes=1)
            else:
                return t.replace(second=min(self.seconds))
        raise SetwiseError("never")

    def _day_fits(self, t: datetime) -> bool:
        day, week = t.day in self.sets[2], (t.weekday() + 1) % 7 in self.sets[4]
        return t.month in self.sets[3] and (day and week if self.any[2] or self.any[4] else day or week)

    def _fits(self, t: datetime) -> bool:
        return self._day_fits(t) and t.hour in self.sets[1] and t.minute in self.sets[0]


class Schedule:
    """Queries that are due at times; run_due() runs each that is due once, whatever was missed."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.tasks = catalog, {}

    def add(self, name: str, cron: str, text: str, sink: str, now: datetime, **options) -> None:
        c = Cron(cron)
        self.tasks[name] = [c, text, sink, options, c.after(now)]

    def run_due(self, now: datetime) -> list[str]:
        """Names of the tasks that ran."""
        ran = []
        for name, task in self.tasks.items():
            if task[4] <= now:
                run_scheduled(self.catalog, task[1], task[2], **task[3])
                task[4] = task[0].after(now)
                ran.append(name)
        return ran
