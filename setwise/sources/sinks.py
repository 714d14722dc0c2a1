"""Sinks: JSON values or a JSON array, CSV, and query results kept under a path."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryTimeout, SetwiseError


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row (column value); a result of single values gives the bare values."""
    if df.columns == ["value"]:
        return df.select(F.expr("substring(to_json(struct(value)), 10, length(to_json(struct(value))) - 10)").alias("value"))
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "overwrite") -> None:
    """CSV with a header in every file; members of structs become columns a.b, arrays become JSON text."""
    cols = []

    def walk(prefix: str, ref: str, t) -> None:
        if t.typeName() == "struct":
            for f in t.fields:
                walk(f"{prefix}.{f.name}" if prefix else f.name, f"{ref}.`{f.name}`" if ref else f"`{f.name}`", f.dataType)
        elif t.typeName() in ("array", "map", "variant"):
            cols.append(F.to_json(F.col(ref)).alias(prefix))
        else:
            cols.append(F.col(ref).alias(prefix))

    walk("", "", df.schema)
    df.select(*cols).write.mode(mode).option("header", True).option("sep", delimiter).csv(path)


class ResultCache:
    """Query results kept in a catalog, each under a stream of its own; the newest that is young enough is used again."""

    def __init__(self, catalog, folder: str = "/results"):
        self.catalog, self.folder = catalog, folder
        self.renewal: threading.Thread | None = None

    def get(self, name: str, make, max_age: float | None = None, now: float | None = None, recache_after: float | None = None) -> DataFrame:
        """The cached result of `name`, or make()'s, which is then kept in place of the old one.

        max_age, in seconds: older results aren't used (None: none is). recache_after: a
        result older than this is still given out, and made anew in the background.
        """
        at = time.time() if now is None else now
        path = f"{self.folder}/{name}"
        if max_age is not None:
            ages = [at - int(s.partition("-")[0]) / 1000 for s in self.catalog.streams(path)]
            if ages and min(ages) <= max_age:
                out = self.catalog.read(path)
                if recache_after is not None and min(ages) > recache_after:
                    self.renewal = threading.Thread(target=self._keep, args=(path, make, at), daemon=True)
                    self.renewal.start()
                return out
        self._keep(path, make, at)
        return self.catalog.read(path)

    def _keep(self, path: str, make, at: float) -> None:
        self.catalog.write(path, make(), mode="replace", stream=f"{int(at * 1000)}-result")


def collect(df: DataFrame, timeout: float | None = None) -> list:
    """The rows of a result; after `timeout` seconds its jobs are cancelled and QueryTimeout is raised."""
    if timeout is None:
        return df.collect()
    sc, tag = df.sparkSession.sparkContext, f"setwise-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"more than {timeout} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def page(df: DataFrame, limit: int | None = None, skip: int = 0) -> DataFrame:
    if skip and limit is None:
        raise SetwiseError("skip needs a limit")
    return df if limit is None else df.offset(skip).limit(limit)
