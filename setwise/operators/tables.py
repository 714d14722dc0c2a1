"""Operators on whole tables: the physical algebra beneath the language, for use on DataFrames directly.

Each is one declarative step; Catalyst picks the physical one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..scale import prefix, stage
from .sets import MAX_CROSS


def transform(df: DataFrame, **cols: Column) -> DataFrame:
    """A projection."""
    return df.select(*[c.alias(n) for n, c in cols.items()])


def compact(df: DataFrame, cols: list[str] | None = None, how: str = "all") -> DataFrame:
    """Drop rows in which all (or, with how='any', any) of the columns are undefined."""
    return df.dropna(how=how, subset=cols)


def join(a: DataFrame, b: DataFrame, on: list[str], f: Callable[[], list[Column]] | None = None) -> DataFrame:
    """Rows of equal keys, brought together."""
    out = a.join(b, on, "inner")
    return out.select(*on, *f()) if f else out


def cogroup(a: DataFrame, b: DataFrame, on: list[str], left: Callable[[], Column], right: Callable[[], Column], both: Callable[[], Column], name: str = "value") -> DataFrame:
    """Every key of either side: left() where only a has it, right() where only b has it, both() for every pair."""
    x, y = a.withColumn("_in_a", F.lit(True)), b.withColumn("_in_b", F.lit(True))
    value = F.when(F.col("_in_b").isNull(), left()).when(F.col("_in_a").isNull(), right()).otherwise(both())
    return x.join(y, on, "full_outer").select(*on, value.alias(name))


def align(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to the keys that both have."""
    return a.join(b.select(*on), on, "left_semi"), b.join(a.select(*on), on, "left_semi")


def cross(a: DataFrame, b: DataFrame, most: int = MAX_CROSS) -> DataFrame:
    """All pairs of rows, if there are no more than `most`; the sizes are counted first."""
    n = a.count() * b.count()
    if n > most:
        raise E.EnormousCross(f"{n} rows, permitted are {most}")
    return a.crossJoin(b)


def sort(df: DataFrame, by: list[Column], unique: bool = False, ids: list[str] | None = None) -> DataFrame:
    """Rows in order, ties in the order of the identities; unique keeps one row (the least by ids) of each key."""
    if unique:
        keys = {f"_k{i}": c for i, c in enumerate(by)}
        rest = [c for c in df.columns if c not in (ids or [])]
        first = df.withColumns(keys).groupBy(*keys).agg(F.min(F.struct(*(ids or []), *rest)).alias("_r"))
        return first.orderBy(*keys).select("_r.*").select(*df.columns)
    return df.orderBy(*by, *(ids or []))


def group_by_n(df: DataFrame, keys: list[list[Column]]) -> list[DataFrame]:
    """One ordering of the table for each list of keys; the table is computed once."""
    base = stage(df, "group_by_n")
    return [base.orderBy(*k) for k in keys]


def distinct(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(by)


def take_range(df: DataFrame, order: list[Column], start: int, n: int) -> DataFrame:
    """n rows from the start-th on (from 0) in an order."""
    return df.orderBy(*order).offset(start).limit(n)


def partition_merge(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """One result for each run of equal keys."""
    return df.groupBy(*keys).agg(*aggs)


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, repeats included; a column that one lacks is undefined there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def zip_rows(a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """The i-th row of a with the i-th of b, as far as both go; positions come from range-partitioned counts."""
    at = lambda df, o: prefix(df, o, {"_at": ("count", F.lit(1))})
    return at(a, order_a).join(at(b, order_b), "_at").drop("_at")


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows, every subset as likely, the same for one seed: those with the least hashes of their content (and occurrence)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])).limit(n)


def schemas(df: DataFrame, column: str = "value") -> DataFrame:
    """(schema): the different types of a VARIANT column's values."""
    return df.where(F.col(column).isNotNull()).select(F.schema_of_variant(column).alias("schema")).distinct()


def scan(df: DataFrame, order: list[Column], name: str, fn: str, value: Column) -> DataFrame:
    """df with a running sum, count, min or max in an order, its own row included."""
    out = prefix(df.withColumn("_value", value), order, {"_before": (fn, F.col("_value"))})
    own = F.col("_value") if fn != "count" else F.when(F.col("_value").isNotNull(), 1).otherwise(0)
    both = {"sum": F.coalesce("_before", F.lit(0)) + F.coalesce(own, F.lit(0)), "count": F.coalesce("_before", F.lit(0)) + own, "max": F.greatest("_before", own), "min": F.least("_before", own)}[fn]
    return out.withColumn(name, both).drop("_before", "_value")


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """An effectful mapper of column batches (pandas frames in, pandas frames out)."""

    def run(frames):
        for pdf in frames:
            yield f(pdf)

    return df.mapInPandas(run, schema)


def force(df: DataFrame) -> DataFrame:
    """The table, computed once and kept in the shared folder."""
    return stage(df, "force")
