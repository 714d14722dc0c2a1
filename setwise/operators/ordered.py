"""Functions of an ordered set: ranks, one-hot positions, exponential smoothing.

Ranks never order the whole set in one partition: values are range-partitioned and
the parts' totals carried over (scale.prefix).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.values import Val
from ..scale import prefix, stage
from .sets import Algebra, SetExpr, is_key

# The order of kinds when values of several kinds are sorted.
_KIND_ORDER = {"undef": 0, "bool": 1, "str": 2, "num": 3, "obj": 6, "arr": 8, "array": 8, "null": 9, "date": 10, "period": 11}


def sort_columns(v: Val) -> list[Column]:
    """Columns that order values of any kind: kind first, then within it."""
    if v.kind in ("num", "str", "bool", "date"):
        return [v.col]
    if v.kind == "variant":
        s = V.shape(v)
        rank = F.when(s == "BOOLEAN", 1).when(s == "STRING", 2).when(s == "OBJECT", 6).when(s == "ARRAY", 8).when(s == "VOID", 9).otherwise(3)
        return [rank, V.as_num(v), F.coalesce(V.as_plain_text(v), V.json_text(v))]
    if v.kind == "obj":
        return [c for k in sorted(v.fields) for c in sort_columns(v.fields[k])]
    if v.kind == "arr":
        return [c for m in v.items for c in sort_columns(m)]
    return [V.json_text(v)]


def _keys(ids: list[str]) -> list[str]:
    """The keys of solves among identity columns: the function runs in the order of each key by itself."""
    return [i for i in ids if is_key(i)]


def _own(ids: list[str]) -> list[Column]:
    return [F.col(i) for i in ids if not is_key(i)]


def _rank(alg: Algebra, s: SetExpr, make: Callable[[DataFrame, list[Column], list[str]], DataFrame]) -> SetExpr:
    name = f"rk{next(alg.count)}"

    def f(val: Val, ids: list[str]):
        return (lambda df: make(df, sort_columns(val), ids).select(*ids, F.col("_rank").cast("bigint").alias(name))), V.num(F.col(name), True)

    return alg.morph(s, f)


def _per_value(df: DataFrame, order: list[Column], aggs: dict, by: list[str]) -> DataFrame:
    keys = {f"_k{i}": o for i, o in enumerate(order)}
    keyed = df.withColumns(keys)
    per = keyed.groupBy(*by, *keys).agg(F.count("*").alias("_c")).withColumn("_one", F.lit(1))
    ranked = prefix(per, [F.col(k) for k in keys], aggs, by=by)
    cond = None
    for k in [*by, *keys]:
        c = keyed[k].eqNullSafe(ranked[k])
        cond = c if cond is None else cond & c
    return keyed.join(ranked.select(*by, *keys, "_rank"), cond).select(*[keyed[c] for c in df.columns], "_rank")


def rank(alg: Algebra, s: SetExpr) -> SetExpr:
    """Competition rank by value, from 0 (for each key, inside a solve, as all functions here)."""
    return _rank(alg, s, lambda df, order, ids: _per_value(df, order, {"_rank": ("sum", F.col("_c"))}, _keys(ids)))


def dense_rank(alg: Algebra, s: SetExpr) -> SetExpr:
    """Rank among the different values, from 0."""
    return _rank(alg, s, lambda df, order, ids: _per_value(df, order, {"_rank": ("sum", F.col("_one"))}, _keys(ids)))


def indexed_rank(alg: Algebra, s: SetExpr) -> SetExpr:
    """Position in the order of values, from 0; equal values in the order of their identities."""
    return _rank(alg, s, lambda df, order, ids: prefix(df, [*order, *_own(ids)], {"_rank": ("count", F.lit(1))}, by=_keys(ids)))


def dummy(alg: Algebra, s: SetExpr) -> SetExpr:
    """One-hot array of each element's position; its size is the square of the set's."""
    name = f"dm{next(alg.count)}"

    def f(val: Val, ids: list[str]):
        by = _keys(ids)

        def make(df: DataFrame) -> DataFrame:
            r = prefix(df, [*sort_columns(val), *_own(ids)], {"_rank": ("count", F.lit(1))}, by=by)
            n = df.groupBy(*by).agg(F.count("*").alias("_n"))
            hot = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda i: F.when(i == F.col("_rank"), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
            sized = r.join(n, by) if by else r.crossJoin(F.broadcast(n))
            return sized.select(*ids, hot.alias(name))

        return make, Val("array", F.col(name), dtype=T.ArrayType(T.LongType()))

    return alg.morph(s, f)


def _scan(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of the affine maps x -> m x + c up to each of them, by doubling: log2(n) steps over the whole batch."""
    m, c, step = m.copy(), c.copy(), 1
    while step < len(m):
        m1, c1 = m[step:], c[step:]
        c[step:] = np.einsum("nij,nj->ni", m1, c[:-step]) + c1
        m[step:] = np.einsum("nij,njk->nik", m1, m[:-step])
        step *= 2
    return m, c


def _recurrence(alg: Algebra, s: SetExpr, matrix: list[list[float]], input_: list[float], start: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> SetExpr:
    """state' = matrix * state + input * x over the elements {by, smooth} in the order of by (of each key); the value is the state's first part.

    start: the states after first elements x, from x and the elements that follow (nan
    where none does). A linear recurrence composes: an element is an affine map, a
    key's first one a constant. A first pass composes the maps of each range partition,
    these are chained on the driver (one row a partition), and a second pass runs every
    partition from the state before it. In a batch the maps are composed by doubling.
    """
    name = f"sm{next(alg.count)}"
    a, u = np.array(matrix, float), np.array(input_, float)

    def f(val: Val, ids: list[str]):
        by, x = V.deref(val, "by"), V.as_num(V.deref(val, "smooth"))
        keys = _keys(ids)

        def make(df: DataFrame) -> DataFrame:
            order = {f"_k{i}": F.col(c) for i, c in enumerate(keys)}
            order |= {f"_b{i}": c for i, c in enumerate(sort_columns(by))}
            order |= {f"_i{i}": F.col(c).cast("string") for i, c in enumerate(ids) if not is_key(c)}
            rows = df.where(V.defined(by) & x.isNotNull()).select(*ids, x.cast("double").alias(name), *[c.alias(k) for k, c in order.items()])
            n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            parts = stage(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "recurrence")
            # Where a part begins and ends, so that its first row knows the key before it and its last row the element behind it.
            at = F.struct(*order, name)
            edges = parts.groupBy("_part").agg(F.min(at).alias("first"), F.max(at).alias("last"))
            along = Window.orderBy("_part")  # one row a part
            edges = edges.select("_part", F.lag("last").over(along).alias("_before"), F.lead("first").over(along).alias("_behind"))
            inside = Window.partitionBy("_part").orderBy(*order)
            own = F.struct(F.lit(0).alias("_"), *[F.col(f"_k{i}") for i in range(len(keys))])
            key_of = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(0).alias("_"), *[F.col(f"{c}._k{i}") for i in range(len(keys))]))
            seq = parts.withColumn("_own", own).withColumns({"_pk": F.lag("_own").over(inside), "_nk": F.lead("_own").over(inside), "_nx": F.lead(name).over(inside)}).join(F.broadcast(edges), "_part")
            first = ~F.coalesce(F.col("_pk"), key_of("_before")).eqNullSafe(F.col("_own"))
            follows = F.coalesce(F.col("_nk"), key_of("_behind")).eqNullSafe(F.col("_own"))
            # Plain columns carry the order through the batches: a part is contiguous and sorted within its task.
            seq = seq.select(*ids, name, "_part", first.alias("_first"), F.when(follows, F.coalesce("_nx", F.col(f"_behind.{name}"))).alias("_next"), *order)
            seq = seq.sortWithinPartitions("_part", *order).select(*ids, name, "_part", "_first", "_next")
            k, d = len(ids), len(u)

            def states(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                xs, ps, fs, ns = (b.column(k + i).to_numpy(zero_copy_only=False) for i in range(4))
                m = np.repeat(a[None], len(xs), 0)
                c = xs[:, None] * u
                fs = fs.astype(bool)
                m[fs] = 0.0
                c[fs] = start(xs[fs], ns[fs].astype(float))
                return m, c, ps

            def maps(frames: Iterator) -> Iterator:
                import pyarrow as pa

                done: dict[int, tuple] = {}
                for b in frames:
                    m, c, ps = states(b)
                    for p in np.unique(ps):
                        mm, cc = _scan(m[ps == p], c[ps == p])
                        m0, c0 = done.get(int(p), (np.eye(d), np.zeros(d)))
                        done[int(p)] = (mm[-1] @ m0, mm[-1] @ c0 + cc[-1])
                yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array([m.ravel().tolist() for m, _ in done.values()], pa.list_(pa.float64())), pa.array([c.tolist() for _, c in done.values()], pa.list_(pa.float64()))], names=["part", "m", "c"])

            state, starts = np.zeros(d), {}
            for r in sorted(seq.mapInArrow(maps, "part int, m array<double>, c array<double>").collect()):
                starts[r.part] = state
                state = np.array(r.m).reshape(d, d) @ state + np.array(r.c)

            def run(frames: Iterator) -> Iterator:
                import pyarrow as pa

                cur: dict[int, np.ndarray] = {}
                for b in frames:
                    m, c, ps = states(b)
                    out = np.empty(len(ps))
                    for p in np.unique(ps):
                        at = ps == p
                        mm, cc = _scan(m[at], c[at])
                        got = mm @ cur.get(int(p), starts[int(p)]) + cc
                        out[at] = got[:, 0]
                        cur[int(p)] = got[-1]
                    yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(out, pa.float64())], names=[*ids, name])

            return seq.mapInArrow(run, seq.select(*ids, name).schema)

        return make, V.num(F.col(name))

    return alg.morph(s, f)


def simple_exp_smoothing(alg: Algebra, s: SetExpr, alpha: float) -> SetExpr:
    """s = alpha * x + (1 - alpha) * s before; the first is the first element."""
    return _recurrence(alg, s, [[1 - alpha]], [alpha], lambda x, _: x[:, None])


def double_exp_smoothing(alg: Algebra, s: SetExpr, alpha: float, beta: float) -> SetExpr:
    """Level and trend; the first level is x0, the first trend x1 - x0."""
    # level' = alpha x + (1 - alpha)(level + trend); trend' = beta (level' - level) + (1 - beta) trend
    m = [[1 - alpha, 1 - alpha], [beta * (1 - alpha) - beta, beta * (1 - alpha) + 1 - beta]]
    return _recurrence(alg, s, m, [alpha, alpha * beta], lambda x, following: np.stack([x, np.nan_to_num(following - x)], axis=1))


def sort_rows(df: DataFrame, v: Val, paths: list[str], descending: bool = False) -> DataFrame:
    """Rows in the order of the values at the paths (query option sortOn)."""
    cols: list[Column] = []
    for p in paths:
        m = v
        for part in [x for x in p.replace("[", ".[").split(".") if x]:
            m = V.index(m, V.constant(int(part[1:-1]))) if part.startswith("[") else V.deref(m, part)
        cols += sort_columns(m)
    return df.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_last() for c in cols])
