"""Bivariate statistics, regressions, clustering, forests and normalisation.

Models are named model1 as a set of one known shape has one model. Sufficient
statistics are aggregated on the executors; only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions import values as V
from ..functions.values import Val
from ..scale import discard, skew_join, stage
from .reductions import numeric_leaves, rebuild
from .sets import Algebra, SetExpr

#: Rows that a forest is grown on, at most (a bounded fit; scoring covers all rows).
FOREST_ROWS = 10_000
FOREST_TREES = 30
NEWTON_ROUNDS = 25


# --- two variables -------------------------------------------------------------------------


def _pair(alg: Algebra, x: SetExpr, y: SetExpr, positive: bool = False) -> SetExpr:
    def f(a: Val, b: Val) -> Val:
        u, w = V.as_num(a).cast("double"), V.as_num(b).cast("double")
        if positive:
            u = F.when(u > 0, F.ln(F.when(u > 0, u)))
        return V.obj({"x": V.num(u), "y": V.num(w)})

    return alg.combine([x, y], f)


def _bivariate(alg: Algebra, s: SetExpr, agg: Callable[[Column, Column], Column]) -> SetExpr:
    return alg.reduce(s, lambda c: agg(c["x"], c["y"]), lambda v: F.struct(v.fields["x"].col.alias("x"), v.fields["y"].col.alias("y")), V.num)


def corr(alg: Algebra, x: SetExpr, y: SetExpr) -> SetExpr:
    """Pearson's correlation; undefined where a side doesn't vary."""
    def agg(u: Column, w: Column) -> Column:
        return F.try_divide(F.covar_pop(u, w), F.sqrt(F.var_pop(u) * F.var_pop(w)))

    return _bivariate(alg, _pair(alg, x, y), agg)


def cov(alg: Algebra, x: SetExpr, y: SetExpr) -> SetExpr:
    """Population covariance."""
    return _bivariate(alg, _pair(alg, x, y), F.covar_pop)


def _line(alg: Algebra, s: SetExpr) -> SetExpr:
    slope = lambda u, w: F.try_divide(F.covar_pop(u, w), F.var_pop(u))
    a = _bivariate(alg, s, slope)
    b = _bivariate(alg, s, lambda u, w: F.avg(w) - slope(u, w) * F.avg(u))
    return alg.combine([a, b], lambda m, c: V.obj({"slope": m, "intercept": c}))


def lin_reg(alg: Algebra, x: SetExpr, y: SetExpr) -> SetExpr:
    """{slope, intercept} of y over x."""
    return _line(alg, _pair(alg, x, y))


def log_reg(alg: Algebra, x: SetExpr, y: SetExpr) -> SetExpr:
    """{slope, intercept} of y over ln x, for positive x."""
    return _line(alg, _pair(alg, x, y, positive=True))


# --- several variables -----------------------------------------------------------------------


def _features(alg: Algebra, y: SetExpr, features: SetExpr) -> tuple[SetExpr, list[tuple[str, ...]]]:
    paths: list[tuple[str, ...]] = []

    def f(a: Val, b: Val) -> Val:
        leaves = numeric_leaves(b)
        paths.extend(p for p, _ in leaves)
        return V.obj({"y": V.num(V.as_num(a).cast("double")), **{f"x{i}": V.num(c.cast("double")) for i, (_, c) in enumerate(leaves)}})

    return alg.combine([y, features], f), paths


def _moments(cols: list[Column]) -> list[Column]:
    """Sums of all products of the columns and 1: one row of aggregates, whatever the number of rows."""
    full = [*cols, F.lit(1.0)]
    n = len(full)
    return [F.sum(full[i] * full[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]


def _matrix(row, n: int, tag: str = "m") -> np.ndarray:
    at = lambda i, j: row[f"{tag}{min(i, j)}_{max(i, j)}"]
    return np.array([[0.0 if at(i, j) is None or np.isnan(at(i, j)) else at(i, j) for j in range(n)] for i in range(n)])


def _independent(m: np.ndarray) -> list[int]:
    """Columns of a design, last (the constant) first, that don't depend on those before."""
    keep: list[int] = []
    for i in [len(m) - 1, *range(len(m) - 1)]:
        rest = m[i, i]
        if keep:
            sub = m[np.ix_(keep, keep)]
            rest = m[i, i] - m[i, keep] @ np.linalg.solve(sub, m[keep, i])
        if rest > 1e-9 * max(m[i, i], 1e-300):
            keep.append(i)
    return keep


def _model(alg: Algebra, s: SetExpr, names: list[str], shape: Callable[[Callable[[str], Val]], Val], fit: Callable[[DataFrame, list[str], str], DataFrame]) -> SetExpr:
    """A set of one model, or of one for each key inside a solve.

    fit: from the rows (key columns and the value's members by name), the key columns
    and a prefix of names to one row a key with the key columns and the prefixed names.
    """
    tag = f"md{next(alg.count)}_"
    keys = alg.keys(s)

    def build() -> DataFrame:
        rows = alg.rows(s, ids=False).select(*keys, *[m.col.alias(k) for k, m in s.val.fields.items()])
        got = fit(rows, keys, tag)
        return got.select(*keys, *[F.when(~F.isnan(tag + n) & (F.abs(tag + n) != float("inf")), F.col(tag + n)).alias(tag + n) for n in names])

    return alg.from_frame(build, shape(lambda n: V.num(F.col(tag + n))), tuple(keys), single=not keys)


def _per_row(sums: DataFrame, keys: list[str], tag: str, names: list[str], solve: Callable[[dict], dict]) -> DataFrame:
    """solve, applied to each row of aggregates (one a key) where it lies."""
    kept = [f for f in sums.schema.fields if f.name in keys]
    schema = T.StructType([*kept, *[T.StructField(tag + n, T.DoubleType()) for n in names]])

    def run(frames):
        for pdf in frames:
            rows = [solve(r) for r in pdf.to_dict("records")]
            out = {tag + n: pd.Series([r.get(n) for r in rows], dtype="float64") for n in names}
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, **out})

    return sums.mapInPandas(run, schema)


def _loose(v: Val) -> Val:
    """An object that exists although members may be undefined (removed collinear features)."""
    v.inner = False
    return v


def linear_regression(alg: Algebra, y: SetExpr, features: SetExpr) -> SetExpr:
    """Least squares with standard errors, from one pass of moments (of each key, inside a solve)."""
    s, paths = _features(alg, y, features)
    d = len(paths)

    def solve(row: dict) -> dict:
        m = _matrix(row, d + 2)
        at = [*range(d), d + 1]  # features, constant
        xtx, xty, yy, n, sy = m[np.ix_(at, at)], m[at, d], m[d, d], m[d + 1, d + 1], m[d, d + 1]
        keep = sorted(_independent(xtx)) if n else []
        if not keep:
            return {}
        inv = np.linalg.inv(xtx[np.ix_(keep, keep)])
        beta = inv @ xty[keep]
        rss = max(0.0, yy - beta @ xty[keep])
        dof = n - len(keep)
        sigma2 = rss / dof if dof > 0 else np.nan
        tss = yy - sy * sy / n
        out = {"r2": 1 - rss / tss if tss > 0 else None, "rse": np.sqrt(sigma2), "dof": dof}
        for a, i in enumerate(keep):
            out[f"b{i}"], out[f"e{i}"] = beta[a], np.sqrt(sigma2 * inv[a, a])
            for b, j in enumerate(keep):
                out[f"v{i}_{j}"] = sigma2 * inv[a, b]
        return out

    def fit(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
        sums = rows.groupBy(*keys).agg(*_moments([*[F.col(f"x{i}") for i in range(d)], F.col("y")]))
        return _per_row(sums, keys, tag, names, solve)

    names = ["r2", "rse", "dof", *[f"{k}{i}" for i in range(d + 1) for k in "be"], *[f"v{i}_{j}" for i in range(d + 1) for j in range(d + 1)]]

    def shape(c: Callable[[str], Val]) -> Val:
        pair = lambda i: _loose(V.obj({"estimate": c(f"b{i}"), "standardError": c(f"e{i}")}))
        tree = rebuild({p: pair(i) for i, p in enumerate(paths)})
        return _loose(V.obj({"model1": _loose(V.obj({
            "coefficients": Val("arr", items=[_loose_tree(tree), pair(d)]),
            "RSquared": c("r2"),
            "varianceCovarianceMatrix": Val("arr", items=[Val("arr", items=[c(f"v{i}_{j}") for j in range(d + 1)]) for i in range(d + 1)]),
            "residualStandardError": _loose(V.obj({"estimate": c("rse"), "degreesOfFreedom": c("dof")})),
        }))}))

    return _model(alg, s, names, shape, fit)


def _loose_tree(v: Val) -> Val:
    for m in v.fields.values():
        _loose_tree(m)
    return _loose(v)


def logistic_regression(alg: Algebra, y: SetExpr, features: SetExpr) -> SetExpr:
    """Coefficients of P(y = 1) = 1 / (1 + exp(+z)): the usual ones with their signs turned (of each key, inside a solve).

    Newton's method on aggregated moments; every round is one aggregation over all
    rows, joined with the coefficients of the round before, one row a key.
    """
    s, paths = _features(alg, y, features)
    d = len(paths)
    names = [f"b{i}" for i in range(d + 1)]

    def step(row: dict) -> dict:
        beta = np.array([row[f"b{i}"] for i in range(d + 1)])
        g = np.array([row[f"g{i}"] or 0.0 for i in range(d + 1)])
        h = _matrix(row, d + 1, "h")
        move = np.linalg.solve(h + 1e-9 * (np.trace(h) / (d + 1) + 1e-12) * np.eye(d + 1), g)
        norm = np.abs(move).max()
        beta = beta + (move if norm < 5 else move * 5 / norm)
        return {**{f"b{i}": b for i, b in enumerate(beta)}, "more": float(not (norm < 1e-9 or np.abs(beta).max() > 1e4))}

    def fit(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
        rows = stage(rows.where("y in (0, 1)"), "labelled")
        x = [*[F.col(f"x{i}") for i in range(d)], F.lit(1.0)]
        z = sum((F.col(b) * c for b, c in zip(names, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        sums = [
            *[F.sum(c * (F.col("y") - p)).alias(f"g{i}") for i, c in enumerate(x)],
            *[F.sum(x[i] * x[j] * w).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)],
        ]
        beta = rows.select(*keys).distinct() if keys else alg.spark.range(1).select()
        beta = stage(beta.withColumns({**{b: F.lit(0.0) for b in names}, "more": F.lit(1.0)}), "beta")
        for _ in range(NEWTON_ROUNDS):
            at = skew_join(rows, beta.where("more = 1"), keys, "inner") if keys else rows.crossJoin(F.broadcast(beta))
            nxt = _per_row(at.groupBy(*keys, *names).agg(*sums), keys, "", [*names, "more"], step)
            nxt = stage(nxt.unionByName(beta.where("more = 0")) if keys else nxt, "beta")
            discard(beta)
            beta = nxt
            if beta.where("more = 1").isEmpty():
                break
        discard(rows)
        return beta.select(*keys, *[(-F.col(b)).alias(tag + b) for b in names])

    def shape(c: Callable[[str], Val]) -> Val:
        est = lambda i: V.obj({"estimate": c(f"b{i}")})
        tree = rebuild({p: est(i) for i, p in enumerate(paths)})
        return V.obj({"model1": V.obj({"coefficients": Val("arr", items=[tree, est(d)], inner=True)})})

    return _model(alg, s, names, shape, fit)


def _at(v: Val, path: tuple[str, ...]) -> Val:
    for p in path:
        v = V.index(v, V.constant(int(p[1:-1]))) if p.startswith("[") else V.deref(v, p)
    return v


def _coefficients(model: Val) -> tuple[list[tuple[tuple[str, ...], Column]], Column]:
    co = V.deref(model, "coefficients")
    leaves = [(p[:-1], c) for p, c in numeric_leaves(co.items[0]) if p[-1] == "estimate"]
    return leaves, V.deref(co.items[1], "estimate").col


@F.pandas_udf(T.DoubleType())
def _t_quantile(dof: pd.Series) -> pd.Series:
    """The 0.975 quantile of Student's t, by bisection of its integrated density."""
    import math

    cache: dict[float, float] = {}

    def q(n: float) -> float:
        if n not in cache:
            c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
            # integrate in t = tan(a), where the density is smooth on a bounded range
            grid = np.linspace(0, math.pi / 2, 200_001)[:-1]
            dens = c * (1 + np.tan(grid) ** 2 / n) ** (-(n + 1) / 2) / np.cos(grid) ** 2
            cdf = 0.5 + np.concatenate([[0], np.cumsum((dens[1:] + dens[:-1]) / 2)]) * (grid[1] - grid[0])
            cache[n] = math.tan(float(np.interp(0.975, cdf, grid)))
        return cache[n]

    return dof.map(lambda n: q(float(n)) if n is not None and n > 0 else None)


def predict_linear(alg: Algebra, features: SetExpr, model: SetExpr) -> SetExpr:
    """{modelN: {fit, confidenceInterval, predictionInterval}} for rows that have all of a model's features."""

    def one(x: Val, m: Val) -> Val:
        leaves, const = _coefficients(m)
        xs = [V.as_num(_at(x, p)).cast("double") for p, _ in leaves]
        fit = const
        for v, (_, b) in zip(xs, leaves):
            fit = fit + v * F.coalesce(b, F.lit(0.0))
        full = [*xs, F.lit(1.0)]
        cov_ = V.deref(m, "varianceCovarianceMatrix")
        var = F.lit(0.0)
        for i, a in enumerate(full):
            for j, b in enumerate(full):
                var = var + a * b * F.coalesce(cov_.items[i].items[j].col, F.lit(0.0))
        rse = V.deref(m, "residualStandardError")
        t = _t_quantile(V.deref(rse, "degreesOfFreedom").col)
        half = t * F.sqrt(F.greatest(var, F.lit(0.0)))
        wide = t * F.sqrt(F.greatest(var, F.lit(0.0)) + F.pow(V.deref(rse, "estimate").col, F.lit(2.0)))
        band = lambda h: Val("arr", items=[V.num(fit - h), V.num(fit + h)], inner=True)
        return V.obj({"fit": V.num(fit), "confidenceInterval": band(half), "predictionInterval": band(wide)})

    return alg.combine([features, model], lambda x, m: V.obj({k: one(x, mm) for k, mm in m.fields.items()}))


def predict_logistic(alg: Algebra, features: SetExpr, model: SetExpr) -> SetExpr:
    """{modelN: {fit}} with the same turned sign as logistic_regression."""

    def one(x: Val, m: Val) -> Val:
        leaves, z = _coefficients(m)
        for p, b in leaves:
            z = z + V.as_num(_at(x, p)).cast("double") * b
        return V.obj({"fit": V.num(1 / (1 + F.exp(z)))})

    return alg.combine([features, model], lambda x, m: V.obj({k: one(x, mm) for k, mm in m.fields.items()}))


# --- clusters ----------------------------------------------------------------------------------


def k_medians(alg: Algebra, features: SetExpr, k: int) -> SetExpr:
    """{model1: {cluster1..k: centre}}: centres are points of the set, by weighted farthest-first traversal over all rows (of each key, inside a solve).

    Repeats are counted first; then each centre is one pass over the different points
    that keeps only the farthest. Ties go to the least hash, so every run takes the same.
    """
    leaves = numeric_leaves(features.val)
    paths = [p for p, _ in leaves]
    d = len(paths)
    xs = [f"x{i}" for i in range(d)]
    s = SetExpr(features.atoms, Val("obj", fields={x: V.num(c.cast("double"), dirty=True) for x, (_, c) in zip(xs, leaves)}, inner=True), features.preds)

    def fit(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
        points = rows.groupBy(*keys, *xs).agg(F.count("*").alias("w"))
        points = stage(points.withColumn("h", F.xxhash64(*xs)), "points")
        point = F.struct(*xs)
        # ~h turns the order of the hashes round without overflow
        take = lambda far: F.max(F.struct(far.alias("far"), F.bitwise_not("h").alias("h"), point.alias("p"))).alias("m")
        state = stage(points.groupBy(*keys).agg(take(F.col("w").cast("double"))).select(*keys, F.array("m.p").alias("at")), "centres")
        for _ in range(k - 1):
            seen = skew_join(points, state, keys, "inner") if keys else points.crossJoin(F.broadcast(state))
            apart = lambda c: F.sqrt(sum(((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in xs), F.lit(0.0)))
            far = F.array_min(F.transform("at", apart)) * F.sqrt("w")
            best = seen.groupBy(*keys).agg(take(far)).select(*keys, F.when(F.col("m.far") > 0, F.array("m.p")).otherwise(F.array().cast(state.schema["at"].dataType)).alias("_new"))
            nxt = state.join(best, keys) if keys else state.crossJoin(F.broadcast(best))
            nxt = stage(nxt.select(*keys, F.concat("at", "_new").alias("at")), "centres")
            discard(state)
            state = nxt
        return state.select(*keys, *[F.get("at", F.lit(a))[x].alias(f"{tag}c{a}_{i}") for a in range(k) for i, x in enumerate(xs)])

    def shape(c: Callable[[str], Val]) -> Val:
        return _loose(V.obj({"model1": _loose(V.obj({f"cluster{a + 1}": rebuild({p: c(f"c{a}_{i}") for i, p in enumerate(paths)}) for a in range(k)}))}))

    return _model(alg, s, [f"c{a}_{i}" for a in range(k) for i in range(d)], shape, fit)


def assign_clusters(alg: Algebra, features: SetExpr, model: SetExpr) -> SetExpr:
    """{modelN: {clusterId, clusterCenter}}: the nearest centre of each model."""

    def one(x: Val, m: Val) -> Val:
        paths = [p for p, _ in numeric_leaves(next(iter(m.fields.values())))]
        choices = []
        for k, c in m.fields.items():
            dist, leaves = F.lit(0.0), numeric_leaves(c)
            for p, v in leaves:
                dist = dist + F.pow(V.as_num(_at(x, p), checked=False).cast("double") - v, F.lit(2.0))
            choices.append(F.when(V.is_finite(dist), F.struct(dist.alias("d"), F.lit(k).alias("k"), *[v.alias(f"c{i}") for i, (_, v) in enumerate(leaves)])))
        best = F.array_min(F.array(*choices))  # each distance is computed once
        return V.obj({"clusterId": V.text(best["k"]), "clusterCenter": rebuild({p: V.num(best[f"c{i}"]) for i, p in enumerate(paths)})})

    return alg.combine([features, model], lambda x, m: V.obj({k: one(x, mm) for k, mm in m.fields.items()}))


# --- forests -----------------------------------------------------------------------------------


def random_forest(alg: Algebra, training: SetExpr, data: SetExpr, classify: bool, seed: int = 11) -> SetExpr:
    """{model1: prediction} for each element of data; training has {predictors, dependent}.

    The forest is grown on FOREST_ROWS rows at most, those with the least hashes; all of data is scored.
    """
    if alg.keys(training):
        raise E.CompileError("a forest can't be grown for each key of a solve; grow it outside")
    tp, td = V.deref(training.val, "predictors"), V.deref(training.val, "dependent")
    paths = [p for p, _ in numeric_leaves(tp)]
    name = f"rf{next(alg.count)}"

    def f(val: Val, ids: list[str]):
        def make(df: DataFrame) -> DataFrame:
            from pyspark.ml.classification import RandomForestClassifier
            from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
            from pyspark.ml.regression import RandomForestRegressor

            xs = [c.cast("double").alias(f"x{i}") for i, (_, c) in enumerate(numeric_leaves(tp))]
            label = V.json_text(td) if classify else V.as_num(td).cast("double")
            ready = SetExpr(training.atoms, training.val, (*training.preds, V.defined(td)))
            rows = alg.rows(ready, ids=False).select(*xs, label.alias("label")).dropna()
            rows = rows.orderBy(F.xxhash64(*rows.columns)).limit(FOREST_ROWS)
            names = [f"x{i}" for i in range(len(paths))]
            asm = VectorAssembler(inputCols=names, outputCol="features")
            score = asm.transform(df.select(*ids, *[V.as_num(_at(val, p)).cast("double").alias(f"x{i}") for i, p in enumerate(paths)]).dropna(subset=names))
            if classify:
                idx = StringIndexer(inputCol="label", outputCol="y").fit(rows)
                m = RandomForestClassifier(labelCol="y", numTrees=FOREST_TREES, minInstancesPerNode=1, seed=seed).fit(asm.transform(idx.transform(rows)))
                got = IndexToString(inputCol="prediction", outputCol=name, labels=idx.labels).transform(m.transform(score))
                return got.select(*ids, name)
            m = RandomForestRegressor(labelCol="label", numTrees=FOREST_TREES, seed=seed).fit(asm.transform(rows))
            return m.transform(score).select(*ids, F.col("prediction").alias(name))

        if not classify:
            out = V.num(F.col(name))
        elif td.kind == "str":
            out = V.text(F.substring(F.col(name), F.lit(2), F.length(name) - 2))
        else:
            out = V.num(F.col(name).try_cast("double")) if td.kind == "num" else V.text(F.col(name))
        return make, V.obj({"model1": out})

    return alg.morph(data, f)


# --- normalisation -------------------------------------------------------------------------------


def _rescale(alg: Algebra, data: SetExpr, summary: SetExpr, f: Callable[[Column, Column, Column], Column]) -> SetExpr:
    def one(v: Val, s: Val) -> Val:
        if "mean" in s.fields and "stdDev" in s.fields:
            return V.num(f(V.as_num(v).cast("double"), s.fields["mean"].col, s.fields["stdDev"].col))
        if v.kind != "obj":
            return V.undefined()
        return V.obj({**{k: m for k, m in v.fields.items() if k not in s.fields}, **{k: one(V.deref(v, k), m) for k, m in s.fields.items()}})

    return alg.combine([data, summary], lambda v, s: one(v, s.fields.get("model1", s)))


def normalize(alg: Algebra, data: SetExpr, summary: SetExpr) -> SetExpr:
    """(x - mean) / stdDev for the members that the summary names; an element must have them all."""
    return _rescale(alg, data, summary, lambda x, m, s: F.try_divide(x - m, s))


def denormalize(alg: Algebra, data: SetExpr, summary: SetExpr) -> SetExpr:
    return _rescale(alg, data, summary, lambda x, m, s: x * s + m)
