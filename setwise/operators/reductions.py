"""Reductions: one value of a set (or, in a solve, of each group). All over the same rows share one aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import errors as E
from ..functions import values as V
from ..functions.library import finite
from ..functions.values import Val
from .sets import Algebra, SetExpr


@dataclass
class Reduction:
    name: str
    agg: Callable[[Column], Column]
    pick: Callable[[Val], Column]
    out: Callable[[Column], Val]
    empty: object = None


def _number(v: Val) -> Column:
    return V.as_num(v, checked=False)  # reduce() looks at defined rows only


def _exact(v: Val) -> Column:
    """Whole numbers as decimals, whose sum doesn't overflow."""
    return v.col.cast("decimal(20,0)") if v.kind == "num" and v.integral else V.as_num(v, checked=False)


def _geometric(c: Column) -> Column:
    x = c.cast("double")
    logs = F.avg(F.when(x != 0, F.ln(F.abs(x))))
    negatives = F.count(F.when(x < 0, 1))
    value = F.when(F.count(F.when(x == 0, 1)) > 0, F.lit(0.0)).when(negatives % 2 == 0, F.exp(logs))
    return finite(value)


REDUCTIONS: dict[str, Reduction] = {
    r.name: r
    for r in (
        Reduction("count", F.count, lambda v: F.lit(1), lambda c: V.num(c, True), 0),
        Reduction("sum", F.sum, _exact, V.num),
        Reduction("mean", lambda c: F.avg(c.cast("double")), _number, V.num),
        Reduction("min", F.min, _number, V.num),
        Reduction("max", F.max, _number, V.num),
        Reduction("geometricMean", _geometric, _number, V.num),
        Reduction("sumSq", lambda c: F.sum(c.cast("double") * c.cast("double")), _number, V.num),
        Reduction("variance", lambda c: F.var_pop(c.cast("double")), _number, V.num),
        Reduction("stdDev", lambda c: F.stddev_pop(c.cast("double")), _number, V.num),
        Reduction("median", lambda c: F.median(c.cast("double")), _number, V.num),
        Reduction("forall", F.bool_and, V.as_bool, V.boolean, True),
        Reduction("exists", F.bool_or, V.as_bool, V.boolean, False),
        Reduction("minTime", lambda c: F.min_by(c, c["ts"]), lambda v: _stamp(v), lambda c: V.date(c["ts"], c["zone"])),
        Reduction("maxTime", lambda c: F.max_by(c, c["ts"]), lambda v: _stamp(v), lambda c: V.date(c["ts"], c["zone"])),
    )
}


def _stamp(v: Val) -> Column:
    d = V.as_date(v)
    return F.when(d.col.isNotNull(), F.struct(d.col.alias("ts"), d.zone.alias("zone")))


def register_reduction(name: str, agg: Callable[[Column], Column], pick: Callable[[Val], Column] = _number, out: Callable[[Column], Val] = V.num, empty: object = None) -> None:
    """Extension point: agg may be any Spark aggregate, a grouped pandas function included."""
    REDUCTIONS[name] = Reduction(name, agg, pick, out, empty)


def reduce(alg: Algebra, name: str, s: SetExpr) -> SetExpr:
    r = REDUCTIONS[name]
    if name == "count" and s.distinct_of is not None:  # counted in the aggregation of the set that it is distinct of
        return alg.reduce(s.distinct_of, F.count_distinct, lambda v: v.col if v.kind in ("num", "str", "bool") else V.json_text(v), r.out, r.empty)
    v = s.val
    out = r.out
    if name in ("min", "max") and v.integral:
        out = lambda c: V.num(c, True)
    return alg.reduce(s, r.agg, r.pick, out, r.empty, carry=name if name in ("count", "sum", "min", "max") else None)


def single_summary(alg: Algebra, s: SetExpr) -> SetExpr:
    """{count, min, max, mean, stdDev} of a set of numbers."""
    nums = SetExpr(s.atoms, V.num(V.as_num(s.val)), s.preds)
    parts = [reduce(alg, n, nums) for n in ("count", "min", "max", "mean", "stdDev")]
    return alg.combine(parts, lambda c, lo, hi, m, sd: V.obj({"count": c, "min": lo, "max": hi, "mean": m, "stdDev": sd}))


def mode(alg: Algebra, s: SetExpr) -> SetExpr:
    """The most frequent values (of each key, inside a solve), all of them where several are equally frequent."""
    source = alg.fresh_source()
    cols, val = alg.rebind(s.val, f"md{next(alg.count)}")
    keys = alg.keys(s)

    def build():
        keyed = alg.rows(s, ids=False).select(V.json_text(s.val).alias(source), *keys, *cols)
        per = keyed.groupBy(*keys, source).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in keyed.columns if c not in (source, *keys)])
        most = per.groupBy(*keys).agg(F.max("_n").alias("_most"))
        best = per.join(most, keys) if keys else per.crossJoin(F.broadcast(most))
        return best.where("_n = _most").drop("_n", "_most")

    return alg.from_frame(build, val, (source, *keys))


def numeric_leaves(v: Val, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Column]]:
    """The numbers inside a value with the path to each."""
    if v.kind == "num":
        return [(path, v.col)]
    out = []
    for k, m in v.fields.items():
        out += numeric_leaves(m, (*path, k))
    for i, m in enumerate(v.items):
        out += numeric_leaves(m, (*path, f"[{i}]"))
    return out


def rebuild(leaves: dict[tuple[str, ...], Val]) -> Val:
    """An object from values at paths."""
    if list(leaves) == [()]:
        return leaves[()]
    groups: dict[str, dict] = {}
    for p, v in leaves.items():
        groups.setdefault(p[0], {})[p[1:]] = v
    return V.obj({k: rebuild(g) for k, g in groups.items()})


#: Shapes that a summary of mixed JSON may have at most.
MAX_SHAPES = 200


def shapes(alg: Algebra, s: SetExpr) -> list[SetExpr]:
    """A set of mixed JSON as one set of typed values for each shape of its elements, in the order of the shapes' names."""
    name = F.schema_of_variant(s.val.col)
    got = [r[0] for r in alg.rows(s, ids=False).select(name.alias("n")).distinct().limit(MAX_SHAPES + 1).collect()]
    if len(got) > MAX_SHAPES:
        raise E.SetwiseError(f"more than {MAX_SHAPES} shapes")
    out = []
    for n in sorted(got):
        if n in ("VOID", "VARIANT"):
            continue
        ddl = n.replace("OBJECT<", "STRUCT<").replace("VOID", "VARIANT")
        t = alg.spark.createDataFrame([], f"v {ddl}").schema["v"].dataType
        out.append(SetExpr(s.atoms, V.of_column(F.try_variant_get(s.val.col, "$", ddl), t), (*s.preds, name == n)))
    return out


def summary(alg: Algebra, s: SetExpr) -> SetExpr:
    """{model1: ...}: the summary at every numeric leaf, one model for each shape of the set's elements."""
    models = shapes(alg, s) if s.val.kind == "variant" else [s]
    parts, places = [], []
    for i, m in enumerate(m for m in models if numeric_leaves(m.val)):
        for p, c in numeric_leaves(m.val):
            parts.append(single_summary(alg, SetExpr(m.atoms, V.num(c, dirty=True), m.preds)))
            places.append((f"model{i + 1}", *p))
    if not parts:
        return alg.undefined()
    return alg.combine(parts, lambda *vs: rebuild(dict(zip(places, vs))))
