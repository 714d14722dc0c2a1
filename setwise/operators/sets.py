"""The dataset algebra: sets of identified values, lowered lazily to DataFrames.

A set is a value expression over one or more atoms. An atom is a DataFrame whose
columns named ``id...`` carry the identities of the sources it stems from. Operators
on sets of the same atoms just combine columns - no join; filters become a
predicate beside the value. Atoms are joined, on their common identities or crossed
under a relate, only where a set must be materialised: at a reduction, a set
operation, a table function or the output.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions import values as V
from ..functions.values import Val
from ..scale import prefix, stage

#: Rows that a cross may produce at most.
MAX_CROSS = 2_400_000_000


@dataclass
class Atom:
    no: int
    sources: tuple[str, ...]  # names of the identity columns
    build: Callable[[], DataFrame]  # identity and value columns
    single: bool = False  # one row, no identities
    frame: DataFrame | None = None
    plain: Callable[[], DataFrame] | None = None  # without identities, where they cost something

    def df(self, ids: bool = True) -> DataFrame:
        if not ids and self.plain is not None:
            return self.plain()
        if self.frame is None:
            self.frame = self.build()
        return self.frame


@dataclass
class SetExpr:
    """A set: atoms, a value over their columns, and the predicates that its rows satisfy. seed: an unobserved distribution."""

    atoms: frozenset[int]
    val: Val
    preds: tuple[Column, ...] = ()
    seed: int | None = None
    constant_only: bool = False
    theta: "Theta | None" = None
    distinct_of: "SetExpr | None" = None

    def with_val(self, val: Val) -> "SetExpr":
        return SetExpr(self.atoms, val, self.preds)


@dataclass
class Solve:
    """One grouping scope: its key variables, its groups and its atom of keys."""

    no: int
    variables: tuple[str, ...]
    groups: list["Group"] = field(default_factory=list)
    constraints: list[tuple[tuple[str, ...], Callable[[], DataFrame]]] = field(default_factory=list)
    keys_atom: int = -1
    kinds: dict[str, Val] = field(default_factory=dict)

    def source(self, var: str) -> str:
        return f"id_s{self.no}_{var}"


@dataclass
class Theta:
    """How a set was filtered by one inequality between an expression of its own and the only variable of a solve."""

    base: SetExpr
    expr: Val
    op: str
    solve: Solve


@dataclass
class Group:
    atom: int
    variables: tuple[str, ...]
    on: tuple[str, ...] = ()  # its variables' columns and those of the solves around
    aggs: list[tuple[str, Column]] = field(default_factory=list)
    agg_atom: int = -1


def is_key(source: str) -> bool:
    """Is an identity column the key of a solve?"""
    return source.startswith("id_s")


def has_date(v: Val) -> bool:
    return v.kind == "date" or any(has_date(m) for m in [*v.fields.values(), *v.items])


@dataclass
class Table:
    """A named dataset: its DataFrame and, if it has one, its key."""

    df: DataFrame
    key: tuple[str, ...] = ()


class Algebra:
    """Operators on sets. tables: path -> Table; resolve: path -> Table for paths that aren't listed."""

    def __init__(self, spark: SparkSession, tables: dict[str, Table] | None = None, resolve: Callable[[str], Table] | None = None):
        self.spark = spark
        self.tables, self.resolve = dict(tables or {}), resolve
        self.atoms: dict[int, Atom] = {}
        self.count = itertools.count(1)
        self.loaded: dict[str, SetExpr] = {}
        self.relations: list[frozenset[str]] = []
        self.permitted: list[frozenset[str]] = []
        self.all_solves: list[Solve] = []
        self.solves: list[Solve] = []
        self.global_aggs: dict[tuple, tuple[int, list]] = {}
        self.notes: list[str] = []

    # --- atoms -------------------------------------------------------------------------------

    def atom(self, sources: tuple[str, ...], build: Callable[[], DataFrame], single: bool = False, plain=None) -> Atom:
        a = Atom(next(self.count), sources, build, single, plain=plain)
        self.atoms[a.no] = a
        return a

    def fresh_source(self) -> str:
        return f"id{next(self.count)}"

    def sources(self, s: SetExpr) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x for a in sorted(s.atoms) for x in self.atoms[a].sources))

    def keys(self, s: SetExpr) -> list[str]:
        """The keys of the solves that a set depends on: whatever is made of the set is made for each of them."""
        return [x for x in self.sources(s) if is_key(x)]

    def for_keys(self, s: SetExpr, keys: list[str]) -> SetExpr:
        """s, once for each value of the keys that it doesn't depend on."""
        missing = set(keys) - set(self.keys(s))
        atoms = {x.keys_atom for x in self.all_solves if missing & {x.source(v) for v in x.variables}}
        return SetExpr(s.atoms | atoms, s.val, s.preds) if atoms else s

    def frame(self, atoms: frozenset[int], ids: bool = True, crossed: list | None = None) -> DataFrame:
        """The join of the atoms: on common identities, else crossed where a relate or a solve permits it. crossed takes the sides of such crosses."""
        todo = [self.atoms[a] for a in sorted(atoms)]
        todo = [a for a in todo if not self._redundant(a, atoms)]
        if not todo:
            return self.spark.range(1).select()
        if len(todo) == 1:
            return todo[0].df(ids)
        todo.sort(key=lambda a: (a.single, a.no))
        have, out = list(todo[0].sources), todo[0].df()
        rest = todo[1:]
        while rest:
            nxt = next((a for a in rest if not a.single and set(a.sources) & set(have)), None)
            if nxt is not None:
                on = [x for x in nxt.sources if x in have]
                out = out.join(nxt.df(), on, "inner")
            else:
                nxt = next((a for a in rest if not a.single), rest[0])
                if nxt.single:
                    out = out.crossJoin(F.broadcast(nxt.df()))
                else:
                    if not self._related(have, nxt.sources):
                        raise E.OperationOnUnrelatedSets(f"{have} and {list(nxt.sources)}")
                    if crossed is not None:
                        crossed.append((out, nxt.df()))
                    out = out.crossJoin(nxt.df())
            have += [x for x in nxt.sources if x not in have]
            rest.remove(nxt)
        return out

    def _redundant(self, a: Atom, atoms: frozenset[int]) -> bool:
        """A solve's atom of keys adds nothing beside an aggregate over its only group."""
        return any(a.no == s.keys_atom and len(s.groups) == 1 and not s.constraints and s.groups[0].agg_atom in atoms for s in self.all_solves)

    def _related(self, a, b, now: bool = False) -> bool:
        if any(map(is_key, (*a, *b))):
            return True
        if now:
            return any({x, y} <= r for r in self.relations for x in a for y in b)
        return any({x, y} <= r for r in (*self.relations, *self.permitted) for x in a for y in b)

    def check(self, sets: list[SetExpr]) -> None:
        """Raise where sets without common identities are combined; what one of the sets joins already may stay joined."""
        groups: list[set[str]] = []
        for s in sets:
            own = {x for x in self.sources(s) if not is_key(x)}  # a key is one value beside the sets of its solve
            if not own:
                continue
            for g in [g for g in groups if g & own or self._related(g, own, now=True)]:
                own |= g
                groups.remove(g)
            groups.append(own)
        if len(groups) > 1:
            raise E.OperationOnUnrelatedSets(" and ".join(str(sorted(g)) for g in groups))

    def combine(self, sets: list[SetExpr], f: Callable[..., Val]) -> SetExpr:
        for s in sets:
            if s.seed is not None:
                raise E.CannotUseDistributionWithoutSampling("use observe")
        atoms = frozenset().union(*[s.atoms for s in sets])
        self.check(sets)
        preds: dict[int, Column] = {}
        for s in sets:
            for p in s.preds:
                preds[id(p)] = p
        return SetExpr(atoms, f(*[s.val for s in sets]), tuple(preds.values()))

    def rows(self, s: SetExpr, ids: bool = True) -> DataFrame:
        """The rows of a set: its frame, filtered to where the value is defined."""
        crossed: list = []
        df = self.frame(s.atoms, ids, crossed)
        cond = V.defined(s.val)
        for p in s.preds:
            cond = cond & p
        out = df.where(cond)
        if crossed and self._stays_cross(out):
            for a, b in crossed:
                self.cross_guard(a, b)
        return out

    @staticmethod
    def _stays_cross(df: DataFrame) -> bool:
        """Does a cross remain in the plan that no equality turned into a join? (Crosses with single rows are broadcast.)"""
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.search(r"Join (Cross|Inner)", x)]
        return any("strategy=broadcast" not in x and " = " not in x for x in joins)

    def rebind(self, val: Val, tag: str) -> tuple[list[Column], Val]:
        """Columns that store a value, and the value that reads them back."""
        cols: list[Column] = []

        def walk(v: Val) -> Val:
            if v.kind in ("obj", "arr") and v.col is None:
                return Val(v.kind, fields={k: walk(m) for k, m in v.fields.items()}, items=[walk(m) for m in v.items], inner=v.inner, dtype=v.dtype, row=v.row)
            name = f"{tag}_{len(cols)}"
            if v.kind == "obj":
                cols.append(v.col.alias(name))
                return V.of_column(F.col(name), v.dtype) if v.dtype else Val("obj", F.col(name), fields={k: walk(m) for k, m in v.fields.items()})
            cols.append(v.col.alias(name))
            zone = None
            if v.kind == "date":
                zone = F.col(name + "z")
                cols.append(v.zone.alias(name + "z"))
            return Val(v.kind, F.col(name), zone=zone, dtype=v.dtype, integral=v.integral, dirty=v.dirty)

        return cols, walk(val)

    # --- loading -----------------------------------------------------------------------------

    def load(self, path: str) -> SetExpr:
        """The rows of a dataset. Two loads of one path align row by row."""
        if path in self.loaded:
            return self.loaded[path]
        t = self.tables.get(path) or (self.resolve(path) if self.resolve else None)
        if t is None:
            raise E.CompileError(f"no such dataset: {path}")
        self.loaded[path] = s = self._from_table(t)
        return s

    def _from_table(self, t: Table) -> SetExpr:
        n = next(self.count)
        names = {c: f"t{n}_{i}" for i, c in enumerate(t.df.columns)}
        source = self.fresh_source()
        plain = lambda: t.df.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
        if t.key:
            sources = tuple(f"{source}_{i}" for i in range(len(t.key)))
            a = self.atom(sources, lambda: plain().withColumns({x: F.col(names[k]) for x, k in zip(sources, t.key)}))
        else:  # no key: rows are numbered when something needs it, and kept, since numbers must not change
            a = self.atom((source,), lambda: stage(plain().withColumn(source, F.monotonically_increasing_id()), "rows"), plain=plain)
        if t.df.columns == ["value"]:
            return SetExpr(frozenset([a.no]), V.of_column(F.col(names["value"]), t.df.schema["value"].dataType))
        fields = {c: V.of_column(F.col(names[c]), t.df.schema[c].dataType) for c in t.df.columns}
        return SetExpr(frozenset([a.no]), Val("obj", fields=fields, row=True))

    def constant(self, x) -> SetExpr:
        return SetExpr(frozenset(), V.undefined() if x is E else V.constant(x))

    def undefined(self) -> SetExpr:
        return SetExpr(frozenset(), V.undefined())

    # --- row-level ----------------------------------------------------------------------------

    def where(self, s: SetExpr, p: SetExpr) -> SetExpr:
        both = self.combine([s, p], lambda v, _: v)
        return SetExpr(both.atoms, s.val, (*both.preds, V.as_bool(p.val) if p.val.sieve is None else p.val.sieve))

    @staticmethod
    def member(base: SetExpr, out: SetExpr) -> SetExpr:
        """out, taken from base, exists only where all of base does."""
        ok = V.whole(base.val)
        return out if ok is None or any(p is ok for p in out.preds) else SetExpr(out.atoms, out.val, (*out.preds, ok))

    def cond(self, p: SetExpr, a: SetExpr, b: SetExpr) -> SetExpr:
        """if p then a else b, as one expression where the three share their atoms, else as a union of two filtered sets."""
        if a.atoms <= p.atoms and b.atoms <= p.atoms and not a.preds and not b.preds:
            def f(pv: Val, av: Val, bv: Val) -> Val:
                kind, (x, y) = V.same_kind([av, bv])
                if kind == "obj":
                    return Val("obj", fields={k: f(pv, x.fields[k], y.fields[k]) for k in x.fields}, inner=True)
                zone = F.when(V.as_bool(pv), x.zone).otherwise(y.zone) if kind == "date" else None
                return Val(kind, F.when(V.as_bool(pv), x.col).when(~V.as_bool(pv), y.col), zone=zone, integral=x.integral and y.integral, dirty=x.dirty or y.dirty)

            return self.combine([p, a, b], f)
        no = SetExpr(p.atoms, V.boolean(~V.as_bool(p.val)), p.preds)
        return self.union(self.where(a, p), self.where(b, no), error=E.CondProvenanceDifferentLength)

    # --- identities ----------------------------------------------------------------------------

    def new(self, s: SetExpr) -> SetExpr:
        """The same values under fresh identities, those of each key by themselves."""
        source = self.fresh_source()
        cols, val = self.rebind(s.val, f"n{next(self.count)}")
        old, keys = self.sources(s), self.keys(s)

        def build() -> DataFrame:
            df = self.rows(s)
            if old:
                return df.select(F.concat_ws("\x1f", *[F.col(x).cast("string") for x in old]).alias(source), *keys, *cols)
            return df.select(F.lit("0").alias(source), *cols)

        return SetExpr(frozenset([self.atom((source, *keys), build).no]), val)

    def distinct(self, s: SetExpr) -> SetExpr:
        """The different values (of each key, inside a solve), under identities of their own.

        Plain columns are compared as they are; only values that hold JSON or arrays are compared as text.
        """
        source = self.fresh_source()
        cols, val = self.rebind(s.val, f"d{next(self.count)}")
        keys = self.keys(s)

        def build() -> DataFrame:
            rows = self.rows(s, ids=False)
            plain = rows.select(*keys, *cols)
            values = [c for c in plain.columns if c not in keys]
            if values and not has_date(s.val) and all(isinstance(plain.schema[c].dataType, T.AtomicType) and not isinstance(plain.schema[c].dataType, T.VariantType) for c in values):
                return plain.distinct().withColumn(source, F.to_json(F.struct(*values)))
            return rows.select(V.json_text(s.val).alias(source), *keys, *cols).dropDuplicates([*keys, source])

        out = SetExpr(frozenset([self.atom((source, *keys), build).no]), val)
        out.distinct_of = s
        return out

    @contextmanager
    def relate(self, *sets: SetExpr):
        """Within it, the sets may be combined although they have no common identity."""
        pairs = []
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                sa, sb = ([x for x in self.sources(y) if not is_key(x)] for y in (a, b))
                if set(sa) & set(sb) and j == i - 1:
                    raise E.AlreadyRelatedSets(f"{sa} and {sb}")
                pairs += [frozenset((x, y)) for x in sa for y in sb if x != y]
        before = list(self.relations)
        self.relations += pairs
        try:
            yield
        finally:
            # Atoms are joined lazily, so what was permitted once stays known to the joins.
            self.permitted += pairs
            self.relations = before

    # --- set operations -------------------------------------------------------------------------

    def _sides(self, a: SetExpr, b: SetExpr, error: type[E.CompileError]):
        sa, sb = self.sources(a), self.sources(b)
        na, nb = (sum(not is_key(x) for x in y) for y in (sa, sb))
        if na != nb:
            raise error(f"{na} and {nb} identities")
        return sa, sb

    def _same_keys(self, a: SetExpr, b: SetExpr) -> tuple[SetExpr, SetExpr]:
        """Both sets for the same keys of solves."""
        keys = list(dict.fromkeys([*self.keys(a), *self.keys(b)]))
        return self.for_keys(a, keys), self.for_keys(b, keys)

    def union(self, a: SetExpr, b: SetExpr, error: type[E.CompileError] = E.UnionProvenanceDifferentLength) -> SetExpr:
        """Both sets' elements, as (identity, value) pairs."""
        if a.val.kind == "undef" and not a.atoms:
            return b
        if b.val.kind == "undef" and not b.atoms:
            return a
        a, b = self._same_keys(a, b)
        sa, sb = self._sides(a, b, error)
        kind, (va, vb) = V.same_kind([a.val, b.val])
        if kind == "obj":
            names = list(va.fields)
            vb = Val("obj", fields={k: vb.fields[k] for k in names}, inner=vb.inner, col=None)
            va = Val("obj", fields={k: va.fields[k] for k in names}, inner=va.inner, col=None)
            pairs = [V.same_kind([va.fields[k], vb.fields[k]]) for k in names]
            if any(k not in ("num", "str", "bool", "date", "undef", "variant") for k, _ in pairs):
                kind, va, vb = "variant", Val("variant", V.variant(a.val)), Val("variant", V.variant(b.val))
            else:
                va = Val("obj", fields={k: p[1][0] for k, p in zip(names, pairs)}, inner=va.inner)
                vb = Val("obj", fields={k: p[1][1] for k, p in zip(names, pairs)}, inner=vb.inner)
        tag = f"u{next(self.count)}"
        ca, out = self.rebind(va, tag)
        cb, _ = self.rebind(vb, tag)
        same = set(sa) == set(sb)
        union_source = self.fresh_source()
        sources = sa if same else tuple(dict.fromkeys((union_source, *sa, *sb)))

        def build() -> DataFrame:
            ra, rb = self.rows(a), self.rows(b)
            if same:
                x = ra.select(*sa, V.json_text(a.val).alias("_v"), *ca)
                y = rb.select(*sb, V.json_text(b.val).alias("_v"), *cb)
            else:
                txt = lambda s, t: F.concat_ws("\x1f", F.lit(t), *[F.col(x).cast("string") for x in s]).alias(union_source)
                x = ra.select(txt(sa, "l"), *sa, V.json_text(a.val).alias("_v"), *ca)
                y = rb.select(txt(sb, "r"), *sb, V.json_text(b.val).alias("_v"), *cb)
            both = x.unionByName(y, allowMissingColumns=True)
            if same:
                both = both.dropDuplicates([*sa, "_v"])
            return both.drop("_v")

        single = not sa
        atom = self.atom(sources, build, single=False)
        atom.single = single
        return SetExpr(frozenset([atom.no]), out, constant_only=single)

    def _semi(self, a: SetExpr, b: SetExpr, how: str, error, empty) -> SetExpr:
        a, b = self._same_keys(a, b)
        sa, sb = self._sides(a, b, error)
        if set(sa) != set(sb):
            if not any(x in sb for x in sa):
                raise empty(f"{sa} and {sb}")
        cols, val = self.rebind(a.val, f"i{next(self.count)}")
        on = [*[x for x in sa if x in sb], "_v"]

        def build() -> DataFrame:
            x = self.rows(a).select(*sa, V.json_text(a.val).alias("_v"), *cols)
            y = self.rows(b).select(*[c for c in on if c != "_v"], V.json_text(b.val).alias("_v"))
            out = x.join(y, on, how).select(*sa, *[x[n] for n in x.columns if n not in (*sa, "_v")])
            return out if sa else out.distinct()

        atom = self.atom(sa, build, single=not sa)
        return SetExpr(frozenset([atom.no]), val)

    def intersect(self, a: SetExpr, b: SetExpr) -> SetExpr:
        """The elements of both sets, identity and value alike."""
        return self._semi(a, b, "left_semi", E.IntersectProvenanceDifferentLength, E.IntersectWithNoCommonalities)

    def difference(self, a: SetExpr, b: SetExpr) -> SetExpr:
        """The elements of a that aren't in b."""
        return self._semi(a, b, "left_anti", E.DifferenceProvenanceDifferentLength, E.DifferenceWithNoCommonalities)

    # --- reductions ------------------------------------------------------------------------------

    def reduce(self, s: SetExpr, agg: Callable[[Column], Column], pick: Callable[[Val], Column], out: Callable[[Column], Val], empty: object = None, carry: str | None = None) -> SetExpr:
        """One value of the whole set, or, inside a solve whose variables the set depends on, one for each key.

        agg: from the picked column (null where the row doesn't count) to an aggregate;
        empty: what an empty set gives (None: nothing); carry: count, sum, min or max, if
        it is one of these. All reductions over the same rows share one aggregation.
        """
        cond = V.defined(s.val)
        for p in s.preds:
            cond = cond & p
        picked = F.when(cond, pick(s.val))
        name = f"r{next(self.count)}"
        keys = self.keys(s)
        if not keys:
            no, aggs = self._global(s.atoms)
            aggs.append((name, agg(picked)))
            c = F.col(name)
            return SetExpr(frozenset([no]), out(F.coalesce(c, F.lit(empty)) if empty is not None else c))
        solve = next(x for x in reversed(self.all_solves) if any(x.source(v) in keys for v in x.variables))
        own = next((g for g in solve.groups if s.atoms <= {g.atom, solve.keys_atom} and g.atom in s.atoms), None)
        if own is not None and (solve.keys_atom not in s.atoms or set(own.variables) == set(solve.variables)):
            own.aggs.append((name, agg(picked)))
            c = F.col(name)
            return SetExpr(frozenset([own.agg_atom, solve.keys_atom]), out(F.coalesce(c, F.lit(empty)) if empty is not None else c))
        on = list(self.atoms[solve.keys_atom].sources)
        t = s.theta
        ordered = t is not None and carry and t.expr.kind in ("num", "date") and solve.kinds[solve.variables[0]].kind == t.expr.kind

        def build() -> DataFrame:
            if ordered:
                return self._carried(t, carry, pick(t.base.val), name)
            key_df = self.atoms[solve.keys_atom].df()
            df = self.frame(s.atoms if set(on) <= set(keys) else s.atoms | {solve.keys_atom})
            per = df.where(cond).groupBy(*on).agg(agg(picked).alias(name))
            return key_df.select(*on).join(per, on, "left")

        atom = self.atom(tuple(on), build)
        c = F.col(name)
        return SetExpr(frozenset([atom.no, solve.keys_atom]), out(F.coalesce(c, F.lit(empty)) if empty is not None else c))

    def _global(self, atoms: frozenset[int]) -> tuple[int, list]:
        if atoms not in self.global_aggs:
            aggs: list[tuple[str, Column]] = []
            a = self.atom((), lambda: None, single=True)
            a.build = lambda: self.frame(atoms, ids=False).agg(*[c.alias(n) for n, c in aggs]) if atoms else self.spark.range(1).agg(*[c.alias(n) for n, c in aggs])
            self.global_aggs[atoms] = (a.no, aggs)
        no, aggs = self.global_aggs[atoms]
        if self.atoms[no].frame is not None:  # built already: a later reduction gets its own
            del self.global_aggs[atoms]
            return self._global(atoms)
        return no, aggs

    def where_theta(self, s: SetExpr, expr: SetExpr, op: str, solve: Solve, compare: Callable[[Val, Val], Val]) -> SetExpr:
        """s where expr op key, for the only variable of a solve.

        As a set it is the cross that it says; but a reduction of it that can be carried
        along an order (count, sum, min, max) never makes that cross, see _carried.
        """
        base = self.combine([s, expr], lambda v, _: v)
        key = self.key(solve, solve.variables[0])
        out = self.where(s, self.combine([expr, key], compare))
        out.theta = Theta(base, expr.val, op, solve)
        return out

    def _carried(self, t: Theta, fn: str, pick: Column, name: str) -> DataFrame:
        """(key, aggregate) for every key: values and keys in one order, the aggregate of all values before each key (scale.prefix)."""
        up = t.op in ("lt", "lte")
        order = lambda v: F.unix_micros(v.col) if v.kind == "date" else V.as_num(v)
        sign = lambda c: c if up else -c
        cond = V.defined(t.base.val)
        for p in t.base.preds:
            cond = cond & p
        own = order(t.expr)
        part = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[fn]
        rows = self.frame(t.base.atoms, ids=False).where(cond & own.isNotNull())
        rows = rows.select(sign(own).alias("_o"), pick.alias("_p")).groupBy("_o").agg(part("_p").alias("_a"))
        at = t.solve.source(t.solve.variables[0])
        like = t.solve.kinds[t.solve.variables[0]]
        key = F.unix_micros(F.col(at)) if like.kind == "date" else F.col(at)
        tag = 0 if t.op in ("lt", "gt") else 2  # with a strict inequality, a key stands before the values equal to it
        keys = self.atoms[t.solve.keys_atom].df().select(at, sign(key).alias("_o"), F.lit(tag).alias("_t"))
        both = keys.unionByName(rows.withColumn("_t", F.lit(1)), allowMissingColumns=True)
        run = prefix(both, [F.col("_o"), F.col("_t")], {name: ("sum" if fn in ("count", "sum") else fn, F.col("_a")), "_any": ("count", F.col("_a"))})
        return run.where("_t <> 1").select(at, F.when(F.col("_any") > 0, F.col(name)).alias(name))

    # --- solve -----------------------------------------------------------------------------------

    @contextmanager
    def solve(self, *variables: str):
        """A grouping scope: key() gives its variables, group() its groups; end it with solved()."""
        if not variables:
            raise E.SolveLackingFreeVariables("solve without variables")
        if len(set(variables)) < len(variables):
            raise E.MultiplyDefinedTicVariable(str(variables))
        s = Solve(next(self.count), variables)
        atom = self.atom(tuple(s.source(v) for v in variables), lambda: self._key_frame(s))
        s.keys_atom = atom.no
        self.all_solves.append(s)
        self.solves.append(s)
        try:
            yield s
        finally:
            self.solves.pop()

    def key(self, s: Solve, var: str) -> SetExpr:
        """A key variable as a set: one element for each key. Its kind is that of the expression that determines it."""
        col = F.col(s.source(var))
        like = s.kinds.get(var)
        if like is None:
            raise E.UnableToSolveTicVariable(var)
        val = V.date(col) if like.kind == "date" else Val("variant", F.parse_json(col)) if like.kind in ("variant", "obj", "arr", "array") else Val(like.kind, col, integral=like.integral)
        return SetExpr(frozenset([s.keys_atom]), val)

    @staticmethod
    def _key_column(v: Val) -> Column:
        return V.json_text(v) if v.kind in ("variant", "obj", "arr", "array") else v.col

    def group(self, s: Solve, target: SetExpr, keys: dict[str, SetExpr], extra: list[SetExpr] | None = None) -> SetExpr:
        """The elements of target grouped by the key expressions; rows that fail an extra condition take no part, not even as keys."""
        names = list(keys)
        both = self.combine([target, *keys.values(), *(extra or [])], lambda v, *_: v)
        preds = (*both.preds, *[V.as_bool(e.val) for e in extra or []])
        for k in names:
            s.kinds.setdefault(k, keys[k].val)
        cols, val = self.rebind(target.val, f"g{next(self.count)}")
        ids = self.sources(SetExpr(both.atoms, target.val))
        key_cols = {s.source(k): self._key_column(keys[k].val) for k in names}
        outer = [x for x in ids if x not in key_cols]
        around = [x for x in outer if is_key(x)]
        ready = SetExpr(both.atoms, target.val, (*preds, *[V.defined(keys[k].val) for k in names]))
        plain_ok = all(self.atoms[a].plain is not None for a in both.atoms)
        build = lambda: self.rows(ready).select(*outer, *[c.alias(n) for n, c in key_cols.items()], *cols)
        plain = (lambda: self.rows(ready, ids=False).select(*around, *[c.alias(n) for n, c in key_cols.items()], *cols)) if plain_ok else None
        atom = self.atom((*outer, *key_cols), build, plain=plain)
        g = self._new_group(s, atom, names, around)
        on = g.on

        def agg() -> DataFrame:
            df = self.atoms[g.atom].df(ids=False) if plain else self.atoms[g.atom].df()
            return df.groupBy(*on).agg(*[c.alias(n) for n, c in g.aggs]) if g.aggs else df.select(*on).distinct()

        g.agg_atom = self.atom(on, agg).no
        s.groups.append(g)
        return SetExpr(frozenset([atom.no]), val)

    def group_any(self, s: Solve, target: SetExpr, choices: list[tuple[dict[str, SetExpr], list[SetExpr]]]) -> SetExpr:
        """group where any of several ways may give the keys; a row takes part once under each different key."""
        names = list(choices[0][0])
        every = [x for keys, extra in choices for x in (*keys.values(), *extra)]
        both = self.combine([target, *every], lambda v, *_: v)
        for k in names:
            s.kinds.setdefault(k, choices[0][0][k].val)
        cols, val = self.rebind(target.val, f"g{next(self.count)}")
        outer = [x for x in self.sources(both) if not x.startswith(f"id_s{s.no}_")]
        ways = []
        for keys, extra in choices:
            ok = F.lit(True)
            for k in names:
                ok = ok & V.defined(keys[k].val)
            for e in extra:
                ok = ok & V.as_bool(e.val)
            ways.append(F.when(ok, F.struct(*[self._key_column(keys[k].val).alias(s.source(k)) for k in names])))
        tag = f"w{next(self.count)}"

        def build() -> DataFrame:
            rows = self.rows(both.with_val(target.val)).select(*outer, *cols, F.explode(F.array_distinct(F.array_compact(F.array(*ways)))).alias(tag))
            return rows.select("*", f"{tag}.*").drop(tag)

        around = [x for x in outer if is_key(x)]
        atom = self.atom((*outer, *[s.source(k) for k in names]), build)
        g = self._new_group(s, atom, names, around)
        on = g.on

        def agg() -> DataFrame:
            df = self.atoms[g.atom].df()
            return df.groupBy(*on).agg(*[c.alias(n) for n, c in g.aggs]) if g.aggs else df.select(*on).distinct()

        g.agg_atom = self.atom(on, agg).no
        s.groups.append(g)
        return SetExpr(frozenset([atom.no]), val)

    def _new_group(self, s: Solve, atom: Atom, names: list[str], around: list[str]) -> Group:
        """A group by its own variables and the keys of the solves around, on which the solve's keys then depend too."""
        keys = self.atoms[s.keys_atom]
        keys.sources = (*keys.sources, *[x for x in around if x not in keys.sources])
        return Group(atom.no, tuple(names), (*around, *[s.source(k) for k in names]))

    def constrain(self, s: Solve, keys: dict[str, SetExpr], extra: list[SetExpr] | None = None) -> None:
        """Restrict the keys to the values of other sets."""
        both = self.combine([*keys.values(), *(extra or [])], lambda v, *_: v)
        preds = (*both.preds, *[V.as_bool(e.val) for e in extra or []], *[V.defined(k.val) for k in keys.values()])
        for k, v in keys.items():
            s.kinds.setdefault(k, v.val)
        cols = [self._key_column(v.val).alias(s.source(k)) for k, v in keys.items()]
        ready = SetExpr(both.atoms, next(iter(keys.values())).val, preds)
        s.constraints.append((tuple(keys), lambda: self.rows(ready, ids=False).select(*cols).distinct()))

    def _key_frame(self, s: Solve) -> DataFrame:
        """The keys: those of every group and constraint at once."""
        parts = [(g.on, self.atoms[g.agg_atom].df()) for g in s.groups] + [(tuple(s.source(x) for x in v), f()) for v, f in s.constraints]
        bound = {x for on, _ in parts for x in on}
        for v in s.variables:
            if s.source(v) not in bound:
                raise E.UnableToSolveTicVariable(v)
        out, have = None, set()
        for on, df in parts:
            df = df.select(*on)
            shared = [x for x in on if x in have]
            if out is not None and not shared:
                self.cross_guard(out, df)
            out = df if out is None else out.join(df, shared, "inner") if shared else out.crossJoin(df)
            have |= set(on)
        return out

    def solved(self, s: Solve, body: SetExpr) -> SetExpr:
        """The result of a solve: one element for each key and row of the body, under fresh identities."""
        if not s.groups and not s.constraints:
            raise E.UnableToSolveTicVariable(", ".join(s.variables))
        atoms = body.atoms | {s.keys_atom}
        source = self.fresh_source()
        cols, val = self.rebind(body.val, f"v{next(self.count)}")
        ready = SetExpr(atoms, body.val, body.preds)
        ids = self.sources(ready)
        around = [x for x in ids if is_key(x) and not x.startswith(f"id_s{s.no}_")]

        def build() -> DataFrame:
            df = self.rows(ready)
            return df.select(F.concat_ws("\x1f", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ids]).alias(source), *around, *cols)

        plain = None
        if len(s.groups) == 1 and not s.constraints:
            plain = lambda: self.rows(ready).select(*around, *cols)
        return SetExpr(frozenset([self.atom((source, *around), build, plain=plain).no]), val)

    # --- table functions ---------------------------------------------------------------------------

    def morph(self, s: SetExpr, f: Callable[[DataFrame, dict[str, str], list[str]], tuple[DataFrame, Callable[[], Val]]], extra_sources: tuple[str, ...] = ()) -> SetExpr:
        """A function of a whole set, or of the set of each key, that keeps its identities.

        f gets the rows with their value in columns, the identity columns, and gives rows
        with the identity columns (and extra_sources) and a maker of the new value.
        """
        ids = self.sources(s)
        cols, val = self.rebind(s.val, f"m{next(self.count)}")
        holder: dict = {}

        def build() -> DataFrame:
            return holder["f"](self.rows(s).select(*ids, *cols))

        atom = self.atom((*ids, *extra_sources), build, single=not ids and not extra_sources)
        holder["f"], new_val = f(val, list(ids))
        return SetExpr(frozenset([atom.no]), new_val)

    def from_frame(self, build: Callable[[], DataFrame], val: Val, sources: tuple[str, ...] = (), single: bool = False) -> SetExpr:
        return SetExpr(frozenset([self.atom(sources, build, single).no]), val)

    def flatten(self, s: SetExpr) -> SetExpr:
        """The elements of arrays, each identified by its source row and position; other values give nothing."""
        pos = self.fresh_source()
        tag = f"f{next(self.count)}"
        ids = self.sources(s)
        v = s.val
        if v.kind == "arr":
            v = Val("array", V.column(v), dtype=T.ArrayType(V._element(v)))
        if v.kind == "variant":
            arr = F.when(V.shape(v) == "ARRAY", F.try_variant_get(v.col, "$", "array<variant>"))
            v = Val("array", arr, dtype=T.ArrayType(T.VariantType()))
        if v.kind != "array":
            return self.undefined()
        ready = SetExpr(s.atoms, v, s.preds)
        build = lambda: self.rows(ready).select(*ids, F.posexplode(v.col).alias(pos, tag)).where(F.col(tag).isNotNull())
        return SetExpr(frozenset([self.atom((*ids, pos), build).no]), V.of_column(F.col(tag), v.dtype.elementType))

    def observe(self, data: SetExpr, dist: SetExpr) -> SetExpr:
        """One sample of a distribution for each element of data, the same in every run."""
        if dist.seed is None:
            raise E.CompileError("observe needs a distribution")
        if data.seed is not None:
            raise E.CannotUseDistributionWithoutSampling("a distribution can't be observed over another")
        ids = self.sources(data)
        tag = f"o{next(self.count)}"
        seed = dist.seed
        key = F.xxhash64(F.lit(seed), *[F.col(x).cast("string") for x in ids])
        sample = (F.pmod(key, F.lit(2**53)).cast("double") / F.lit(float(2**53))).alias(tag)
        build = lambda: self.rows(data).select(*ids, sample)
        return SetExpr(frozenset([self.atom(ids, build, single=not ids).no]), V.num(F.col(tag)))

    def assert_(self, p: SetExpr, body: SetExpr) -> SetExpr:
        """body, if p holds for all its elements and there are any; else AssertionFailed."""
        row = self.rows(p, ids=False).agg(F.bool_and(V.as_bool(p.val)).alias("ok")).collect()[0]
        if not row.ok:
            raise E.AssertionFailed("assertion failed")
        return body

    # --- output --------------------------------------------------------------------------------------

    def result(self, s: SetExpr, ids: bool = False) -> DataFrame:
        """The set as a DataFrame: an object's members as columns, any other value as the column `value`."""
        if s.seed is not None:
            raise E.CannotUseDistributionWithoutSampling("use observe")
        df = self.rows(s, ids=ids)
        keep = list(self.sources(s)) if ids else []
        v = s.val
        if v.kind == "obj" and v.fields:
            cols = [V.column(m).alias(k) for k, m in v.fields.items()]
        else:
            cols = [V.column(v).alias("value")]
        return df.select(*keep, *cols)

    def cross_guard(self, a: DataFrame, b: DataFrame) -> None:
        """Raise EnormousCross where a cross would have more than MAX_CROSS rows."""
        if a.count() * b.count() > MAX_CROSS:
            raise E.EnormousCross(f"more than {MAX_CROSS} rows")
