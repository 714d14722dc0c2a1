"""Values of the language as column expressions.

SQL NULL stands for undefined; an operator outside its domain gives NULL and never
an error. JSON null is a value of its own kind. A value is a tree: objects and
arrays that the plan knows are kept apart by member, so that only used members are
read; JSON of unknown shape is a VARIANT column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTC = "+00:00"


@dataclass
class Val:
    """kind: num, str, bool, date, period, null, obj, arr, array, variant or undef.

    col: the column (None for obj and arr); fields / items: members of a known object
    or array; zone: a date's own offset; inner: an object or array that was written
    in the query, undefined unless all its members are defined; lit: the Python value
    of a constant.
    """

    kind: str
    col: Column | None = None
    fields: dict[str, "Val"] = field(default_factory=dict)
    items: list["Val"] = field(default_factory=list)
    zone: Column | None = None
    dtype: T.DataType | None = None
    inner: bool = False
    lit: object = None
    integral: bool = False
    dirty: bool = False  # a double that may be NaN or infinite, which counts as undefined
    row: bool = False  # a loaded row, which is there whatever its members
    ok: Column | None = None  # kept by whole()
    sieve: Column | None = None  # for a boolean: a form of it for filters, which scans can use


def undefined() -> Val:
    return Val("undef", F.lit(None).cast("string"))


def num(c: Column, integral: bool = False, dirty: bool = False) -> Val:
    return Val("num", c, integral=integral, dirty=dirty)


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def text(c: Column) -> Val:
    return Val("str", c)


def boolean(c: Column) -> Val:
    return Val("bool", c)


def date(ts: Column, zone: Column | None = None) -> Val:
    return Val("date", ts, zone=zone if zone is not None else F.lit(UTC))


def obj(fields: dict[str, Val]) -> Val:
    return Val("obj", fields=dict(fields), inner=True)


def constant(x) -> Val:
    if x is None:
        return Val("null", F.lit(True))
    if isinstance(x, bool):
        return Val("bool", F.lit(x), lit=x)
    if isinstance(x, int):
        return Val("num", F.lit(x).cast("bigint") if abs(x) < 2**63 else F.lit(float(x)), lit=x, integral=abs(x) < 2**63)
    if isinstance(x, float):
        return Val("num", F.lit(x), lit=x)
    if isinstance(x, str):
        return Val("str", F.lit(x), lit=x)
    raise TypeError(type(x))


def of_column(c: Column, t: T.DataType) -> Val:
    """A loaded column as a value; a struct's members may be undefined without the struct being so."""
    if isinstance(t, T.BooleanType):
        return boolean(c)
    if isinstance(t, T.StringType):
        return text(c)
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return num(c.cast("bigint"), True)
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return num(c.cast("double") if isinstance(t, T.FloatType) else c, dirty=not isinstance(t, T.DecimalType))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return date(c.cast("timestamp"))
    if isinstance(t, T.StructType):
        if [f.name for f in t.fields] == ["ts", "zone"]:
            return date(c["ts"].cast("timestamp"), c["zone"])
        return Val("obj", c, fields={f.name: of_column(c.getField(f.name), f.dataType) for f in t.fields}, dtype=t)
    if isinstance(t, T.ArrayType):
        return Val("array", c, dtype=t)
    if isinstance(t, T.VariantType):
        return Val("variant", c)
    if isinstance(t, T.NullType):
        return undefined()
    return Val("variant", F.parse_json(F.to_json(F.struct(c.alias("v")))))


def defined(v: Val) -> Column:
    """Is the value defined?"""
    if v.kind == "undef":
        return F.lit(False)
    if v.row or v.lit is not None:
        return F.lit(True)
    if v.dirty:
        return v.col.isNotNull() & is_finite(v.col)
    if v.kind in ("obj", "arr") and v.inner:
        out = F.lit(True)
        for m in [*v.fields.values(), *v.items]:
            out = out & defined(m)
        return out
    if v.kind in ("obj", "arr") and v.col is None:  # a loaded row or a model: there if any member is
        members = [*v.fields.values(), *v.items]
        out = F.lit(not members)
        for m in members:
            out = out | defined(m)
        return out
    return v.col.isNotNull()


def whole(v: Val) -> Column | None:
    """For an object or array written in a query: the condition under which it exists, always the same column object; else None."""
    if v.kind in ("obj", "arr") and v.inner and v.col is None:
        if v.ok is None:
            v.ok = defined(v)
        return v.ok
    return None


def column(v: Val, keep_zone: bool = False) -> Column:
    """The value as one column: objects as structs, known arrays as arrays, dates as timestamps (or with their zone)."""
    if v.kind == "obj":
        if v.col is not None:
            return v.col
        if not v.fields:
            return F.parse_json(F.lit("{}"))
        s = F.struct(*[column(m, keep_zone).alias(k) for k, m in v.fields.items()])
        return F.when(defined(v), s) if v.inner else s
    if v.kind == "arr":
        if not v.items:
            return F.array().cast("array<double>")
        kinds = {m.kind for m in v.items}
        cols = [column(m, keep_zone) for m in v.items]
        if kinds == {"num"} and any(not m.integral for m in v.items):
            cols = [c.cast("double") for c in cols]
        elif len(kinds) > 1:
            cols = [variant(m) for m in v.items]
        return F.when(defined(v), F.array(*cols))
    if v.kind == "date" and keep_zone:
        return F.when(v.col.isNotNull(), F.struct(v.col.alias("ts"), v.zone.alias("zone")))
    if v.kind == "null":
        return F.parse_json(F.lit("null"))
    return v.col


def json_text(v: Val) -> Column:
    """Canonical text of a value: equal values, and only these, have equal text; numbers by their value."""
    if v.kind == "num":
        d = v.col.cast("double")
        return F.when(v.col.isNotNull(), F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string")))
    if v.kind == "str":
        return F.concat(F.lit('"'), F.replace(F.replace(v.col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    if v.kind == "bool":
        return v.col.cast("string")
    if v.kind == "null":
        return F.lit("null")
    if v.kind == "date":
        return F.concat(F.lit("@"), F.unix_micros(v.col).cast("string"))
    if v.kind == "obj" and (v.inner or v.fields):
        parts = [F.coalesce(F.concat(F.lit(f'"{k}":'), json_text(m), F.lit(",")), F.lit("")) for k, m in sorted(v.fields.items())]
        body = F.concat(F.lit("{"), *parts, F.lit("}")) if parts else F.lit("{}")
        return F.when(defined(v), body)
    if v.kind == "arr":
        parts = [F.concat(json_text(m), F.lit(",")) for m in v.items]
        return F.concat(F.lit("["), *parts, F.lit("]")) if parts else F.lit("[]")
    if v.kind == "array":
        inner = F.transform(v.col, lambda e: json_text(of_column(e, v.dtype.elementType)))
        return F.when(v.col.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(inner, lambda e: F.concat(e, F.lit(","))), ""), F.lit("]")))
    if v.kind == "variant":
        n = as_num(v)
        return F.coalesce(json_text(num(n)), F.regexp_replace(F.to_json(v.col), r"([0-9])\.0(?=[,}\]])", "$1"))
    if v.kind == "undef":
        return F.lit(None).cast("string")
    return F.to_json(F.struct(column(v).alias("v")))


def variant(v: Val) -> Column:
    """The value as a VARIANT column."""
    if v.kind == "variant":
        return v.col
    if v.kind == "null":
        return F.parse_json(F.lit("null"))
    if v.kind == "undef":
        return F.parse_json(F.lit(None).cast("string"))
    if v.kind in ("obj", "array", "arr"):
        return F.to_variant_object(column(v))
    return column(v).cast("variant")


def shape(v: Val) -> Column:
    """Type name of a VARIANT value's root: BIGINT, DOUBLE, DECIMAL, STRING, BOOLEAN, VOID, OBJECT or ARRAY."""
    return F.regexp_extract(F.schema_of_variant(v.col), r"^([A-Z]+)", 1)


_NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")


def as_num(v: Val, checked: bool = True) -> Column:
    """The number, or null; unchecked, a double may still be NaN or infinite."""
    if v.kind == "num":
        return F.when(is_finite(v.col), v.col) if checked and v.dirty else v.col
    if v.kind == "variant":
        return F.when(shape(v).isin(*_NUMBERS), F.try_variant_get(v.col, "$", "double"))
    return F.lit(None).cast("double")


def as_bool(v: Val) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind == "variant":
        return F.when(shape(v) == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean"))
    return F.lit(None).cast("boolean")


def as_plain_text(v: Val) -> Column:
    """Strings only."""
    if v.kind == "str":
        return v.col
    if v.kind == "variant":
        return F.when(shape(v) == "STRING", F.try_variant_get(v.col, "$", "string"))
    return F.lit(None).cast("string")


def local(v: Val) -> Column:
    """A date's time of day and calendar in its own zone, as a UTC timestamp with those fields."""
    return F.from_utc_timestamp(v.col, v.zone)


def as_text(v: Val) -> Column:
    """Strings, and dates as ISO text."""
    if v.kind == "date":
        zone = F.when(v.zone == UTC, "Z").otherwise(v.zone)
        return F.concat(F.date_format(local(v), "yyyy-MM-dd'T'HH:mm:ss.SSS"), zone)
    return as_plain_text(v)


_ISO = r"^\s*\d{4}(?:-\d{2}(?:-\d{2})?)?(?:[T ]\d{2}:?(?:\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?\s*$"


def as_date(v: Val) -> Val:
    """Dates, and strings in ISO 8601 with 'T' or a space; the written offset is kept, none is UTC."""
    if v.kind == "date":
        return v
    s = as_plain_text(v)
    zone = F.regexp_extract(s, r"[T ].*?(Z|[+-]\d{2}(?::?\d{2})?)\s*$", 1)
    off = F.when((zone == "") | (zone == "Z"), F.lit(UTC)).otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.when(F.length(zone) > 3, F.right(zone, F.lit(2))).otherwise("00")))
    plain = F.regexp_replace(F.regexp_replace(F.trim(s), r"(?<=[T ]\d{2}.{0,20})(?:Z|[+-]\d{2}(?::?\d{2})?)$", ""), ",", ".")
    ts = F.when(s.rlike(_ISO), plain.try_cast("timestamp"))
    return date(F.to_utc_timestamp(ts, off), off)


def deref(v: Val, name: str) -> Val:
    """v.name; undefined where v is no object or has no such member.

    A member of an object written in a query exists only where the whole object does;
    whoever takes it out also filters by whole(v).
    """
    if v.kind == "obj":
        m = v.fields.get(name)
        return undefined() if m is None else m
    if v.kind == "variant":
        path = name.replace("'", "\\'")
        return Val("variant", F.try_variant_get(v.col, f"$['{path}']", "variant"))
    return undefined()


def guard(v: Val, ok: Column) -> Val:
    """The value where ok, else undefined."""
    if v.kind in ("obj", "arr") and v.col is None:
        return Val(v.kind, fields={k: guard(m, ok) for k, m in v.fields.items()}, items=[guard(m, ok) for m in v.items], inner=v.inner, dtype=v.dtype)
    return Val(v.kind, F.when(ok, v.col), fields={k: guard(m, ok) for k, m in v.fields.items()}, zone=v.zone, dtype=v.dtype, inner=v.inner, integral=v.integral, dirty=v.dirty)


def index(v: Val, i: Val) -> Val:
    """v[i] for arrays by number (cut to an integer) and objects by constant name; out of range is undefined."""
    if i.kind == "str" and isinstance(i.lit, str):
        return deref(v, i.lit)
    if v.kind == "arr":
        if isinstance(i.lit, (int, float)):
            k = int(i.lit)
            return v.items[k] if 0 <= k < len(v.items) else undefined()
        return index(Val("array", column(v), dtype=T.ArrayType(_element(v))), i)
    n = F.floor(as_num(i)).cast("int")
    if v.kind == "array":
        return of_column(F.when(n >= 0, F.get(v.col, n)), v.dtype.elementType)
    if v.kind == "variant":
        if isinstance(i.lit, (int, float)) and i.lit >= 0:
            return Val("variant", F.try_variant_get(v.col, f"$[{int(i.lit)}]", "variant"))
        by_name = F.try_variant_get(v.col, F.concat(F.lit("$['"), as_plain_text(i), F.lit("']")), "variant")
        by_no = F.try_variant_get(v.col, F.concat(F.lit("$["), n.cast("string"), F.lit("]")), "variant")
        return Val("variant", F.coalesce(F.when(n >= 0, by_no), by_name))
    if v.kind == "obj" and i.kind in ("str", "variant"):
        out = F.lit(None).cast("variant")
        for k, m in v.fields.items():
            out = F.when(as_plain_text(i) == k, variant(m)).otherwise(out)
        return Val("variant", out)
    return undefined()


def _element(v: Val) -> T.DataType:
    kinds = {m.kind for m in v.items}
    if kinds == {"num"}:
        return T.LongType() if all(m.integral for m in v.items) else T.DoubleType()
    return {frozenset({"str"}): T.StringType(), frozenset({"bool"}): T.BooleanType()}.get(frozenset(kinds), T.VariantType())


def merge(a: Val, b: Val) -> Val:
    """a with b: members of both objects, b's where both have one."""
    if a.kind != "obj" or b.kind != "obj":
        return undefined()
    ok = defined(a) & defined(b)
    out = Val("obj", fields={k: guard(m, ok) for k, m in {**a.fields, **b.fields}.items()}, inner=a.inner and b.inner)
    return out


def equal(a: Val, b: Val) -> Column:
    """Deep equality, numbers by value; defined only where both sides are."""
    both = defined(a) & defined(b)
    if a.kind == "undef" or b.kind == "undef":
        return F.lit(None).cast("boolean")
    if a.kind == b.kind == "num":
        return as_num(a) == as_num(b)
    if a.kind == b.kind and a.kind in ("str", "bool", "date"):
        return a.col == b.col
    if "variant" in (a.kind, b.kind) and {a.kind, b.kind} & {"num", "str", "bool"}:
        v, t = (a, b) if a.kind == "variant" else (b, a)
        cast = {"num": as_num, "str": as_plain_text, "bool": as_bool}[t.kind](v)
        return F.when(both, F.coalesce(cast == t.col, F.lit(False)))
    if {a.kind, b.kind} == {"null"}:
        return F.lit(True)
    if {a.kind, b.kind} == {"variant", "null"}:
        v = a if a.kind == "variant" else b
        return F.when(both, F.is_variant_null(v.col))
    groups = ({"obj", "variant"}, {"arr", "array", "variant"})
    if any({a.kind, b.kind} <= g for g in groups):
        return F.when(both, json_text(a) == json_text(b))
    return F.when(both, F.lit(False))


def same_kind(vals: list[Val]) -> tuple[str, list[Val]]:
    """Bring values to one kind so that their columns can be united; mixed kinds become VARIANT."""
    kinds = {v.kind for v in vals if v.kind != "undef"}
    if len(kinds) == 1 and kinds <= {"num", "str", "bool", "date"}:
        k = next(iter(kinds))
        if k == "num" and not all(v.integral for v in vals if v.kind == "num"):
            vals = [num(v.col.cast("double"), dirty=v.dirty) if v.kind == "num" else v for v in vals]
        return k, vals
    if kinds == {"obj"} and len({tuple(sorted(v.fields)) for v in vals if v.kind == "obj"}) == 1 and all(v.kind == "obj" for v in vals):
        return "obj", vals
    if not kinds:
        return "undef", vals
    return "variant", [Val("variant", variant(v)) for v in vals]
