"""Row-level projections that the language needs only inside, as functions of values.

An inner form is undefined unless all parts are; an outer form takes what is there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.values import Val


def filter_value(v: Val, p: Val) -> Val:
    """v where p is true, else undefined."""
    return V.guard(v, V.as_bool(p))


def deep_map(v: Val, f) -> Val:
    """f on every leaf of a value."""
    if v.kind in ("obj", "arr") and v.col is None:
        return Val(v.kind, fields={k: deep_map(m, f) for k, m in v.fields.items()}, items=[deep_map(m, f) for m in v.items], inner=v.inner)
    return f(v)


def inner_object_concat(*objs: Val) -> Val:
    out = objs[0]
    for o in objs[1:]:
        out = V.merge(out, o)
    return out


def outer_object_concat(*objs: Val) -> Val:
    """Members of all objects; where a later one lacks or doesn't define a member, the earlier one's stays."""
    fields: dict[str, Val] = {}
    for o in objs:
        for k, m in o.fields.items():
            if k not in fields:
                fields[k] = m
            elif fields[k].kind == m.kind and m.col is not None:
                fields[k] = Val(m.kind, F.coalesce(m.col, fields[k].col), integral=m.integral and fields[k].integral, dirty=m.dirty or fields[k].dirty, zone=m.zone, dtype=m.dtype)
            else:
                fields[k] = m
    return Val("obj", fields=fields)


def inner_array_concat(a: Val, b: Val) -> Val:
    if a.kind == b.kind == "arr":
        return Val("arr", items=[*a.items, *b.items], inner=True)
    return Val("array", F.concat(V.column(a), V.column(b)), dtype=a.dtype or b.dtype)


def outer_array_concat(a: Val, b: Val) -> Val:
    t = a.dtype or b.dtype or T.ArrayType(T.DoubleType())
    none = F.array().cast(t)
    return Val("array", F.concat(F.coalesce(V.column(a), none), F.coalesce(V.column(b), none)), dtype=t)


def object_delete(v: Val, *names: str) -> Val:
    return Val("obj", fields={k: m for k, m in v.fields.items() if k not in names}, inner=v.inner)


def wrap_object(v: Val, name: str) -> Val:
    return V.obj({name: v})


def wrap_object_dynamic(v: Val, name: Val) -> Val:
    """{name: v} with a name that varies from row to row, as VARIANT."""
    key, val = F.to_json(F.array(V.as_plain_text(name))), F.to_json(F.array(V.column(v)))
    bare = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)  # noqa: E731 - without the brackets
    whole = F.concat(F.lit("{"), bare(key), F.lit(":"), bare(val), F.lit("}"))
    return Val("variant", F.when(V.defined(v) & V.as_plain_text(name).isNotNull(), F.try_parse_json(whole)))


def wrap_array(v: Val) -> Val:
    return Val("arr", items=[v], inner=True)


def array_swap(v: Val, i: int, j: int = 0) -> Val:
    items = list(v.items)
    items[i], items[j] = items[j], items[i]
    return Val("arr", items=items, inner=v.inner)


def typed(v: Val, kind: str) -> Val:
    """The value where it is of the kind (num, str, bool, obj, array, null), else undefined."""
    if v.kind == "variant":
        names = {"num": V._NUMBERS, "str": ("STRING",), "bool": ("BOOLEAN",), "obj": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}[kind]
        return V.guard(v, V.shape(v).isin(*names))
    same = v.kind == kind or (kind == "array" and v.kind == "arr")
    return v if same else V.undefined()


def is_type(v: Val, kind: str) -> Column:
    return F.coalesce(V.defined(typed(v, kind)), F.lit(False)) & V.defined(v)


def const_literal(x, target: Val) -> Val:
    """A constant wherever the target is defined."""
    return V.guard(V.constant(x), V.defined(target))


def equal_literal(v: Val, x, invert: bool = False) -> Column:
    e = V.equal(v, V.constant(x))
    return ~e if invert else e


def filter_defined(v: Val, definer: Val, how: str = "any") -> Val:
    """v where any (or all) of the definer's members are defined."""
    members = [*definer.fields.values(), *definer.items] or [definer]
    ok = V.defined(members[0])
    for m in members[1:]:
        ok = ok | V.defined(m) if how == "any" else ok & V.defined(m)
    return V.guard(v, ok)
