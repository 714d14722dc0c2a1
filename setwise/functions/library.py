"""The scalar library: infix and unary operators, mathematics, strings, time and types.

Every function takes values and gives a value; all of it is column expressions that
Spark compiles, with Arrow-batched pandas functions only where no expression exists.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import (
    UTC,
    Val,
    as_bool,
    as_date,
    as_num,
    as_plain_text,
    as_text,
    boolean,
    date,
    defined,
    deref,
    equal,
    is_finite,
    local,
    num,
    shape,
    text,
    undefined,
)


@dataclass
class Fn:
    name: str
    arity: int
    impl: Callable[..., Val]
    deprecated: bool = False


LIBRARY: dict[str, Fn] = {}


def register(name: str, arity: int, deprecated: bool = False):
    def add(f):
        LIBRARY[name] = Fn(name, arity, f, deprecated)
        return f

    return add


def register_function(name: str, arity: int, impl: Callable[..., Val]) -> None:
    """Extension point: a row-level function of values under a name such as 'my::f'."""
    LIBRARY[name] = Fn(name, arity, impl)


def finite(c: Column) -> Column:
    """A double, or undefined where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


# --- infix and unary -----------------------------------------------------------------------


def _arith(op: Callable[[Column, Column], Column], plain: Callable[[Column, Column], Column]) -> Callable[[Val, Val], Val]:
    def f(a: Val, b: Val) -> Val:
        x, y = as_num(a, checked=False), as_num(b, checked=False)
        if a.integral and b.integral:  # beyond 64 bits: undefined
            return num(op(x, y), True)
        # NaN and infinity spread through sums and products, so one check at the end is enough
        return num(plain(x.cast("double"), y.cast("double")), dirty=True)

    return f


add = register("std::infix::add", 2)(_arith(F.try_add, lambda x, y: x + y))
subtract = register("std::infix::subtract", 2)(_arith(F.try_subtract, lambda x, y: x - y))
multiply = register("std::infix::multiply", 2)(_arith(F.try_multiply, lambda x, y: x * y))


@register("std::infix::divide", 2)
def divide(a: Val, b: Val) -> Val:
    return num(F.try_divide(as_num(a, checked=False).cast("double"), as_num(b).cast("double")), dirty=True)


@register("std::infix::mod", 2)
def mod(a: Val, b: Val) -> Val:
    x, y = as_num(a), as_num(b)
    rest = F.try_mod(x, y)
    return num(F.when(((x < 0) & (y > 0)) | ((x > 0) & (y < 0)), rest + y).otherwise(rest), a.integral and b.integral)


@register("std::infix::pow", 2)
def power(a: Val, b: Val) -> Val:
    return num(F.pow(as_num(a).cast("double"), as_num(b).cast("double")), dirty=True)


def _compare(op: Callable[[Column, Column], Column]) -> Callable[[Val, Val], Val]:
    def f(a: Val, b: Val) -> Val:
        if a.kind == b.kind == "date":
            return boolean(op(a.col, b.col))
        out = boolean(op(as_num(a), as_num(b)))
        if a.dirty or b.dirty:  # as a filter: the bare comparison, which a scan can use, and the checks beside it
            x, y = as_num(a, checked=False), as_num(b, checked=False)
            out.sieve = op(x, y)
            for v, c in ((a, x), (b, y)):
                if v.dirty:
                    out.sieve = out.sieve & is_finite(c)
        return out

    return f


less = register("std::infix::lt", 2)(_compare(lambda x, y: x < y))
less_equal = register("std::infix::lte", 2)(_compare(lambda x, y: x <= y))
greater = register("std::infix::gt", 2)(_compare(lambda x, y: x > y))
greater_equal = register("std::infix::gte", 2)(_compare(lambda x, y: x >= y))


@register("std::infix::and", 2)
def both(a: Val, b: Val) -> Val:
    x, y = as_bool(a), as_bool(b)
    out = boolean(F.when(x.isNotNull() & y.isNotNull(), x & y))
    out.sieve = (x if a.sieve is None else a.sieve) & (y if b.sieve is None else b.sieve)
    return out


@register("std::infix::or", 2)
def either(a: Val, b: Val) -> Val:
    x, y = as_bool(a), as_bool(b)
    return boolean(F.when(x.isNotNull() & y.isNotNull(), x | y))


def equals(a: Val, b: Val) -> Val:
    return boolean(equal(a, b))


def not_equals(a: Val, b: Val) -> Val:
    return boolean(~equal(a, b))


@register("std::infix::concatString", 2)
def concat_string(a: Val, b: Val) -> Val:
    return text(F.concat(as_text(a), as_text(b)))


@register("std::unary::comp", 1)
def negate(a: Val) -> Val:
    return boolean(~as_bool(a))


@register("std::unary::neg", 1)
def minus(a: Val) -> Val:
    return num(F.try_multiply(as_num(a), F.lit(-1).cast("bigint")) if a.integral else -as_num(a, checked=False), a.integral, a.dirty)


# --- mathematics ---------------------------------------------------------------------------


def _math1(name: str, f: Callable[[Column], Column], domain: Callable[[Column], Column] | None = None) -> None:
    def g(a: Val) -> Val:
        x = as_num(a).cast("double")
        if domain:
            x = F.when(domain(x), x)
        return num(f(x), dirty=True)

    register(f"std::math::{name}", 1)(g)


for _n, _f in {
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "exp": F.exp, "expm1": F.expm1,
    "cbrt": F.cbrt, "rint": F.rint, "abs": F.abs, "signum": F.signum, "toDegrees": F.degrees, "toRadians": F.radians,
    "ceil": lambda x: F.when(F.abs(x) >= 2.0**52, x).otherwise(F.ceil(x).cast("double")),
    "floor": lambda x: F.when(F.abs(x) >= 2.0**52, x).otherwise(F.floor(x).cast("double")),
    "round": lambda x: F.when(F.abs(x) >= 2.0**52, x).otherwise(F.floor(x + 0.5).cast("double")),
}.items():
    _math1(_n, _f)
_math1("asin", F.asin, lambda x: F.abs(x) <= 1)
_math1("acos", F.acos, lambda x: F.abs(x) <= 1)
_math1("log", F.ln, lambda x: x > 0)
_math1("log10", F.log10, lambda x: x > 0)
_math1("log1p", F.log1p, lambda x: x > -1)
_math1("sqrt", F.sqrt, lambda x: x >= 0)


@F.pandas_udf(T.DoubleType())
def _spacing(x: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series(np.spacing(np.abs(x.to_numpy(float))))


@F.pandas_udf(T.DoubleType())
def _exponent(x: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series(np.frexp(x.to_numpy(float))[1] - 1.0).where(x.notna().to_numpy())


_math1("ulp", lambda x: _spacing(x))
_math1("getExponent", lambda x: _exponent(x), lambda x: x > 0)


def _math2(name: str, f: Callable[[Column, Column], Column], deprecated: bool = False) -> None:
    def g(a: Val, b: Val) -> Val:
        x, y = as_num(a).cast("double"), as_num(b).cast("double")
        return num(F.when(x.isNotNull() & y.isNotNull(), f(x, y)), dirty=True)

    register(f"std::math::{name}", 2, deprecated)(g)


def _ieee_remainder(x: Column, y: Column) -> Column:
    return x - y * F.rint(F.try_divide(x, y))


for _n, _f in {
    "pow": F.pow, "minOf": F.least, "maxOf": F.greatest, "hypot": F.hypot, "atan2": F.atan2,
    "copySign": lambda x, y: F.when((y < 0) | (y.cast("string") == "-0.0"), -F.abs(x)).otherwise(F.abs(x)),
    "IEEEremainder": _ieee_remainder,
    "roundTo": lambda x, d: F.try_divide(F.floor(x * F.pow(F.lit(10.0), d) + 0.5), F.pow(F.lit(10.0), d)),
}.items():
    _math2(_n, _f)
_math2("min", F.least, deprecated=True)
_math2("max", F.greatest, deprecated=True)


# --- strings ---------------------------------------------------------------------------------


def _str1(name: str, f: Callable[[Column], Val]) -> None:
    register(f"std::string::{name}", 1)(lambda a: f(as_text(a)))


_str1("trim", lambda s: text(F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")))
_str1("toUpperCase", lambda s: text(F.upper(s)))
_str1("toLowerCase", lambda s: text(F.lower(s)))
_str1("intern", lambda s: text(s))
_str1("isEmpty", lambda s: boolean(s == ""))


def _units(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.char_length(s) + F.char_length(F.regexp_replace(s, r"[^\x{10000}-\x{10FFFF}]", ""))).cast("bigint")


_str1("length", lambda s: num(_units(s), True))


def _str2(name: str, f: Callable[[Column, Column], Val], deprecated: bool = False) -> None:
    register(f"std::string::{name}", 2, deprecated)(lambda a, b: f(as_text(a), as_text(b)))


_str2("equals", lambda a, b: boolean(a == b))
_str2("equalsIgnoreCase", lambda a, b: boolean(F.lower(a) == F.lower(b)))
_str2("startsWith", lambda a, b: boolean(F.startswith(a, b)))
_str2("endsWith", lambda a, b: boolean(F.endswith(a, b)))
_str2("concat", lambda a, b: text(F.concat(a, b)))
_str2("indexOf", lambda a, b: num((F.call_function("locate", b, a) - 1).cast("bigint"), True))
_str2("lastIndexOf", lambda a, b: num(F.when(b == "", F.char_length(a)).when(F.call_function("locate", b, a) == 0, F.lit(-1)).otherwise(F.char_length(a) - F.call_function("locate", F.reverse(b), F.reverse(a)) - F.char_length(b) + 1).cast("bigint"), True))
_str2("editDistance", lambda a, b: num(F.levenshtein(a, b).cast("bigint"), True))


@F.pandas_udf(T.LongType())
def _java_compare(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        p, q = x.encode("utf-16-be", "surrogatepass"), y.encode("utf-16-be", "surrogatepass")
        for i in range(0, min(len(p), len(q)), 2):
            d = (p[i] << 8 | p[i + 1]) - (q[i] << 8 | q[i + 1])
            if d:
                return d
        return (len(p) - len(q)) // 2

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int64")


for _n, _dep in (("compare", False), ("compareTo", True)):
    _str2(_n, lambda a, b: num(_java_compare(a, b), True), _dep)
for _n, _dep in (("compareIgnoreCase", False), ("compareToIgnoreCase", True)):
    _str2(_n, lambda a, b: num(_java_compare(F.lower(a), F.lower(b)), True), _dep)


def _pattern(v: Val) -> str | None:
    """A constant pattern that compiles."""
    if not isinstance(v.lit, str):
        return None
    try:
        re.compile(v.lit)
    except re.error:
        return None
    return v.lit


@F.pandas_udf(T.ArrayType(T.StringType()))
def _groups(s: pd.Series, p: pd.Series) -> pd.Series:
    def one(x, y):
        try:
            m = re.fullmatch(y, x) if x is not None and y is not None else None
        except re.error:
            m = None
        return None if m is None else [g or "" for g in m.groups()]

    return pd.Series([one(x, y) for x, y in zip(s, p)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(s: pd.Series, p: pd.Series) -> pd.Series:
    def one(x, y):
        try:
            return re.split(y, x) if x is not None and y is not None else None
        except re.error:
            return None

    return pd.Series([one(x, y) for x, y in zip(s, p)])


@register("std::string::matches", 2)
def matches(a: Val, p: Val) -> Val:
    s = as_text(a)
    if p.lit is not None:
        return boolean(s.rlike(rf"\A(?:{p.lit})\z")) if _pattern(p) is not None else undefined()
    g = _groups(s, as_text(p))
    return boolean(F.when(s.isNotNull() & as_text(p).isNotNull(), g.isNotNull()))


@register("std::string::regexMatch", 2)
def regex_match(a: Val, p: Val) -> Val:
    s, t = as_text(a), T.ArrayType(T.StringType())
    if p.lit is not None:
        pat = _pattern(p)
        if pat is None:
            return undefined()
        n = re.compile(pat).groups
        whole = rf"\A(?:{pat})\z"
        groups = F.array(*[F.regexp_extract(s, whole, i + 1) for i in range(n)]) if n else F.array().cast("array<string>")
        return Val("array", F.when(s.rlike(whole), groups), dtype=t)
    return Val("array", _groups(s, as_text(p)), dtype=t)


@register("std::string::split", 2)
def split(a: Val, d: Val) -> Val:
    return Val("array", F.split(as_text(a), F.concat(F.lit("\\Q"), as_text(d), F.lit("\\E")), -1), dtype=T.ArrayType(T.StringType()))


@register("std::string::splitRegex", 2)
def split_regex(a: Val, p: Val) -> Val:
    t = T.ArrayType(T.StringType())
    if p.lit is not None:
        return Val("array", F.split(as_text(a), p.lit, -1), dtype=t) if _pattern(p) is not None else undefined()
    return Val("array", _pieces(as_text(a), as_text(p)), dtype=t)


def _whole(n: Val) -> Column:
    """A number that is integral and not negative, as an int."""
    x = as_num(n).cast("double")
    return F.when((x >= 0) & (x == F.floor(x)) & (x < 2**31), x.cast("int"))


for _n, _f in {
    "takeLeft": lambda s, n: F.substring(s, F.lit(1), n),
    "takeRight": lambda s, n: F.when(n == 0, F.lit("")).otherwise(F.right(s, n)),
    "dropLeft": lambda s, n: F.substring(s, n + 1, F.length(s)),
    "dropRight": lambda s, n: F.substring(s, F.lit(1), F.greatest(F.length(s) - n, F.lit(0))),
}.items():
    register(f"std::string::{_n}", 2)(lambda a, n, f=_f: text(F.when(_whole(n).isNotNull(), f(as_text(a), _whole(n)))))


@register("std::string::codePointAt", 2)
def code_point_at(a: Val, n: Val) -> Val:
    s, i = as_text(a), _whole(n)
    return num(F.when(i < F.length(s), _code(F.substring(s, i + 1, F.lit(1)))), True)


@register("std::string::codePointBefore", 2)
def code_point_before(a: Val, n: Val) -> Val:
    s, i = as_text(a), _whole(n)
    return num(F.when((i > 0) & (i <= F.length(s)), _code(F.substring(s, i, F.lit(1)))), True)


def _code(ch: Column) -> Column:
    """The code point of a text of one sign, from its UTF-32 form."""
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("bigint")


@register("std::string::parseNum", 1)
def parse_num(a: Val) -> Val:
    s = as_plain_text(a)
    return num(F.when(s.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), finite(s.try_cast("double"))))


@register("std::string::numToString", 1)
def num_to_string(a: Val) -> Val:
    return text(F.regexp_replace(as_num(a).cast("string"), r"\.0$", ""))


# --- time ------------------------------------------------------------------------------------

_UNITS = {"years": "YEAR", "months": "MONTH", "weeks": "WEEK", "days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND", "millis": "MILLISECOND"}


def _stamp_add(unit: str, n: Column, ts: Column) -> Column:
    if unit in ("YEAR", "MONTH"):
        months = n * 12 if unit == "YEAR" else n
        return ts + F.make_ym_interval(F.lit(0), months.cast("int"))
    factor = {"WEEK": 7 * 86400.0, "DAY": 86400.0, "HOUR": 3600.0, "MINUTE": 60.0, "SECOND": 1.0, "MILLISECOND": 0.001}[unit]
    return F.timestamp_micros(F.unix_micros(ts) + F.round(n.cast("double") * factor * 1e6).cast("bigint"))


for _n, _u in _UNITS.items():

    def _plus(a: Val, n: Val, unit: str = _u) -> Val:
        d, k = as_date(a), as_num(n).cast("int")
        return date(F.to_utc_timestamp(_stamp_add(unit, k, local(d)), d.zone), d.zone)

    def _between(a: Val, b: Val, unit: str = _u) -> Val:
        x, y = as_date(a).col, as_date(b).col
        return num(F.timestamp_diff(unit, x, y).cast("bigint"), True)

    register(f"std::time::{_n}Plus", 2)(_plus)
    register(f"std::time::{_n}Between", 2)(_between)

# Letters of the pattern language that Spark writes differently.
_PATTERN_LETTERS = {"ZZ": "xxx", "Z": "xx", "Y": "y", "C": "y", "x": "Y", "e": "e"}


@register("std::time::parseDateTime", 2)
def parse_date_time(a: Val, p: Val) -> Val:
    if a.kind == "date":
        return a
    if not isinstance(p.lit, str):
        return undefined()
    pattern = re.sub("'[^']*'|ZZ|Z|Y|C", lambda m: _PATTERN_LETTERS.get(m.group(), m.group()), p.lit)
    s = as_plain_text(a)
    zoned = "xx" in pattern
    off = F.regexp_extract(s, r"([+-]\d{2}):?(\d{2})\s*$", 1)
    zone = F.when(F.lit(zoned) & (off != ""), F.concat(off, F.lit(":"), F.regexp_extract(s, r"([+-]\d{2}):?(\d{2})\s*$", 2))).otherwise(UTC)
    return date(F.try_to_timestamp(s, F.lit(pattern)), zone)


@F.pandas_udf(T.TimestampType())
def _fuzzy(s: pd.Series) -> pd.Series:
    return pd.to_datetime(s, errors="coerce", utc=True, format="mixed").dt.tz_localize(None)


@register("std::time::parseDateTimeFuzzy", 1)
def parse_date_time_fuzzy(a: Val) -> Val:
    """ISO 8601, else what a lenient parser of absolute dates reads; relative phrases ('tomorrow') are undefined."""
    d = as_date(a)
    if a.kind == "date":
        return d
    return date(F.coalesce(d.col, _fuzzy(as_plain_text(a))), F.coalesce(d.zone, F.lit(UTC)))


_PERIOD = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,3}))?S)?)?$"
_PERIOD_PARTS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds", "millis")


@register("std::time::parsePeriod", 1)
def parse_period(a: Val) -> Val:
    if isinstance(a.lit, str):
        m = re.match(_PERIOD, a.lit)
        if not m or len(a.lit) < 2:
            return undefined()
        return Val("period", F.struct(*[F.lit(int(g or 0)).alias(n) for n, g in zip(_PERIOD_PARTS, m.groups())]))
    s = as_plain_text(a)
    part = lambda i: F.coalesce(F.regexp_extract(s, _PERIOD, i).try_cast("int"), F.lit(0))
    cols = [part(i + 1).alias(n) for i, n in enumerate(_PERIOD_PARTS)]
    return Val("period", F.when(s.rlike(_PERIOD) & (F.length(s) > 1), F.struct(*cols)))


def as_period(v: Val) -> Val:
    return v if v.kind == "period" else parse_period(v)


def _plus_period(ts: Column, p: Column, times: Column) -> Column:
    months = ((p["years"] * 12 + p["months"]) * times).cast("int")
    seconds = ((p["weeks"] * 7 + p["days"]) * 86400 + p["hours"] * 3600 + p["minutes"] * 60 + p["seconds"]).cast("bigint") * 1000 + p["millis"]
    moved = ts + F.make_ym_interval(F.lit(0), months)
    return F.timestamp_micros(F.unix_micros(moved) + seconds * times * 1000)


@register("std::time::range", 1)
def time_range(a: Val) -> Val:
    """{start, end, step}: the dates from start to end, both included, step after step."""
    start, end, step = as_date(deref(a, "start")), as_date(deref(a, "end")), as_period(deref(a, "step"))
    if step.kind != "period":
        return undefined()

    def dates(p: Column) -> Column:
        micros = F.unix_micros(_plus_period(start.col, p, F.lit(1))) - F.unix_micros(start.col)
        ok = start.col.isNotNull() & end.col.isNotNull() & (micros > 0)
        # Calendar steps are at least 28/31 of the first step long, so this many reach the end.
        most = F.when(ok, F.greatest(F.lit(0), F.ceil((F.unix_micros(end.col) - F.unix_micros(start.col)) / (micros * 0.9)) + 1))
        at = F.transform(F.sequence(F.lit(0).cast("bigint"), most.cast("bigint")), lambda i: _plus_period(start.col, p, i))
        return F.when(ok, F.transform(F.filter(at, lambda t: t <= end.col), lambda t: F.struct(t.alias("ts"), start.zone.alias("zone"))))

    # The period is bound once, so that a text is not read again for every date.
    out = F.get(F.transform(F.array(step.col), dates), F.lit(0))
    stamp = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("zone", T.StringType())])
    return Val("array", out, dtype=T.ArrayType(stamp))


@register("std::time::minTimeOf", 2)
def min_time_of(a: Val, b: Val) -> Val:
    x, y = as_date(a), as_date(b)
    first = x.col <= y.col
    return date(F.when(first, x.col).when(~first, y.col), F.when(first, x.zone).otherwise(y.zone))


@register("std::time::maxTimeOf", 2)
def max_time_of(a: Val, b: Val) -> Val:
    x, y = as_date(a), as_date(b)
    first = x.col >= y.col
    return date(F.when(first, x.col).when(~first, y.col), F.when(first, x.zone).otherwise(y.zone))


def _zone_ok(z: Column) -> Column:
    return z.rlike(r"^[+-](0\d|1[0-8]):[0-5]\d$")


def _offset_at(ts: Column, zone: Column, literal: str | None) -> Column:
    """A zone name's offset at an instant as +hh:mm; undefined for names that aren't zones."""
    if literal is not None:
        from zoneinfo import ZoneInfo

        if re.fullmatch(r"[+-](0\d|1[0-8]):[0-5]\d", literal):
            return F.lit(literal)
        try:
            ZoneInfo(literal)
        except Exception:  # noqa: BLE001 - any failure means: no such zone
            return F.lit(None).cast("string")
        minutes = ((F.unix_micros(F.from_utc_timestamp(ts, F.lit(literal))) - F.unix_micros(ts)) / 60_000_000).cast("int")
        a = F.abs(minutes)
        return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((a / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((a % 60).cast("string"), 2, "0"))
    return F.when(_zone_ok(zone), zone).when(zone.isin("UTC", "Z", "GMT"), UTC)


@register("std::time::changeTimeZone", 2)
def change_time_zone(a: Val, z: Val) -> Val:
    d = as_date(a)
    zone = _offset_at(d.col, as_plain_text(z), z.lit if isinstance(z.lit, str) else None)
    return date(F.when(zone.isNotNull(), d.col), zone)


@register("std::time::millisToISO", 2)
def millis_to_iso(a: Val, z: Val) -> Val:
    ts = F.timestamp_millis(as_num(a).cast("bigint"))
    zone = _offset_at(ts, as_plain_text(z), z.lit if isinstance(z.lit, str) else None)
    return date(F.when(zone.isNotNull(), ts), zone)


@register("std::time::getMillis", 1)
def get_millis(a: Val) -> Val:
    return num(F.unix_millis(as_date(a).col), True)


@register("std::time::timeZone", 1)
def time_zone(a: Val) -> Val:
    d = as_date(a)
    return text(F.when(d.col.isNotNull(), d.zone))


@register("std::time::season", 1)
def season(a: Val) -> Val:
    day = F.dayofyear(local(as_date(a)))
    return text(F.when((day >= 79) & (day < 171), "spring").when((day >= 171) & (day < 265), "summer").when((day >= 265) & (day < 355), "fall").when(day.isNotNull(), "winter"))


def _week_of_month(ts: Column) -> Column:
    first = F.date_trunc("month", ts)
    return F.floor((F.dayofmonth(ts) + F.weekday(first) + 1 - 1) / 7) + 1


for _n, _f in {
    "year": F.year, "quarter": F.quarter, "monthOfYear": F.month, "weekOfYear": F.weekofyear, "weekOfMonth": _week_of_month, "dayOfYear": F.dayofyear, "dayOfMonth": F.dayofmonth,
    "dayOfWeek": lambda t: F.weekday(t) + 1, "hourOfDay": F.hour, "minuteOfHour": F.minute, "secondOfMinute": F.second, "millisOfSecond": lambda t: F.pmod(F.unix_millis(t), F.lit(1000)),
}.items():
    register(f"std::time::{_n}", 1)(lambda a, f=_f: num(f(local(as_date(a))).cast("bigint"), True))

# The text forms of truncated times.
_FORMS = {
    "date": "yyyy-MM-dd", "yearMonth": "yyyy-MM", "yearDayOfYear": "yyyy-DDD", "monthDay": "MM-dd", "dateHour": "yyyy-MM-dd'T'HH", "dateHourMinute": "yyyy-MM-dd'T'HH:mm",
    "dateHourMin": "yyyy-MM-dd'T'HH:mm", "dateHourMinuteSecond": "yyyy-MM-dd'T'HH:mm:ss", "dateHourMinSec": "yyyy-MM-dd'T'HH:mm:ss", "dateHourMinuteSecondMillis": "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "dateHourMinSecMilli": "yyyy-MM-dd'T'HH:mm:ss.SSS", "timeWithoutZone": "HH:mm:ss.SSS", "hourMinute": "HH:mm", "hourMin": "HH:mm", "hourMinuteSecond": "HH:mm:ss", "hourMinSec": "HH:mm:ss",
}
for _n, _p in _FORMS.items():
    register(f"std::time::{_n}", 1, _n.endswith(("Min", "Sec", "Milli")))(lambda a, p=_p: text(F.date_format(local(as_date(a)), p)))


@register("std::time::timeWithZone", 1)
def time_with_zone(a: Val) -> Val:
    d = as_date(a)
    return text(F.concat(F.date_format(local(d), "HH:mm:ss.SSS"), d.zone))


# --- types -----------------------------------------------------------------------------------


def _is(kinds: set[str], shapes: tuple[str, ...]) -> Callable[[Val], Val]:
    def f(a: Val) -> Val:
        if a.kind == "variant":
            return boolean(F.when(a.col.isNotNull(), shape(a).isin(*shapes)))
        return boolean(F.when(defined(a), F.lit(a.kind in kinds)))

    return f


register("std::type::isNumber", 1)(_is({"num"}, ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")))
register("std::type::isBoolean", 1)(_is({"bool"}, ("BOOLEAN",)))
register("std::type::isNull", 1)(_is({"null"}, ("VOID",)))
register("std::type::isString", 1)(_is({"str"}, ("STRING",)))
register("std::type::isObject", 1)(_is({"obj"}, ("OBJECT",)))
register("std::type::isArray", 1)(_is({"arr", "array"}, ("ARRAY",)))
