"""Rows that fail to parse, with the reason, beside the rows that load (problem 4).

Each raw line is assembled quote-aware into one standard record, read by Python's
strict csv reader inside Arrow batches, and only then given to the typed field
constructors; so structural faults are found before value faults.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import skew_join

_LONG = re.compile(r"-?[0-9]+")
_DOUBLE = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STAMP = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})Z?")


def _is_long(s: str) -> bool:
    if not _LONG.fullmatch(s):
        return False
    digits = s.lstrip("-").lstrip("0")
    return len(digits) < 19 or (len(digits) == 19 and int(digits) <= 2**63 - (not s.startswith("-")))


def _is_stamp(s: str) -> bool:
    m = _STAMP.fullmatch(s)
    if not m:
        return False
    y, mo, d, h, mi, sec = map(int, m.groups())
    days = (31, 29 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    return 1 <= mo <= 12 and 1 <= d <= days[mo - 1] and h < 24 and mi < 60 and sec < 60


_FITS = {
    "long": _is_long,
    "double": lambda s: bool(_DOUBLE.fullmatch(s)),
    "boolean": lambda s: s.lower() in ("true", "false"),
    "timestamp": _is_stamp,
}


def assemble(line: str, delimiter: str, quote: str, escape: str) -> str:
    """The line with every escape inside a quoted field rewritten as the csv reader knows it (only quotes doubled).

    Needed because the reader would also honour escapes outside quotes, where they are plain text.
    """
    out, i, n, start = [], 0, len(line), True
    while i < n:
        if start and line[i] == quote:
            out.append(quote)
            i += 1
            while i < n:
                c = line[i]
                if c == escape and i + 1 < n and line[i + 1] in (quote, escape):
                    out.append(line[i + 1] * (2 if line[i + 1] == quote else 1))
                    i += 2
                elif c == quote and line[i + 1 : i + 2] == quote:
                    out.append(quote * 2)
                    i += 2
                elif c == quote:
                    out.append(quote)
                    i += 1
                    break
                else:
                    out.append(c)
                    i += 1
        if i < n:
            out.append(line[i])
            start = line[i] == delimiter
            i += 1
    return "".join(out)


def _plain_split(line: str, delimiter: str, quote: str, escape: str) -> list[str] | None:
    """The same rules without the csv reader, for dialects it can't take (several characters, none, or equal ones); None: a quoting fault."""
    fields, i, n = [], 0, len(line)
    while True:
        if quote and line.startswith(quote, i):
            i += len(quote)
            buf = []
            while True:
                if i >= n:
                    return None
                if escape and escape != quote and line.startswith(escape, i) and (line.startswith(quote, i + len(escape)) or line.startswith(escape, i + len(escape))):
                    i += len(escape)
                    buf.append(quote if line.startswith(quote, i) else escape)
                    i += len(buf[-1])
                elif line.startswith(quote * 2, i):
                    buf.append(quote)
                    i += 2 * len(quote)
                elif line.startswith(quote, i):
                    i += len(quote)
                    break
                else:
                    buf.append(line[i])
                    i += 1
            fields.append("".join(buf))
            if i >= n:
                return fields
            if not (delimiter and line.startswith(delimiter, i)):
                return None
            i += len(delimiter)
        else:
            j = line.find(delimiter, i) if delimiter else -1
            fields.append(line[i:] if j < 0 else line[i:j])
            if j < 0:
                return fields
            i = j + len(delimiter)


def split_line(line: str | None, delimiter: str, quote: str, escape: str) -> list[str] | None:
    """The fields of a raw line, or None where its quoting is at fault. A null line is an empty one: one blank field."""
    line = line or ""
    if line.endswith("\r"):
        line = line[:-1]
    single = len(delimiter) == 1 and len(quote) == 1 and delimiter != quote and delimiter not in "\r\n" and quote not in "\r\n" and len(escape) <= 1
    if not single:
        return _plain_split(line, delimiter, quote, escape)
    if escape and escape != quote and escape in line:
        if escape == delimiter:
            return _plain_split(line, delimiter, quote, escape)
        line = assemble(line, delimiter, quote, escape)
    marks = None
    if "\n" in line or "\r" in line:  # the reader takes a bare line break for the end of a record
        free = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in line and chr(c) not in (delimiter, quote))
        marks = (next(free), next(free))
        line = line.replace("\n", marks[0]).replace("\r", marks[1])
    try:
        fields = next(csv.reader([line], delimiter=delimiter, quotechar=quote, doublequote=True, escapechar=None, strict=True, skipinitialspace=False), [""]) or [""]
    except csv.Error:
        return None
    if marks:
        fields = [f.replace(marks[0], "\n").replace(marks[1], "\r") for f in fields]
    return fields


def check_line(line: str | None, delimiter: str, quote: str, escape: str, types: list[str], width: int) -> tuple[str | None, list[str] | None]:
    """(reason, trimmed fields): reason None where the line loads."""
    fields = split_line(line, delimiter, quote, escape)
    if fields is None:
        return "quoting", None
    if len(fields) != width:
        return "columns", None
    fields = [f.strip() for f in fields]
    for f, t in zip(fields, types):
        fits = _FITS.get(t)
        if f and fits and not fits(f):
            return "value", None
    return None, fields


def parse_lines(lines: DataFrame, batches: DataFrame, rejects_only: bool = False) -> DataFrame:
    """(ingest_no, line_no, line_id, reason, fields): reason null and fields set where the line loads; with rejects_only just the others, without fields.

    Every line is read under its own batch's dialect and types. Defined cases:
    repeated batch rows count once (the least by dialect); a line of no known
    batch is left out of both sides; a null raw_line is one blank field; an
    unknown type takes any text; repeated lines stay repeated here. Lines are
    never gathered by batch, so a batch may hold any share of them.
    """
    dialect = (
        batches.where("ingest_no is not null")
        .groupBy("ingest_no")
        .agg(
            F.min(
                F.struct(
                    F.coalesce("delimiter", F.lit("")).alias("d"),
                    F.coalesce("quote_char", F.lit("")).alias("q"),
                    F.coalesce("escape_char", F.lit("")).alias("e"),
                    F.array_join(F.coalesce("column_types", F.array().cast("array<string>")), ",", "string").alias("t"),
                    F.size(F.coalesce("column_names", F.array().cast("array<string>"))).alias("w"),
                )
            ).alias("x")
        )
        .select("ingest_no", "x.*")
    )
    rows = skew_join(lines.select("ingest_no", "line_no", "line_id", "raw_line"), dialect, ["ingest_no"], "inner")
    schema = "ingest_no bigint, line_no int, line_id bigint, reason string" + ("" if rejects_only else ", fields array<string>")

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        csv.field_size_limit(sys.maxsize if sys.maxsize < 2**31 else 2**31 - 1)
        split: dict[str, list[str]] = {}
        for b in frames:
            col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            keep, reasons, fields = [], [], []
            for i, (line, d, q, e, t, w) in enumerate(zip(col["raw_line"], col["d"], col["q"], col["e"], col["t"], col["w"])):
                types = split.get(t)
                if types is None:
                    types = split[t] = t.split(",")
                why, got = check_line(line, d, q, e, types, w)
                if rejects_only and why is None:
                    continue
                keep.append(i)
                reasons.append(why)
                fields.append(got)
            at = pa.array(keep, pa.int64())
            out = [b.column(b.schema.names.index(c)).take(at).cast(k) for c, k in (("ingest_no", pa.int64()), ("line_no", pa.int32()), ("line_id", pa.int64()))]
            out.append(pa.array(reasons, pa.string()))
            names = ["ingest_no", "line_no", "line_id", "reason"]
            if not rejects_only:
                out.append(pa.array(fields, pa.list_(pa.string())))
                names.append("fields")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, schema)


def failed_lines(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """(ingest_no, line_no, reason) of the failing lines, distinct."""
    return parse_lines(lines, batches, rejects_only=True).select("ingest_no", "line_no", "reason").distinct()


def loaded_lines(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """(ingest_no, line_no, fields) of the lines that load; a line sent again counts once."""
    return parse_lines(lines, batches).where("reason is null").groupBy("ingest_no", "line_no").agg(F.min("fields").alias("fields"))


def batch_results(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """(ingest_no, total, ingested, quoting, columns, value): what BatchResult's counters should say; the errors themselves are failed_lines.

    Batches without a line have zeros.
    """
    once = parse_lines(lines, batches).select("ingest_no", "line_no", "reason").distinct()
    n = lambda c: F.count(F.when(c, 1))
    per = once.groupBy("ingest_no").agg(
        F.count("*").alias("total"),
        n(F.col("reason").isNull()).alias("ingested"),
        *[n(F.col("reason") == r).alias(r) for r in ("quoting", "columns", "value")],
    )
    known = batches.where("ingest_no is not null").select("ingest_no").distinct()
    return known.join(per, "ingest_no", "left").na.fill(0)
