"""Deeply nested records to related flat tables (problem 1).

Two forms of one method: nested transforms attach the ancestors' keys and
positions, flatten combines the arrays, one inline per target table emits rows.
``shred`` walks a typed schema; ``tree_nodes`` walks JSON trees of unknown depth
by folding the same step over the levels of each tree inside one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KID = "array<struct<kind:string,node_path:string,parent_path:string,json:string>>"
_OUT = "array<struct<kind:string,node_path:string,parent_path:string>>"


def _json_text(c: Column) -> Column:
    """JSON text without byte order mark and outer space; a text that was encoded twice is decoded."""
    strip = lambda x: F.regexp_replace(x, r"^[\s﻿]+", "")
    for _ in range(2):
        c = strip(c)
        c = F.when(c.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")).otherwise(c)
    return strip(c)


def _kids(node: Column) -> Column:
    """The children of one node (struct with node_path and json) as an array of _KID; its JSON is parsed once, by a transform over one element."""
    return F.transform(F.array(F.from_json(node["json"], "fields string, indices string")), lambda parts: _kids_of(node["node_path"], parts["fields"], parts["indices"]))[0]


def _kids_of(path: Column, fields: Column, indices: Column) -> Column:

    def field(name: Column, tree: Column) -> Column:
        return F.struct(F.lit("field").alias("kind"), F.concat(path, F.lit("."), name).alias("node_path"), path.alias("parent_path"), tree.alias("json"))

    none = F.array().cast(_KID)
    by_map = F.transform(F.map_entries(F.from_json(fields, "map<string,string>")), lambda e: field(e["key"], e["value"]))
    older = F.filter(F.from_json(fields, "array<struct<name:string,tree:string>>"), lambda e: e["name"].isNotNull())
    by_list = F.transform(older, lambda e: field(e["name"], e["tree"]))
    by_index = F.filter(
        F.transform(
            F.from_json(indices, "array<string>"),
            lambda v, i: F.struct(F.lit("index").alias("kind"), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("node_path"), path.alias("parent_path"), v.alias("json")),
        ),
        lambda k: k["json"].isNotNull(),
    )
    return F.concat(
        F.coalesce(F.when(fields.startswith("{"), by_map).when(fields.startswith("["), by_list), none),
        F.coalesce(F.when(indices.startswith("["), by_index), none),
    )


def tree_nodes(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, kind, node_path, parent_path) of every node below the root of each JSON tree.

    A node is an object with the optional members fields (object, or in the older
    shape a list of {name, tree}) and indices (list). Defined cases: a null, blank
    or unreadable tree has no nodes; a child under fields counts even if it is
    null, one under indices only if it is not; repeated rows give repeated nodes
    (callers that want a set take distinct); other columns of df, whatever their
    names, are not read. JSON nested deeper than 1000 levels is unreadable.
    """
    root = _json_text(F.col(tree))
    src = df.select(F.col(key).alias("_key"), root.alias("_root")).where(F.col("_root").startswith("{"))
    # Each level of the tree needs an opening brace, so their number bounds the levels; levels beyond the real depth cost nothing.
    bound = F.length("_root") - F.length(F.replace(F.col("_root"), F.lit("{"), F.lit("")))
    start = F.struct(
        F.array().cast(_OUT).alias("done"),
        F.array(F.struct(F.lit("root").alias("kind"), F.lit("").alias("node_path"), F.lit("").alias("parent_path"), F.col("_root").alias("json"))).cast(_KID).alias("level"),
    )

    def grow(acc: Column, _: Column) -> Column:
        rows = F.transform(acc["level"], lambda k: F.struct(k["kind"].alias("kind"), k["node_path"].alias("node_path"), k["parent_path"].alias("parent_path")))
        deeper = F.flatten(F.transform(F.filter(acc["level"], lambda k: k["json"].startswith("{")), _kids))
        step = F.struct(F.concat(acc["done"], rows).alias("done"), deeper.alias("level"))
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(step)

    nodes = F.aggregate(F.sequence(F.lit(1), bound + 1), start, grow, lambda acc: acc["done"])
    return src.select(F.col("_key").alias(key), F.inline(nodes)).where(F.col("kind") != "root")


def shred(df: DataFrame, keys: list[str], column: str, path: list[str] | None = None) -> DataFrame:
    """The flat table of one array of structs inside a typed record.

    column: the outer array of structs; path: the arrays below it, outermost
    first. Every row carries the record's keys, the position of each ancestor
    (``<array>_pos``, from 0, in the array as stored) and the scalar members of
    the innermost struct. Null arrays and null elements give no row, but keep
    their position counted. One projection with one inline, no shuffle.
    """
    levels = [column, *(path or [])]
    leaf = df.schema[column].dataType
    for name in levels[1:]:
        leaf = leaf.elementType[name].dataType
    flat = [f.name for f in leaf.elementType.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]

    def walk(arr: Column, depth: int, ancestors: list[Column]) -> Column:
        def visit(e: Column, i: Column) -> Column:
            here = [*ancestors, i.alias(f"{levels[depth]}_pos")]
            if depth == len(levels) - 1:
                return F.when(e.isNotNull(), F.struct(*here, *[e[c].alias(c) for c in flat]))
            return walk(e[levels[depth + 1]], depth + 1, here)

        out = F.transform(arr, visit)
        if depth < len(levels) - 1:
            return F.flatten(F.filter(out, lambda x: x.isNotNull()))
        return F.filter(out, lambda x: x.isNotNull())

    return df.select(*keys, F.inline(walk(F.col(column), 0, [])))


def tree_columns(df: DataFrame, key: str, columns: str) -> DataFrame:
    """(key, kind, node_path, parent_path) of every column of the slices; a column without selector gives no row, a missing ctype counts as ''."""
    cols = shred(df, [key], columns).where(F.col("selector").isNotNull())
    return cols.select(
        key,
        F.lit("column").alias("kind"),
        F.concat("selector", F.lit(":"), F.coalesce("ctype", F.lit(""))).alias("node_path"),
        F.col("selector").alias("parent_path"),
    )
