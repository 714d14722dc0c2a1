"""Building blocks that keep plans safe at scale: staged tables, checked broadcasts, skew-proof joins.

Nothing here collects data whose size grows with the input. What reaches the
driver or a broadcast is bounded by a parameter and the bound is checked first.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a checked broadcast may hold at most ...
BROADCAST_ROWS = 200_000
#: ... and bytes of values in them.
BROADCAST_BYTES = 64 * 2**20
#: A key is hot when it holds more than one row in HOT_SHARE; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000

_own_dir: str | None = None
_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: spark.checkpoint.dir where the session names one; else, in local mode only, a fresh local folder."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="setwise-")
    return _own_dir


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors.

    The files go when discard() is called on the result or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return staged_at(spark, path, df.schema)


def staged_at(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table written below the shared folder, which goes like one of stage()."""
    out = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    out._setwise_path = path
    _staged[path] = spark
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a staged table that no later plan reads."""
    path = getattr(df, "_setwise_path", None)
    if path and _staged.pop(path, None) is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_staged.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def _bytes_of(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.length(F.to_json(F.struct(c)))
    return F.lit(8)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of values) of a table."""
    each = sum((F.coalesce(_bytes_of(f), F.lit(0)).cast("bigint") for f in df.schema.fields), F.lit(0).cast("bigint"))
    n, total = df.agg(F.count("*"), F.sum(each)).collect()[0]
    return n, total or 0


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when df has at most `rows` rows of at most `size` bytes together; of a table that isn't staged it reads no more than rows + 1 rows."""
    n, total = measure(df if hasattr(df, "_setwise_path") else df.limit(rows + 1))
    return n <= rows and total <= size


def _can_hash(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _can_hash(t.elementType)
    if isinstance(t, T.StructType):
        return all(_can_hash(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS, *, fits: bool | None = None) -> DataFrame:
    """left JOIN right on the columns `on`, where right has one row per key and a key may hold any share of left.

    A right side of at most `rows` rows and BROADCAST_BYTES is broadcast. Beyond that
    one shuffle join is made, in which the hot keys of left (fewer than HOT_SHARE by
    definition) and its rows without a key are spread over as many salts as there are
    shuffle partitions; the right rows of hot keys are repeated for each salt.
    how: 'left' or 'inner'; fits: whether right can be broadcast, where that was measured before.
    """
    if fits or (fits is None and rows and fits_broadcast(right, rows)):
        return left.join(F.broadcast(right), on, how)
    counts = stage(left.select(*on).dropna().groupBy(*on).count(), "counts")
    total = counts.agg(F.sum("count")).collect()[0][0] or 0
    hot = stage(counts.where(F.col("count") * HOT_SHARE > F.lit(total)).select(*on, F.lit(True).alias("_hot")), "hot")
    discard(counts)
    n = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyless = F.lit(False)
    for c in on:
        keyless = keyless | F.col(c).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema.fields if _can_hash(f.dataType)]), F.lit(n)).cast("int")
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot") | keyless, spread).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def key_text(c: Column) -> Column:
    """An identifier as compared: without white space at both ends, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s ﻿]+|[\s ﻿]+$", ""))


def prefix(df: DataFrame, order: list[Column], aggs: dict[str, tuple[str, Column]], parts: int | None = None, by: list[str] | None = None) -> DataFrame:
    """df with running aggregates in a total order, without a single-partition window; by: in the order of each key by itself.

    aggs: new column -> (function, column), function one of sum, count, max, min; each
    holds the aggregate of all rows (of the key) strictly before the row in the order
    (null, or 0 for sum and count, for the first). Rows are range-partitioned once, by
    key and order, and staged; a key may hold any share of them. What is carried over
    are the totals of keys that began in an earlier part: fewer than two rows a part.
    `order` are plain columns, ascending with nulls first (negate numbers to descend).
    Ties in it get an arbitrary but fixed order; make it total where that matters.
    """
    spark = df.sparkSession
    by = by or []
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = {f"_o{i}": o for i, o in enumerate(order)}
    vals = {f"_v_{k}": v for k, (_, v) in aggs.items()}
    keyed = df.withColumns({**cols, **vals}).repartitionByRange(n, *by, *cols).withColumn("_part", F.spark_partition_id())
    keyed = stage(keyed, "prefix")
    fn = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    totals = keyed.groupBy("_part", *by).agg(*[fn[f](f"_v_{k}").alias(f"_t_{k}") for k, (f, _) in aggs.items()])
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    earlier = Window.partitionBy(*by).orderBy("_part")
    totals = totals.withColumn("_nth", F.row_number().over(earlier))
    totals = totals.select("_part", *by, "_nth", *[merge[f](f"_t_{k}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_b_{k}") for k, (f, _) in aggs.items()]).where("_nth > 1").drop("_nth")
    inside = Window.partitionBy("_part", *by).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumns({f"_w_{k}": fn[f](f"_v_{k}").over(inside) for k, (f, _) in aggs.items()}).join(F.broadcast(totals), ["_part", *by], "left")
    for k, (f, _) in aggs.items():
        a, b = F.col(f"_b_{k}"), F.col(f"_w_{k}")
        both = {"sum": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "count": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest(a, b), "min": F.least(a, b)}[f]
        out = out.withColumn(k, both)
    return out.drop("_part", *cols, *vals, *[f"_b_{k}" for k in aggs], *[f"_w_{k}" for k in aggs])
