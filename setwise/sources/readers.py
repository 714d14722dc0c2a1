"""Sources: JSON in value or stream style, CSV with inferred types, JDBC tables, Kafka topics, files of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SetwiseError
from ..scale import stage

MODES = ("all_possible", "all_or_nothing", "stop_on_first_error")


def sniff(spark: SparkSession, file: str, content_type: str | None = None) -> str:
    """'json' or 'csv', by content type, else by the first sign of the file."""
    if content_type:
        main = content_type.partition(";")[0].strip().lower()
        if main in ("application/json", "application/x-json-stream", "text/json"):
            return "json"
        if main in ("text/csv", "text/tab-separated-values"):
            return "csv"
        raise SetwiseError(f"unknown content type: {content_type}")
    head = spark.read.text(file).where(F.trim("value") != "").limit(1).collect()
    return "json" if head and head[0].value.lstrip("﻿ \t")[:1] in ("{", "[") else "csv"


def _settle(good: DataFrame, bad: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    if mode not in MODES:
        raise SetwiseError(f"unknown error mode: {mode}")
    if mode != "all_possible" and bad.limit(1).count():
        if mode == "all_or_nothing":
            return good.limit(0), bad
        first = bad.agg(F.min("line_no").alias("stop"))
        return good.crossJoin(F.broadcast(first)).where(F.col("line_no") < F.col("stop")).drop("stop"), bad
    return good, bad


def read_json(spark: SparkSession, file: str, style: str = "stream", mode: str = "all_possible", schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of a JSON file, one value a line, or one array over the whole file in value style.

    Rows have the column value (VARIANT), or, with a schema, its columns. style
    'value' gives each element of an array at the root as a row, 'stream' keeps each
    value whole. mode: what to do about lines that don't parse (line_no, raw, reason).
    """
    if style not in ("value", "stream"):
        raise SetwiseError(f"unknown style: {style}")
    if style == "value":
        lines = spark.read.text(file, wholetext=True).select(F.lit(1).cast("bigint").alias("line_no"), F.col("value").alias("raw"))
    else:
        lines = spark.read.text(file).select((F.monotonically_increasing_id() + 1).alias("line_no"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    parsed = lines.withColumn("raw", F.regexp_replace("raw", "^﻿", ""))
    if style == "value":  # where the first line is a value by itself, the file is read line by line
        first = F.try_parse_json(F.split(F.ltrim("raw"), "\n")[0])
        parsed = parsed.withColumn("value", F.when(first.isNull(), F.try_parse_json("raw")))
        by_line = parsed.where(first.isNotNull()).select(F.posexplode(F.split("raw", "\n")).alias("no", "raw")).where(F.trim("raw") != "")
        by_line = by_line.select((F.col("no") + 1).cast("bigint").alias("line_no"), "raw").withColumn("value", F.try_parse_json("raw"))
        parsed = parsed.where(first.isNull()).unionByName(by_line)
    else:
        parsed = parsed.withColumn("value", F.try_parse_json("raw"))
    bad = parsed.where("value is null").select("line_no", "raw", F.lit("not JSON").alias("reason"))
    good = parsed.where("value is not null").select("line_no", "value")
    if style == "value":
        arr = F.when(F.schema_of_variant("value").startswith("ARRAY"), F.try_variant_get("value", "$", "array<variant>"))
        good = good.select("line_no", F.explode(F.coalesce(arr, F.array("value"))).alias("value"))
    good, bad = _settle(good, bad, mode)
    if schema is not None:
        return good.select(F.from_json(F.to_json("value"), schema).alias("v")).select("v.*"), bad
    return good.select("value"), bad


def csv_type(df: DataFrame, c: str) -> str:
    """'nothing', 'number' or 'string': the least type that holds all values of a column (blank is null)."""
    v = F.trim(F.col(f"`{c}`"))
    row = df.agg(F.count(F.when(v != "", 1)).alias("n"), F.count(F.when((v != "") & v.try_cast("double").isNull(), 1)).alias("s")).collect()[0]
    return "nothing" if not row.n else "string" if row.s else "number"


def read_csv(spark: SparkSession, file: str, delimiter: str = ",", quote: str = '"', escape: str = '"', mode: str = "all_possible", columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of a CSV file; columns that the header names twice become one array column.

    Types are found in one pass over the batch: numbers where all values are, else
    text; blank is null. Lines with a wrong number of fields fail.
    """
    if any(len(x) != 1 for x in (delimiter, quote, escape)):
        raise SetwiseError("delimiter, quote and escape must be single signs")
    names = columns
    if names is None:
        head = spark.read.option("sep", delimiter).option("quote", quote).option("escape", escape).csv(file).limit(1).collect()
        if not head:
            return spark.createDataFrame([], "value string"), spark.createDataFrame([], "line_no bigint, raw string, reason string")
        names = [x if x is not None else f"column{i + 1}" for i, x in enumerate(head[0])]
    cols = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols] + [T.StructField("_bad", T.StringType())])
    raw = (
        spark.read.schema(schema).option("sep", delimiter).option("quote", quote).option("escape", escape).option("multiLine", True)
        .option("header", columns is None).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).csv(file)
        .withColumn("line_no", F.monotonically_increasing_id() + 1)
    )
    raw = stage(raw, "csv")
    bad = raw.where("_bad is not null").select("line_no", F.col("_bad").alias("raw"), F.lit("columns").alias("reason"))
    good, bad = _settle(raw.where("_bad is null").drop("_bad"), bad, mode)
    flags = good.agg(*[x for c in cols for x in (F.count(F.when(F.trim(c) != "", 1)).alias(f"n{c}"), F.count(F.when((F.trim(c) != "") & F.trim(c).try_cast("double").isNull(), 1)).alias(f"s{c}"))]).collect()[0]
    typed = {c: F.when(F.trim(c) != "", F.trim(c)).try_cast("double") if flags[f"n{c}"] and not flags[f"s{c}"] else F.when(F.trim(c) != "", F.col(c)) for c in cols}
    out = []
    for name in dict.fromkeys(names):
        own = [typed[c] for c, n in zip(cols, names) if n == name]
        same = all(not flags[f"s{c}"] for c, n in zip(cols, names) if n == name)
        out.append((own[0] if len(own) == 1 else F.array(*[o if same else o.cast("string") for o in own])).alias(name))
    return good.select(*out), bad


def read_columns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Column files (parquet or orc): only used columns and matching row groups are read."""
    if fmt not in ("parquet", "orc"):
        raise SetwiseError(f"unknown format: {fmt}")
    return spark.read.format(fmt).load(path)


def read_jdbc(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table of a database; columns and filters are pushed down. partition: (column, least, greatest, parts) reads in parallel."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition:
        column, low, high, n = partition
        r = r.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return r.load()


def read_mongo(spark: SparkSession, uri: str, database: str, collection: str) -> DataFrame:
    """A document collection, where the connector is on the class path."""
    try:
        return spark.read.format("mongodb").option("connection.uri", uri).option("database", database).option("collection", collection).load()
    except Exception as e:  # noqa: BLE001
        raise SetwiseError("the MongoDB connector is not on the class path") from e


def read_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """A topic as a stream of (key, value, offset, timestamp), where the connector is on the class path."""
    try:
        return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    except Exception as e:  # noqa: BLE001
        raise SetwiseError("the Kafka connector is not on the class path") from e
