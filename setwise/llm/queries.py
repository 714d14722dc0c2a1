"""Queries of the training-data problems on texts (7 to 9). SQL can't state them; tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leakage, packing, truncation


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """All texts in containers of each window."""
    return packing.pack_windows(table(spark, d, "documents"), table(spark, d, "context_windows"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """(window_name, containers, lower_bound, filled): how close each packing is to the fewest containers possible."""
    packed, plans = packing.pack_windows(table(spark, d, "documents"), table(spark, d, "context_windows"))
    bounds = spark.createDataFrame([(n, p.capacity, p.lower_bound) for n, p in plans], "window_name string, capacity int, lower_bound bigint")
    per = packed.where("n_tokens > 0").groupBy("window_name").agg(F.max("container_id").alias("m"), F.sum("n_tokens").alias("tokens"))
    return per.join(F.broadcast(bounds), "window_name").select(
        "window_name", (F.col("m") + 1).alias("containers"), "lower_bound", (F.col("tokens") / ((F.col("m") + 1) * F.col("capacity"))).alias("filled")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, suite, posts): the leaked items and how many posts carry each."""
    found = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("posts"))
    return found.join(table(spark, d, "eval_items").groupBy("item_id").agg(F.min("suite").alias("suite")), "item_id").select("item_id", "suite", "posts")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its posts off."""
    docs = table(spark, d, "documents")
    return truncation.truncation_report(docs, truncation.truncated(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_packing, p7_report, p8_found, p8_items, p9_found, p9_report)}
ORACLE: dict[str, str] = {}
