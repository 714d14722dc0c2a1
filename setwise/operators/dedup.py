"""One copy of messages that were delivered more than once (problem 5).

Only identifier, delivery order and file-row position are shuffled. The winners
become one bitmap per file and block of rows, and the wide payloads are then read
in place: a row stays if its bit is set. No payload column is ever shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import shared_dir, stage, staged_at
from .incremental import message_offset

#: Rows of a file that share one bitmap (Spark's bitmap functions fix it).
BLOCK = 32_768
#: Bitmaps of 4 KB each that one broadcast may hold (64 MB, over 500 million rows); files beyond it form further groups.
BROADCAST_BITMAPS = 16_384


def read_positions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The Parquet table with the hidden columns _file (hash of the file's path) and _row (position in the file)."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def _no_collision(spark: SparkSession, df: DataFrame) -> None:
    """Two files of one hash would share bitmaps; the file list, which the driver holds anyway, shows whether any do."""
    import xxhash

    files = df.inputFiles()
    hashes = {xxhash.xxh64_intdigest(f.encode(), seed=42) for f in files}
    if len(hashes) != len(set(files)):
        raise ValueError("two file paths have one 64-bit hash; rename a file")


def winners(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Bitmaps (_file, _block, _bits) of the first row of each key by `order`; rows with a null key all win.

    rows has _file and _row. The first row is a partial aggregate, so a key that
    holds any share of the rows is reduced before the shuffle.
    """
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    keyed = rows.withColumn("_none", null_key)
    first = (
        keyed.where("not _none")
        .groupBy(*keys)
        .agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("_file"), F.col("_row"))).alias("w"))
        .select("w._file", "w._row")
    )
    positions = first.unionByName(keyed.where("_none").select("_file", "_row"))
    return positions.groupBy("_file", F.floor(F.col("_row") / BLOCK).cast("bigint").alias("_block")).agg(F.bitmap_construct_agg((F.col("_row") % BLOCK)).alias("_bits"))


def _bit() -> Column:
    """Is the row's bit set in _bits?"""
    at = (F.col("_row") % BLOCK).cast("int")
    byte = F.ascii(F.decode(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    return F.coalesce(F.bit_get(byte, at % 8) == 1, F.lit(False))


def file_groups(bitmaps: DataFrame) -> int:
    """The number of hash classes of files at which each class's bitmaps fit one broadcast (or the class is a single file)."""
    groups = 1
    while True:
        per = bitmaps.groupBy(F.pmod("_file", F.lit(groups))).agg(F.count("*").alias("n"), F.countDistinct("_file").alias("files"))
        if per.where((F.col("n") > BROADCAST_BITMAPS) & (F.col("files") > 1)).isEmpty():
            return groups
        groups *= 2


def _marked(payload: DataFrame, bitmaps: DataFrame, surplus: bool) -> DataFrame:
    at = payload.withColumn("_block", F.floor(F.col("_row") / BLOCK).cast("bigint"))
    joined = at.join(F.broadcast(bitmaps), ["_file", "_block"], "left")
    return joined.where(~_bit() if surplus else _bit()).drop("_file", "_row", "_block", "_bits")


def write_deduplicated(payload: DataFrame, bitmaps: DataFrame, out: str, surplus: bool = False) -> int:
    """Write the winners to `out`, file group by file group; returns the number of groups.

    Groups are hash classes of files; each is written by a job of its own, which reads
    only the files of the group (the class is a filter on the path, so other files are
    not opened) and broadcasts only their bitmaps.
    """
    groups = file_groups(bitmaps)
    for g in range(groups):
        part = F.pmod("_file", F.lit(groups)) == g
        _marked(payload.where(part), bitmaps.where(part), surplus).write.mode("overwrite" if g == 0 else "append").parquet(out)
    return groups


def apply_winners(payload: DataFrame, bitmaps: DataFrame, surplus: bool = False) -> DataFrame:
    """The rows of payload (with _file and _row) whose bit is set, or, with surplus, is not.

    bitmaps: staged. A row meets its bitmap where its file is read, whatever the number
    of rows: where the bitmaps of all files don't fit one broadcast, the result is
    written file group by file group to the shared folder. No payload is shuffled.
    """
    if file_groups(bitmaps) == 1:
        return _marked(payload, bitmaps, surplus)
    out = f"{shared_dir(payload.sparkSession)}/staged/groups-{uuid.uuid4().hex}"
    write_deduplicated(payload, bitmaps, out, surplus)
    return staged_at(payload.sparkSession, out)


def message_winners(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positions, bitmaps): the relay events with their positions, and the staged bitmaps of the one delivery of each message to keep.

    A message is agent_id with its offset (see message_offset); kept is the
    earliest delivered_at, among equals the smallest delivery_id. Deliveries
    without agent or offset name no message and are all kept; a null delivered_at
    counts as earliest only where all are null; empty tables give empty results.
    """
    events = read_positions(spark, path)
    _no_collision(spark, events)
    rows = events.select("agent_id", message_offset().alias("_offset"), "delivered_at", "delivery_id", "_file", "_row")
    order = [F.col("delivered_at").isNull(), F.col("delivered_at"), F.col("delivery_id")]
    return events, stage(winners(rows, ["agent_id", "_offset"], order), "bitmaps")


def surplus_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """(delivery_id) of every delivery that is not the one to keep."""
    events, bitmaps = message_winners(spark, path)
    return apply_winners(events.select("delivery_id", "_file", "_row"), bitmaps, surplus=True).distinct()


def deduplicated_messages(spark: SparkSession, path: str) -> DataFrame:
    """The relay events, one delivery a message, with all their columns; the wide columns are read once and not shuffled."""
    events, bitmaps = message_winners(spark, path)
    return apply_winners(events, bitmaps)
