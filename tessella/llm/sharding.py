"""Sharding: global byte prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): contiguous shards of near equal bytes.

    `docs` needs doc_id and text; other columns are ignored. In doc_id order (null ids first, ties by
    checksum and place in the input) a row's size is the UTF-8 bytes of its text plus 1, a null text having
    none; the row that starts at byte b of T goes to shard floor(b * shards / T). So a shard's bytes
    are off its target by less than one text at either end; a shard within one very long text may be
    empty. slot counts from 0 in each shard. law is `bytes`; grown_shard belongs to another law and is null.
    Repeated rows each keep a place; an empty table gives an empty result.

    Texts never move: they are measured where they are read. Sorted ranges of the measured rows are
    numbered, and only the totals of the ranges, a row for each partition, are summed on the driver.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(data).cast("long").alias("bytes"),
        F.crc32(data).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("size", F.col("bytes") + 1)
    key = ["doc_id", "text_crc32", "row"]
    sized = stage(sized, "sized")
    parts = max(1, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(sized.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()), "ranged")

    totals = sorted(ranged.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    before, at, total_bytes, total_rows = [], 0, sum(r[1] for r in totals), 0
    for part, size, rows in totals:
        before.append((part, at, total_rows))
        at, total_rows = at + size, total_rows + rows
    offsets = docs.sparkSession.createDataFrame(before, "part int, bytes_before long, rows_before long")

    within = Window.partitionBy("part").orderBy(*key)
    placed = ranged.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("place"),
    )
    placed = placed.withColumn("shard", F.floor(F.col("start").cast("decimal(20,0)") * shards / F.lit(max(total_bytes, 1)).cast("decimal(20,0)")).cast("int"))
    placed = stage(placed, "placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row for each shard
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
