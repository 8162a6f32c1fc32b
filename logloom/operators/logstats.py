"""Statistics of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators import offsets


def segments(log: DataFrame, segment_max: int, by: list[str]) -> DataFrame:
    base = offsets.segment_base(F.col("offset"), segment_max)
    rows = log.withColumn("segment_base", base).groupBy(*by, "segment_base").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("n"))
    return rows.withColumn("segment_id", offsets.segment_id(F.col("segment_base")))


def recovered(segments_left: DataFrame, by: list[str]) -> DataFrame:
    """State of each partition out of its segments alone, as after a restart."""
    return segments_left.groupBy(*by).agg(F.min("segment_base").alias("start_offset"), F.max(F.col("segment_base") + F.col("n")).alias("next_offset"), F.count("*").alias("segments"))


def partitions(counts: DataFrame, segment_max: int) -> DataFrame:
    """topic, partition, start_offset, high_watermark, segments. counts: topic, partition, n."""
    return counts.select("topic", "partition", F.lit(0).cast("long").alias("start_offset"), F.col("n").alias("high_watermark"), F.ceil(F.col("n") / segment_max).cast("long").alias("segments"))


def totals(counts: DataFrame, segment_max: int) -> DataFrame:
    each = F.ceil(F.col("n") / segment_max)
    return counts.agg(F.countDistinct("topic").alias("topics"), F.count("*").alias("partitions"), F.sum("n").alias("records"), F.sum(each).cast("long").alias("segments"), F.sum("n").alias("produced_total"))
