"""Reads by offset. Offsets are dense, so a limit becomes an upper bound that the scan can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows a row a partition may be broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000


def narrow(bounds: DataFrame) -> DataFrame:
    """The side of a join that has a row a partition: with a broadcast hint if it is small, counted."""
    return F.broadcast(bounds) if bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else bounds


def clamped(most: int, fetch_max: int) -> int:
    return min(max(most, 1), fetch_max)


def fetch(log: DataFrame, partition: int, start: int, most: int, first_offset: int = 0, segment_max: int | None = None) -> DataFrame:
    """Records of a partition from ``start`` (or the first retained offset), at most ``most``, by offset."""
    begin = max(start, first_offset)
    rows = log.where((F.col("partition") == partition) & (F.col("offset") >= begin) & (F.col("offset") < begin + most))
    if segment_max and "segment_base" in log.columns:  # lets the scan skip whole segment folders
        rows = rows.where((F.col("segment_base") >= begin // segment_max * segment_max) & (F.col("segment_base") < begin + most))
    return rows.orderBy("offset").limit(most)


def head(records: DataFrame, seq: str, start: int, most: int) -> DataFrame:
    """Of one partition's records, not numbered yet, those with offsets from ``start`` on, at most ``most``, with ``offset``.

    Each task keeps its first start + most rows; only these meet, and only these are numbered.
    """
    first = records.orderBy(seq).limit(start + most)
    numbered = first.withColumn("offset", (F.row_number().over(Window.orderBy(seq)) - 1).cast("long"))  # start + most rows
    return numbered.where(F.col("offset") >= start).orderBy("offset")


def cursors(log: DataFrame, requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """partition, from_offset, n, next_offset, high_watermark of each request (partition, from_offset, max).

    bounds: partition, start_offset, high_watermark. All follows from the bounds, as offsets are dense; the log's
    rows aren't read.
    """
    begin = F.greatest("from_offset", "start_offset")
    n = F.greatest(F.lit(0), F.least(F.col("max"), F.col("high_watermark") - begin))
    return requests.join(bounds, "partition").select("partition", "from_offset", n.cast("long").alias("n"), F.when(n > 0, begin + n).otherwise(begin).cast("long").alias("next_offset"), "high_watermark")


def request_code(partition: Column, partitions: Column) -> Column:
    """partitions: null for an unknown topic."""
    return F.when(partitions.isNull(), "TOPIC_NOT_FOUND").when((partition < 0) | (partition >= partitions), "PARTITION_OUT_OF_RANGE").otherwise("OK")
