"""Retention in closed form: what is left of a partition after ``n`` appended records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segmented_start(n: Column, segment_max: int, max_records: int) -> Column:
    """First offset if whole head segments go while more than ``max_records`` stay and more than one segment is left."""
    if not max_records:
        return F.lit(0).cast("long")
    last = F.floor((F.greatest(n, F.lit(1)) - 1) / segment_max) * segment_max
    need = F.ceil(F.greatest(n - max_records, F.lit(0)) / segment_max) * segment_max
    return F.least(last, need).cast("long")


def exact_start(n: Column, max_records: int) -> Column:
    return (F.greatest(n - max_records, F.lit(0)) if max_records else F.lit(0)).cast("long")


def segmented(bounds: DataFrame, segment_max: int, max_records: int) -> DataFrame:
    """bounds: partition, n. Adds start_offset, high_watermark, retained, segments."""
    n, start = F.col("n"), segmented_start(F.col("n"), segment_max, max_records)
    last = F.floor((n - 1) / segment_max) * segment_max
    return bounds.select("partition", start.alias("start_offset"), n.alias("high_watermark"), (n - start).alias("retained"), F.when(n > 0, (last - start) / segment_max + 1).otherwise(0).cast("long").alias("segments"))


def exact(bounds: DataFrame, segment_max: int, max_records: int) -> DataFrame:
    """Single records go from the head; segments are counted as rolled, never fewer."""
    n, start = F.col("n"), exact_start(F.col("n"), max_records)
    return bounds.select("partition", start.alias("start_offset"), n.alias("high_watermark"), (n - start).alias("retained"), F.ceil(n / segment_max).cast("long").alias("segments"))


def appends(batches: DataFrame, segment_max: int, max_records: int) -> DataFrame:
    """Per append batch, in order: base_offset, last_offset, count and truncated_to. batches: batch_id, partition, n."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("partition").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = batches.withColumn("before", before).withColumn("after", F.col("before") + F.col("n"))
    was, now = segmented_start(F.col("before"), segment_max, max_records), segmented_start(F.col("after"), segment_max, max_records)
    return rows.select("batch_id", "partition", F.col("before").cast("long").alias("base_offset"), (F.col("after") - 1).cast("long").alias("last_offset"), F.col("n").cast("long").alias("count"), F.when(now > was, now).alias("truncated_to"))
