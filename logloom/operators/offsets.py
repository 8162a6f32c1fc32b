"""Dense offsets: 0, 1, 2, ... within each partition of a topic, in the order of a sequence number.

A plain row_number would put a whole partition into one task. Here the sequence is cut into blocks; rows are
numbered inside (topic, partition, block) and the counts of earlier blocks are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers of one block; a task numbers at most so many rows of a partition if they are unique.
BLOCK = 1_000_000


def with_offsets(records: DataFrame, by: list[str], seq: str, block: int = BLOCK, start: Column | None = None) -> DataFrame:
    """records with ``offset``. start: first offset of each row's partition (0 by default)."""
    cut = records.withColumn("__block", F.floor(F.col(seq) / block))
    counts = cut.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(seq)) - 1
    numbered = cut.withColumn("__row", inside).join(base, [*by, "__block"])
    first = F.lit(0) if start is None else start
    return numbered.withColumn("offset", (F.col("__base") + F.col("__row") + first).cast("long")).drop("__block", "__row", "__base")


def segment_base(offset: Column, segment_max: int | Column) -> Column:
    return (F.floor(offset / segment_max) * segment_max).cast("long")


def segment_id(base: Column) -> Column:
    return F.lpad(base.cast("string"), 20, "0")
