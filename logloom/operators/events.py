"""Log events as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_appends(appends: DataFrame, topic: str) -> DataFrame:
    """records_appended and records_truncated rows of an append table."""
    added = appends.select(F.lit("records_appended").alias("kind"), F.lit(topic).alias("topic"), "partition", F.col("base_offset").alias("offset"), F.col("count").cast("int").alias("count"))
    cut = appends.where("truncated_to is not null").select(F.lit("records_truncated").alias("kind"), F.lit(topic).alias("topic"), "partition", F.col("truncated_to").alias("offset"), F.lit(None).cast("int").alias("count"))
    return added.unionByName(cut)


def of_topics(topics: DataFrame) -> DataFrame:
    return topics.select(F.lit("topic_created").alias("kind"), F.col("name").alias("topic"), F.lit(None).cast("int").alias("partition"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("int").alias("count"))


def for_topics(events: DataFrame, topics: list[str]) -> DataFrame:
    """Events of the named topics; an empty list asks for all."""
    return events.where(F.col("topic").isin(topics)) if topics else events
