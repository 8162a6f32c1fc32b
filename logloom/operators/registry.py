"""Connector registry as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake(name: Column) -> Column:
    """Display names to the names of the query surface."""
    return F.replace(name, F.lit("-"), F.lit("_"))


def statuses(versions: DataFrame) -> DataFrame:
    """Last status of each connector."""
    fields = ["kind", "guarantee", "running", "processed", "dead_lettered", "checkpoint"]
    last = versions.groupBy("id").agg(F.max_by(F.struct(*fields), "version").alias("s")).select("id", "s.*")
    return last.withColumn("guarantee", snake(F.col("guarantee")))
