"""Routing of records and batches to partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import hashing
from logloom.operators import offsets


def keyed(key: Column, partitions: int) -> Column:
    return hashing.fnv1a_mod(key, partitions)


def batches(records: DataFrame, partitions: int, batch: str = "batch_id", seq: str = "seq", key: str = "key") -> DataFrame:
    """batch, partition, n. A batch goes where its first record's key goes; batches without one take turns.

    The turn is a running count over keyless batches only, one row a batch, numbered by blocks of batch numbers.
    """
    first = records.groupBy(batch).agg(F.min_by(F.struct(F.col(key).alias("key")), seq).alias("first"), F.count("*").alias("n"))
    first = first.select(batch, "n", F.col("first.key").alias("first_key"))
    keyless = offsets.with_offsets(first.where("first_key is null").withColumn("__all", F.lit(0)), ["__all"], batch)
    keyless = keyless.select(batch, (F.col("offset") % partitions).cast("int").alias("partition"), "n")
    return first.where("first_key is not null").select(batch, keyed(F.col("first_key"), partitions).alias("partition"), "n").unionByName(keyless)
