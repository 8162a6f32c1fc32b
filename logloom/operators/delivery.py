"""Sink delivery as plans over rows: outcomes, dead letters, batch reports, checkpoints, waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import fetch


def poisoned(offset: Column, fail_every: int) -> Column:
    """Offsets at which the failing sink always fails; offset 0 is one."""
    return offset % fail_every == 0 if fail_every else F.lit(False)


def outcome(offset: Column, fail_every: int) -> Column:
    return F.when(poisoned(offset, fail_every), "permanent").otherwise("delivered")


def dead_letters(log: DataFrame, connector: str, fail_every: int, max_attempts: int) -> DataFrame:
    """Failed records. The key and the record's time aren't kept; attempts is always the bound."""
    reason = F.concat(F.lit("permanent failure: poison record at offset "), F.col("offset").cast("string"))
    return log.where(poisoned(F.col("offset"), fail_every)).select(F.lit(connector).alias("connector"), "topic", "partition", "offset", "payload", reason.alias("reason"), F.lit(max(max_attempts, 1)).cast("int").alias("attempts"))


def reports(log: DataFrame, batch_size: int, fail_every: int) -> DataFrame:
    """One row for each delivered batch of a partition."""
    failed = F.count_if(poisoned(F.col("offset"), fail_every))
    batch = F.floor(F.col("offset") / batch_size).alias("batch_no")
    return log.groupBy("partition", batch).agg(F.count("*").alias("polled"), (F.count("*") - failed).alias("delivered"), failed.alias("dead_lettered"), (F.max("offset") + 1).alias("checkpoint"))


def latest(versions: DataFrame, keys: list[str], value: str, version: str = "version") -> DataFrame:
    """Last write of each key."""
    return versions.groupBy(*keys).agg(F.max_by(value, version).alias(value))


def resumed(log: DataFrame, checkpoints: DataFrame, connector: str) -> DataFrame:
    """Records at or after the connector's checkpoint; from the start where there is none."""
    own = checkpoints.where(F.col("connector") == connector).select("partition", F.col("offset").alias("from_offset"))
    return log.join(fetch.narrow(own), "partition", "left").where(F.col("offset") >= F.coalesce("from_offset", F.lit(0)))


def backoff_bounds(attempt: Column, base_ms: int, max_ms: int) -> tuple[Column, Column]:
    """Least and most milliseconds of the wait after an attempt, jitter included."""
    full = F.least(F.lit(base_ms) * F.pow(F.lit(2), F.least(attempt, F.lit(16))), F.lit(max_ms).cast("double"))
    return (full / 2).cast("double"), full.cast("double")


def retryable(error_class: Column) -> Column:
    return error_class.isin(*schemas.RETRYABLE)
