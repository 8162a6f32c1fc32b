"""Sequential operators: each key's rows in order pass through a state.

Rows are dealt by key and sorted inside their task; the state of one key at a time is held, so memory doesn't grow
with a key's rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(rows: DataFrame, key: str, order: list[str], reads: list[str], start: Callable[[], object], step: Callable[..., tuple], keep: list[str], out: str) -> DataFrame:
    """step(state, *values of ``reads``) changes the state and returns the values of ``out``; columns of ``keep`` stay beside them.

    Rows of a key come in the given order. Columns go through as they are; only what a step reads becomes values.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = StructType([rows.schema[c] for c in keep])
    made = StructType.fromDDL(out)
    kinds = [f.type for f in to_arrow_schema(made)]
    names = [*keep, *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, None, True
        for batch in batches:
            results = []
            for own, *values in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in range(1, len(reads) + 1)), strict=True):
                if first or own != now:
                    now, state, first = own, start(), False
                results.append(step(state, *values))
            columns = [pa.array(c, k) for c, k in zip(zip(*results, strict=True), kinds, strict=True)] if results else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[len(reads) + 1 :], *columns], names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.repartition(n, key).sortWithinPartitions(key, *order).select(key, *reads, *keep)
    return sent.mapInArrow(run, StructType(kept.fields + made.fields))


class Bucket:
    """Token bucket in micro-tokens: ``per_token`` microseconds refill one token."""

    def __init__(self, capacity: int, per_token: int):
        self.most, self.per_token = capacity * per_token, per_token
        self.tokens, self.last = self.most, None

    def take(self, at: int, n: int = 1) -> bool:
        if self.last is not None:
            self.tokens = min(self.most, self.tokens + max(0, at - self.last))
        self.last = at
        if self.tokens >= n * self.per_token:
            self.tokens -= n * self.per_token
            return True
        return False


class Breaker:
    """Opens after ``threshold`` failures in a row or a failed trial; lets trials pass after ``cooldown`` microseconds."""

    def __init__(self, threshold: int, cooldown: int):
        self.threshold, self.cooldown = threshold, cooldown
        self.state, self.failures, self.opened = "closed", 0, 0

    def call(self, at: int, failed: bool) -> bool:
        if self.state == "open" and at - self.opened >= self.cooldown:
            self.state = "half_open"
        if self.state == "open":
            return False
        if not failed:
            self.state, self.failures = "closed", 0
            return True
        self.failures += 1
        if self.failures >= self.threshold or self.state == "half_open":
            self.state, self.opened = "open", at
        return True


class Bulkhead:
    """At most ``capacity`` intervals at a time; one that ends at t is over at t."""

    def __init__(self, capacity: int):
        self.capacity, self.ends = capacity, []

    def enter(self, begin: int, end: int) -> bool:
        while self.ends and self.ends[0] <= begin:
            heapq.heappop(self.ends)
        if len(self.ends) >= self.capacity:
            return False
        heapq.heappush(self.ends, end)
        return True
