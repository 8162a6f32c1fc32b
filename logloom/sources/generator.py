"""Deterministic record generator as a Spark data source, batch and streaming.

Keys come from a xorshift64 sequence (shifts 13, 7, 17). The step is linear over bits, so a partition of the source
jumps to its first record by powers of the step's bit matrix and all partitions generate at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MASK = 2**64 - 1
SCHEMA = "n long, batch long, key string, payload binary"
ROWS = 10_000


def step(x: int) -> int:
    x ^= x << 13 & MASK
    x ^= x >> 7
    return x ^ (x << 17 & MASK)


@functools.lru_cache(maxsize=64)
def _power(k: int) -> tuple[int, ...]:
    """Images of the 64 single bits after 2 ** k steps."""
    if k == 0:
        return tuple(step(1 << i) for i in range(64))
    half = _power(k - 1)
    return tuple(_apply(half, image) for image in half)


def _apply(matrix: tuple[int, ...], x: int) -> int:
    out = 0
    while x:
        low = x & -x
        out ^= matrix[low.bit_length() - 1]
        x ^= low
    return out


def jump(state: int, steps: int) -> int:
    k = 0
    while steps:
        if steps & 1:
            state = _apply(_power(k), state)
        steps >>= 1
        k += 1
    return state


def records(first: int, end: int, key_space: int, payload_bytes: int, seed: int, batch: int) -> Iterator[tuple[int, int, str, bytes]]:
    """Records first .. end - 1, counted from 0; their n counts from 1."""
    space, state = max(key_space, 1), jump(seed | 1, first)
    for i in range(first, end):
        state = step(state)
        key = state % space
        yield i + 1, i // batch, f"key-{key}", f"record-{key}-{i + 1}".encode().ljust(max(payload_bytes, 1), b".")


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Reader:
    def __init__(self, options: dict):
        get = lambda name, default: int(options.get(name, default))
        self.total, self.batch, self.space = get("total", 1000), max(1, get("batchsize", 500)), get("keyspace", 1000)
        self.payload, self.seed, self.parts = get("payloadbytes", 32), get("seed", 0xC0FFEE), max(1, get("partitions", 8))

    def ranges(self, first: int, end: int) -> list[_Range]:
        width = -(-max(end - first, 1) // self.parts)
        return [_Range(a, min(a + width, end)) for a in range(first, end, width)]

    def rows(self, part: _Range) -> Iterator[pa.RecordBatch]:
        for begin in range(part.first, part.end, ROWS):
            cols = zip(*records(begin, min(begin + ROWS, part.end), self.space, self.payload, self.seed, self.batch), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["n", "batch", "key", "payload"])


class GeneratorReader(_Reader, DataSourceReader):
    def partitions(self):
        return self.ranges(0, self.total) or [_Range(0, 0)]

    def read(self, partition):
        return self.rows(partition)


class GeneratorStreamReader(_Reader, DataSourceStreamReader):
    """Polls at most a batch a trigger, until ``total`` records are out; drain: all that is left at once."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.drain = str(options.get("drain", "false")).lower() == "true"
        self.at = 0

    def initialOffset(self):
        return {"n": 0}

    def latestOffset(self):
        self.at = self.total if self.drain else min(self.at + self.batch, self.total)
        return {"n": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["n"])
        return self.ranges(start["n"], end["n"])

    def read(self, partition):
        return self.rows(partition)

    def commit(self, end):
        pass

    def stop(self):
        pass


class GeneratorSource(DataSource):
    """spark.read / readStream.format("logloom_generator"); options total, batchSize, keySpace, payloadBytes, seed, partitions, drain."""

    @classmethod
    def name(cls):
        return "logloom_generator"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GeneratorReader(self.options)

    def streamReader(self, schema):
        return GeneratorStreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(GeneratorSource)
