"""Segment images in the record framing: logs out, logs in, and recovery of cut-off tails."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import framing
from logloom.operators import offsets

RECORDS = "segment string, offset long, timestamp timestamp_ntz, key string, payload binary"


def images(log: DataFrame, segment_max: int) -> DataFrame:
    """segment, data: each segment of a log as one file's bytes. A segment has ``segment_max`` records at most."""
    base = offsets.segment_base(F.col("offset"), segment_max)
    name = F.concat(F.col("topic"), F.lit("/"), F.col("partition").cast("string"), F.lit("/"), offsets.segment_id(base), F.lit(".log"))
    framed = log.select(name.alias("segment"), "offset", framing.frame_hex(F.col("offset"), F.col("timestamp"), F.col("key"), F.col("payload")).alias("digits"))
    rows = framed.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("offset", "digits"))).alias("rows"))
    return rows.select("segment", F.unhex(F.array_join("rows.digits", "")).alias("data"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """segment, data of all .log files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(folder)
    return files.select(F.col("path").alias("segment"), F.col("content").alias("data"))


def decode(segments: DataFrame) -> DataFrame:
    """Whole records of each segment; a cut-off tail is left out."""
    zero = datetime.datetime(1970, 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.timestamp("us"), pa.string(), pa.binary())
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, _ = framing.parse(data.as_py() or b"")
                cols = [[name] * len(rows), [r[0] for r in rows], [zero + datetime.timedelta(milliseconds=r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["segment", "offset", "timestamp", "key", "payload"])

    return segments.select("segment", "data").mapInArrow(run, RECORDS)


def recover(segments: DataFrame) -> DataFrame:
    """segment, records, valid_bytes, data cut back to its whole records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, *framing.parse(data or b""), data or b"") for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3][: r[2]] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["segment", "records", "valid_bytes", "data"])

    return segments.select("segment", "data").mapInArrow(run, "segment string, records long, valid_bytes long, data binary")
