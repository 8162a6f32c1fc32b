"""Connectors as streaming queries: source to log, log to sink.

Both work on micro-batches. The source appends a batch under its name, so a batch that is run again isn't appended
twice. The sink follows the committed batches of the log and delivers their records one by one, in the order of each
partition's offsets, with retries on the executors; it writes dead letters and a report under the batch's name, and
then its checkpoint (at least once), or claims the batch and writes its checkpoint first (at most once; then no task
that Spark runs again delivers either, so the run fails). A batch that is run again replaces what it wrote. A connector's name goes with one checkpoint folder.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.engine import LogEngine
from logloom.schemas import RETRYABLE, LogError, SinkOptions


class SinkError(Exception):
    """A delivery that failed: ``kind`` is unavailable, transient, not found or permanent."""

    #: What a failure's text begins with.
    WORDS = {"unavailable": "dependency unavailable", "not_found": "not found", "transient": "transient failure", "permanent": "permanent failure"}

    def __init__(self, kind: str, message: str):
        super().__init__(f"{self.WORDS[kind]}: {message}")
        self.kind = kind

    def __reduce__(self):
        return SinkError, (self.kind, str(self).partition(": ")[2])


class FailingSink:
    """Fails for good at every offset that ``fail_every`` divides; 0 never fails."""

    def __init__(self, fail_every: int):
        self.fail_every = fail_every

    def __call__(self, record: dict) -> None:
        if self.fail_every and record["offset"] % self.fail_every == 0:
            raise SinkError("permanent", f"poison record at offset {record['offset']}")


def backoff_ms(attempt: int, options: SinkOptions) -> float:
    full = min(options.base_backoff_ms * 2 ** min(attempt, 16), options.max_backoff_ms)
    return full / 2 + random.random() * full / 2


def attempted(sink: Callable[[dict], None], record: dict, options: SinkOptions) -> tuple[str | None, int]:
    """Why the record could not be delivered, or None, and how often it was tried."""
    most = max(options.max_attempts, 1)
    for attempt in range(most):
        try:
            sink(record)
            return None, attempt + 1
        except SinkError as e:
            if e.kind not in RETRYABLE or attempt + 1 >= most:
                return str(e), attempt + 1
            time.sleep(backoff_ms(attempt, options) / 1000)
    return None, most


def deliver_one(sink: Callable[[dict], None], record: dict, options: SinkOptions) -> str | None:
    """None, or why the record could not be delivered."""
    return attempted(sink, record, options)[0]


def delivered(rows: DataFrame, sink: Callable[[dict], None], options: SinkOptions) -> DataFrame:
    """topic, partition, offset, payload, reason (null: delivered) and tries of each record, after delivery on the executors, a partition's in order.

    At most once: what became of the records of a task that broke off isn't known, so its other attempts deliver none.
    """
    once = options.guarantee == "at_most_once"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if once and TaskContext.get().attemptNumber():
            raise RuntimeError("a delivery that broke off isn't run again (at most once)")
        for batch in batches:
            done = [attempted(sink, r, options) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["topic", "partition", "offset", "payload"]).columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], ["topic", "partition", "offset", "payload", "reason", "tries"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("topic", "partition", "offset", "timestamp", "key", F.col("payload").cast("binary").alias("payload")).repartition(n, "topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    if once:
        ordered = ordered.localCheckpoint()  # no shuffle before the delivery: a stage that is run again would count its attempts anew
    return ordered.mapInArrow(run, "topic string, partition int, offset long, payload binary, reason string, tries int")


def dead_rows(done: DataFrame, connector: str, options: SinkOptions) -> DataFrame:
    """The dead letters among delivered rows."""
    return done.where("reason is not null").select(F.lit(connector).alias("connector"), "topic", "partition", "offset", "payload", "reason", F.lit(max(options.max_attempts, 1)).cast("int").alias("attempts"), F.current_timestamp().alias("failed_at"))


def run_once(engine: LogEngine, connector: str, topic: str, partition: int, sink: Callable[[dict], None], options: SinkOptions = SinkOptions()) -> dict:
    """One batch of a partition: read, deliver, dead-letter, checkpoint. polled = 0: caught up.

    Deliveries and dead letters have the batch's first offset as their name, so a batch that is run again replaces them.
    """
    start = engine.load_checkpoint(connector, topic, partition) or 0
    first, end = engine._bounds(topic, partition)
    begin = max(start, first)
    stop = min(begin + options.batch_size, end)
    if stop <= begin:
        return {"polled": 0, "delivered": 0, "dead_lettered": 0, "checkpoint": start}
    if options.guarantee == "at_most_once":
        engine.save_checkpoint(connector, topic, partition, stop)
    rows = engine.log().where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= begin) & (F.col("offset") < stop))
    path = f"{engine.root}/deliveries/{connector}/{topic}/{partition}/{begin}"
    delivered(rows, sink, options).write.mode("overwrite").parquet(path)
    done = engine.spark.read.parquet(path)
    counts = done.agg(F.count("*").alias("n"), F.count("reason").alias("dead")).first()
    write_dead(engine, done, counts.dead, connector, f"{topic}/{partition}/{begin}", options)
    if options.guarantee == "at_least_once":
        engine.save_checkpoint(connector, topic, partition, stop)
    return {"polled": counts.n, "delivered": counts.n - counts.dead, "dead_lettered": counts.dead, "checkpoint": stop}


def write_dead(engine: LogEngine, done: DataFrame, n: int, connector: str, name: str, options: SinkOptions) -> None:
    """The dead letters of a batch, in place of those that an earlier run of it left."""
    path = f"{engine.root}/dead_letters/connector={connector}/{name}"
    if n or engine._exists(path):
        dead_rows(done, connector, options).write.mode("overwrite").parquet(path)


def drain(engine: LogEngine, connector: str, topic: str, partition: int, sink: Callable[[dict], None], options: SinkOptions = SinkOptions()) -> dict:
    """run_once until it is caught up; the connector's status counts on from what it was."""
    total = {"polled": 0, "delivered": 0, "dead_lettered": 0, "checkpoint": 0}
    while (report := run_once(engine, connector, topic, partition, sink, options))["polled"]:
        for k in ("polled", "delivered", "dead_lettered"):
            total[k] += report[k]
        total["checkpoint"] = report["checkpoint"]
    before = engine.connectors().where(F.col("id") == connector).first()
    sums = [total[k] + (before[c] if before else 0) for k, c in (("delivered", "processed"), ("dead_lettered", "dead_lettered"))]
    engine.report((connector, "sink", options.guarantee.replace("_", "-"), True, *sums, max(total["checkpoint"], before.checkpoint if before else 0)))
    return total


def source_to_log(engine: LogEngine, stream: DataFrame, topic: str, partition: int, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each micro-batch of (seq, key, payload) straight to the log, past the engine's checks."""

    def append(batch: DataFrame, number: int) -> None:
        n = batch.count()
        if n:
            engine.append(topic, partition, batch, n, f"{name}-{number}")

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(append).trigger(**trigger).start()


def log_to_sink(engine: LogEngine, connector: str, topics: list[str] | None, sink: Callable[[dict], None], options: SinkOptions, checkpoint: str, **trigger) -> StreamingQuery:
    """Delivers what is committed to some topics (None: all). At most once: a batch is claimed before its delivery, and one that was claimed isn't delivered again."""

    def save(rows_: DataFrame) -> None:
        """Moves the checkpoints past the rows; never back."""
        ends = rows_.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end")).collect()  # a row a partition
        with engine.lock:
            known = {(r.topic, r.partition): r.offset for r in engine.table("checkpoints").where(F.col("connector") == connector).groupBy("topic", "partition").agg(F.max("offset").alias("offset")).collect()}
            new = [(connector, r.topic, r.partition, r.end, engine._version()) for r in ends if r.end > known.get((r.topic, r.partition), 0)]
            if new:
                engine._add("checkpoints", new)

    def report(done: DataFrame, number: int) -> None:
        """Dead letters and counts of a batch under its name, and the connector's status from the counts of all batches."""
        counts = done.agg(F.count("*").alias("n"), F.count("reason").alias("dead")).first()
        write_dead(engine, done, counts.dead, connector, f"batch={number}", options)
        row = done.sparkSession.createDataFrame([(counts.n - counts.dead, counts.dead)], "delivered long, dead_lettered long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{engine.root}/sink_reports/connector={connector}/batch={number}")

    def tell(spark: SparkSession) -> None:
        reports = f"{engine.root}/sink_reports/connector={connector}"
        if engine._exists(reports):
            total = spark.read.schema("delivered long, dead_lettered long").option("recursiveFileLookup", "true").parquet(reports).agg(F.sum("delivered"), F.sum("dead_lettered")).first()
            with engine.lock:
                last = engine.table("checkpoints").where(F.col("connector") == connector).agg(F.max("offset")).first()[0]
                engine.report((connector, "sink", options.guarantee.replace("_", "-"), True, total[0] or 0, total[1] or 0, last or 0))

    def handle(batches: DataFrame, number: int) -> None:
        spark, batch = engine.spark, engine.rows_of(batches)
        base = f"{engine.root}/claims/{connector}/{number}"
        out = f"{engine.root}/deliveries/{connector}/batch={number}"
        claimed = False
        if options.guarantee == "at_most_once":
            claimed = engine._exists(base)
            if not claimed:
                spark.createDataFrame([(number,)], "batch long").coalesce(1).write.parquet(base)
            save(batch)
        if not claimed:
            delivered(batch, sink, options).write.mode("overwrite").parquet(out)
        elif not engine._exists(f"{out}/_SUCCESS"):
            return  # its delivery broke off: what became of its records isn't known
        done = spark.read.parquet(out)
        report(done, number)
        if options.guarantee == "at_least_once":
            save(done)
        tell(spark)

    stream = engine.batch_stream()
    stream = stream if topics is None else stream.where(F.col("topic").isin(topics))
    return stream.writeStream.queryName(connector).option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(**trigger).start()


def supervise(engine: LogEngine, topic: str, partition: int, source: Callable[[int], DataFrame], source_id: str, sink_id: str, sink: Callable[[dict], None], options: SinkOptions = SinkOptions(), ticks: int | None = None, pause: float = 2.0, stop: Callable[[], bool] = lambda: False) -> dict:
    """Runs a source and a sink of one partition side by side, tick after tick: poll, drain, report both.

    source(tick) gives the tick's records (seq, key, payload); its batch is named by the tick, and ticks go on behind
    those that the log already has, so a supervisor that is started again neither repeats nor skips one. Without
    ``ticks`` it runs until ``stop`` holds. Returns the last reports.
    """
    if engine.topic(topic).isEmpty():
        engine.create_topic(topic, partition + 1)
    name = lambda tick: f"{source_id}-{tick}"
    own = engine.table("batches").where((F.col("topic") == topic) & (F.col("partition") == partition) & F.col("batch").startswith(f"{source_id}-"))
    had = own.agg(F.max(F.regexp_extract("batch", "([0-9]+)$", 1).cast("long")).alias("tick"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
    tick, produced, done = (-1 if had.tick is None else had.tick) + 1, had.n, 0
    last = {"produced": produced, "sink": None}
    while (ticks is None or done < ticks) and not stop():
        produced += engine.append(topic, partition, source(tick), batch=name(tick))["count"]
        total = drain(engine, sink_id, topic, partition, sink, options)
        engine.report((source_id, "source", "at-least-once", True, produced, 0, 0))
        last = {"produced": produced, "sink": total}
        tick, done = tick + 1, done + 1
        if ticks is None or done < ticks:
            time.sleep(pause)
    return last


def stop_when_done(query: StreamingQuery, expected: Callable[[], bool], seconds: float = 120) -> None:
    """Waits until ``expected`` holds, then stops; raises what the query raised."""
    end = time.time() + seconds
    while not expected():
        if query.exception():
            raise query.exception()
        if time.time() > end:
            query.stop()
            raise LogError("TIMEOUT")
        time.sleep(0.2)
    query.stop()
