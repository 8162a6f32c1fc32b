"""Facade: a log under a root folder, with topics, append, fetch, statistics, events, connectors and dead letters.

Tables are Parquet folders below the root. The log is partitioned by topic, partition and segment base, so fetches
read only the segments they need. One writer (the driver that holds the engine) gives offsets; appends themselves
run on the executors. Every attempt of an append writes its rows under a number of its own, and the batch row that
commits it names that attempt: an append is seen once and whole, or not at all, however often it is tried.
"""

from __future__ import annotations

import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions import validate
from logloom.operators import events as events_
from logloom.operators import fetch as fetch_
from logloom.operators import offsets, registry, retention, routing
from logloom.operators.folds import Bucket
from logloom.schemas import LogError, LogOptions

BATCHES = "topic string, partition int, base_offset long, last_offset long, count long, truncated_to long, start_offset long, batch string, attempt string, version long"
_ROWS = schemas.LOG + ", attempt string"
_STAGED = "seq long, key string, payload binary"


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; a machine-local one only where Spark runs on one machine and none is named."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="logloom-")
    return f"{shared.rstrip('/')}/log-{uuid.uuid4().hex}"


class LogEngine:
    def __init__(self, spark: SparkSession, root: str, options: LogOptions = LogOptions()):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.bucket = Bucket(options.burst, max(1, round(1_000_000 / options.rate_per_second)))
        self.turn, self.lock = 0, threading.RLock()
        #: First and next offset by (topic, partition), as far as this writer knows them; and the last version it gave.
        self.heads: dict[tuple[str, int], tuple[int, int]] = {}
        self.last_version: int | None = None
        self.totals = {"records_fetched_total": 0, "produce_rate_limited_total": 0}
        self.tables = {"topics": schemas.TOPICS, "batches": BATCHES, "statuses": schemas.STATUSES, "dead_letters": schemas.DEAD_LETTERS, "checkpoints": schemas.CHECKPOINTS, "events": schemas.EVENTS + ", version long"}

    def table(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).option("recursiveFileLookup", "true").parquet(path)

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _add(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.tables[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _version(self) -> int:
        """Greater than any version before, even if the clock was set back."""
        with self.lock:
            if self.last_version is None:
                ends = [self.table(t).agg(F.max("version")).first()[0] or 0 for t in ("batches", "statuses", "checkpoints", "events")]
                self.last_version = max(ends)
            self.last_version = max(time.time_ns(), self.last_version + 1)
            return self.last_version

    def _code(self, column) -> str | None:
        return self.spark.range(1).select(column).first()[0]

    # commands

    def create_topic(self, name: str, partitions: int = 1, segment_max_records: int = schemas.DEFAULT_SEGMENT_RECORDS, max_records: int = schemas.DEFAULT_MAX_RECORDS) -> Row:
        with self.lock:
            partitions = partitions or self.options.default_partitions
            code = self._code(F.coalesce(validate.topic_code(F.lit(name)), validate.config_code(F.lit(partitions), F.lit(segment_max_records))))
            if code:
                raise LogError(code)
            topics = self.table("topics")
            if topics.count() >= self.options.max_topics:  # before the check for the name
                raise LogError("CAPACITY_EXCEEDED")
            if not topics.where(F.col("name") == name).isEmpty():
                raise LogError("TOPIC_EXISTS")
            self._add("topics", [(name, partitions, segment_max_records, max_records)])
            self._add("events", [("topic_created", name, None, None, None, self._version())])
            return Row(name=name, partitions=partitions, segment_max_records=segment_max_records, max_records=max_records)

    def produce(self, topic: str, records: DataFrame) -> Row:
        """Appends a batch (seq, key, payload) to the partition of its first record."""
        with self.lock:
            found = records.agg(F.count("*").alias("n"), F.min_by(F.struct("key"), "seq").alias("first"), F.max(validate.payload_code(F.col("payload"))).alias("code")).first()
            if not found.n:
                raise LogError("EMPTY_BATCH")
            if not self.bucket.take(time.time_ns() // 1000, found.n):
                self.totals["produce_rate_limited_total"] += 1
                raise LogError("RATE_LIMITED")
            if found.code:
                raise LogError(found.code)
            config = self.topic(topic).first()
            if config is None:
                raise LogError("TOPIC_NOT_FOUND")
            if found.first.key is None:
                partition = self.turn % config.partitions
                self.turn += 1
            else:
                partition = self._code(routing.keyed(F.lit(found.first.key), config.partitions))
            return self.append(topic, partition, records, found.n)

    def append(self, topic: str, partition: int, records: DataFrame, n: int | None = None, batch: str | None = None) -> Row:
        """Appends to one partition, past all checks, as connectors do. A batch name that is known already isn't appended again.

        The records are computed once, into a staging folder; offsets and counts come from there. n: only spares their
        count where it is known.
        """
        with self.lock:
            config = self.topic(topic).first()
            if config is None:
                raise LogError("TOPIC_NOT_FOUND")
            if batch is not None:
                known = self.table("batches").where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("batch") == batch)).first()
                if known:
                    return known
            attempt = uuid.uuid4().hex
            staging = f"{self.root}/staging/{attempt}"
            records.select(F.col("seq").cast("long").alias("seq"), "key", F.col("payload").cast("binary").alias("payload")).write.parquet(staging)
            staged = self.spark.read.schema(_STAGED).parquet(staging)
            n = staged.count() if n is None else n
            start, begin = self._head(topic, partition)
            rows = offsets.with_offsets(staged.withColumn("topic", F.lit(topic)).withColumn("partition", F.lit(partition).cast("int")), ["topic", "partition"], "seq")
            rows = rows.withColumn("offset", F.col("offset") + begin).withColumn("timestamp", F.current_timestamp().cast("timestamp_ntz"))
            rows = rows.withColumn("segment_base", offsets.segment_base(F.col("offset"), config.segment_max_records)).drop("seq")
            rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("topic", "partition", "segment_base").parquet(f"{self.root}/log")
            self._delete(staging)
            after = begin + n
            kept = self._code(retention.segmented_start(F.lit(after), config.segment_max_records, config.max_records))
            cut = kept if kept > start else None
            self._commit((topic, partition, begin, after - 1, n, cut, max(kept, start), batch or attempt, attempt, self._version()))
            self._add("events", [("records_appended", topic, partition, begin, n, self._version())] + ([("records_truncated", topic, partition, cut, None, self._version())] if cut is not None else []))
            return Row(base_offset=begin, last_offset=after - 1, count=n, truncated_to=cut)

    def _commit(self, row: tuple) -> None:
        """The batch row: from here on its attempt's rows count."""
        self._add("batches", [row])
        self.heads[row[0], row[1]] = (row[6], row[3] + 1)

    def _head(self, topic: str, partition: int) -> tuple[int, int]:
        """First and next offset; read once, then kept by this writer."""
        if (topic, partition) not in self.heads:
            self.heads[topic, partition] = self._bounds(topic, partition)
        return self.heads[topic, partition]

    def _bounds(self, topic: str, partition: int) -> tuple[int, int]:
        """First and next offset of what is committed."""
        own = self.table("batches").where((F.col("topic") == topic) & (F.col("partition") == partition))
        row = own.agg(F.max("start_offset").alias("s"), F.max("last_offset").alias("e")).first()
        return (row.s or 0), (0 if row.e is None else row.e + 1)

    # queries

    def log(self) -> DataFrame:
        """Retained records of committed batches."""
        kept = self.table("batches").groupBy("topic", "partition").agg(F.max("start_offset").alias("first"))
        return self.rows_of(self.table("batches")).join(kept, ["topic", "partition"]).where(F.col("offset") >= F.col("first")).drop("first")

    def rows_of(self, batches: DataFrame) -> DataFrame:
        """The records of the given batch rows."""
        path = f"{self.root}/log"
        if not self._exists(path):
            return self.spark.createDataFrame([], schemas.LOG)
        raw = self.spark.read.schema(_ROWS).parquet(path)
        done = raw.join(batches.select("topic", "partition", "attempt"), ["topic", "partition", "attempt"], "left_semi")
        return done.select("topic", "partition", "segment_base", "offset", "timestamp", "key", "payload")

    def batch_stream(self) -> DataFrame:
        """Committed batches as a stream, from the first one on."""
        if not self._exists(f"{self.root}/batches"):
            self._add("batches", [])
        return self.spark.readStream.schema(BATCHES).parquet(f"{self.root}/batches")

    def fetch(self, topic: str, partition: int, start: int = 0, most: int = 100) -> tuple[DataFrame, Row]:
        """Records and the cursor (next_offset, high_watermark)."""
        config = self.topic(topic).first()
        code = self._code(fetch_.request_code(F.lit(partition), F.lit(config.partitions if config else None).cast("int")))
        if code != "OK":
            raise LogError(code)
        first, end = self._bounds(topic, partition)
        most, begin = fetch_.clamped(most, self.options.fetch_max), max(start, first)
        rows = fetch_.fetch(self.log().where(F.col("topic") == topic), partition, start, most, first, config.segment_max_records)
        after = max(begin, min(begin + most, end))
        self.totals["records_fetched_total"] += after - begin
        return rows, Row(next_offset=after, high_watermark=end)

    def topics(self) -> DataFrame:
        return self.table("topics").orderBy("name")

    def topic(self, name: str) -> DataFrame:
        return self.table("topics").where(F.col("name") == name)

    def stats(self) -> DataFrame:
        """One row: topics, partitions, records, segments, produced_total, and fetched_total of this engine."""
        names = ["topics", "partitions", "records", "segments", "produced_total"]
        zero = lambda cols: [F.lit(0).cast("long").alias(n) for n in names if n not in cols]
        topics = self.table("topics")
        state = self.table("batches").groupBy("topic", "partition").agg(F.max("start_offset").alias("s"), (F.max("last_offset") + 1).alias("e"))
        live = state.join(topics, state.topic == topics.name)
        segments = F.ceil(F.col("e") / F.col("segment_max_records")) - F.floor(F.col("s") / F.col("segment_max_records"))
        parts = [
            topics.select(F.lit(1).cast("long").alias("topics"), F.col("partitions").cast("long").alias("partitions"), *zero(["topics", "partitions"])),
            live.select(*zero(["records", "segments", "produced_total"]), (F.col("e") - F.col("s")).alias("records"), segments.cast("long").alias("segments"), F.col("e").alias("produced_total")),
        ]
        out = parts[0].unionByName(parts[1]).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        return out.withColumn("fetched_total", F.lit(self.totals["records_fetched_total"]).cast("long"))

    def counters(self) -> DataFrame:
        """metric, value: what the log has done so far, from its tables; fetches and refused batches are this engine's own."""
        kinds = self.table("events").groupBy("kind").agg(F.count("*").alias("value"), F.coalesce(F.sum("count"), F.lit(0)).alias("records"))
        produced = kinds.where("kind = 'records_appended'").select(F.lit("records_produced_total").alias("metric"), F.col("records").alias("value"))
        status = self.connectors()
        sums = [status.agg(F.coalesce(F.sum(c), F.lit(0)).alias("value")).select(F.lit(m).alias("metric"), "value") for m, c in (("records_delivered_total", "processed"), ("records_dead_lettered_total", "dead_lettered"))]
        out = kinds.select(F.concat("kind", F.lit("_total")).alias("metric"), "value").unionByName(produced)
        out = out.unionByName(self.spark.createDataFrame(list(self.totals.items()), "metric string, value long"))
        return out.unionByName(sums[0]).unionByName(sums[1]).unionByName(self.dead_letters().agg(F.count("*").alias("value")).select(F.lit("dlq_size").alias("metric"), "value"))

    def connectors(self) -> DataFrame:
        return registry.statuses(self.table("statuses"))

    def dead_letters(self) -> DataFrame:
        """Each delivered batch has a folder of its own, which a batch that is run again replaces."""
        return self.table("dead_letters")

    def replace_dead_letters(self, connector: str, rows: DataFrame) -> None:
        """Puts these (of the dead-letter columns) in the place of all dead letters of a connector."""
        held = f"{self.root}/staging/{uuid.uuid4().hex}"
        rows.select(*self.table("dead_letters").columns).write.parquet(held)
        self._delete(f"{self.root}/dead_letters/connector={connector}")
        kept = self.spark.read.schema(self.tables["dead_letters"]).parquet(held)
        kept.write.parquet(f"{self.root}/dead_letters/connector={connector}/replaced")
        self._delete(held)

    def events(self, topics: list[str] | None = None) -> DataFrame:
        return events_.for_topics(self.table("events"), topics or []).drop("version")

    def subscribe(self, topics: list[str] | None = None) -> DataFrame:
        """The events as a stream, from the first one on."""
        if not self._exists(f"{self.root}/events"):
            self._add("events", [])
        return events_.for_topics(self.spark.readStream.schema(self.tables["events"]).parquet(f"{self.root}/events"), topics or []).drop("version")

    # connector state

    def report(self, status: tuple) -> None:
        """Upserts a status: id, kind, guarantee, running, processed, dead_lettered, checkpoint."""
        self._add("statuses", [(*status, self._version())])

    def save_checkpoint(self, connector: str, topic: str, partition: int, offset: int) -> None:
        self._add("checkpoints", [(connector, topic, partition, offset, self._version())])

    def load_checkpoint(self, connector: str, topic: str, partition: int) -> int | None:
        own = self.table("checkpoints").where((F.col("connector") == connector) & (F.col("topic") == topic) & (F.col("partition") == partition))
        return own.agg(F.max_by("offset", "version")).first()[0]

    def prune(self) -> list[str]:
        """Deletes segment folders that lie wholly before their partition's first offset."""
        gone = []
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        state = self.table("batches").groupBy("topic", "partition").agg(F.max("start_offset").alias("first")).collect()  # a row a partition
        for topic, partition, first in state:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/topic={topic}/partition={partition}")
            fs = at.getFileSystem(conf)
            if fs.exists(at):
                for item in fs.listStatus(at):
                    if item.getPath().getName().startswith("segment_base=") and int(item.getPath().getName().split("=")[1]) < first:
                        gone.append(item.getPath().toString())
                        fs.delete(item.getPath(), True)
        return gone
