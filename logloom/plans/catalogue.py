"""Registered queries of the log engine with their DuckDB twins.

Most run over the canonical log: topic ``events`` in 4 partitions, key ``user-<user_id>``, payload
``<event_type>|<props>``, order ``event_id``.
"""

from __future__ import annotations

import contextlib
import dataclasses
import uuid
from collections.abc import Callable

from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schemas
from logloom.engine import LogEngine, scratch
from logloom.functions import framing, hashing, validate
from logloom.operators import delivery, events, fetch, folds, logstats, offsets, registry, retention, routing
from logloom.sources import generator, segments
from logloom.streaming import runtime

P, SEGMENT, KEEP, BATCH, FAIL, ATTEMPTS, PRODUCED = 4, 256, 1000, 500, 500, 3, 100
HOUR = 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# building blocks, in both engines


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.col("event_id").alias("seq"), F.floor(F.col("event_id") / PRODUCED).alias("batch_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.concat("event_type", F.lit("|"), "props").alias("payload"), F.col("ts").alias("timestamp"))


def routed(records: DataFrame, partitions: int = P) -> DataFrame:
    return records.withColumn("topic", F.lit("events")).withColumn("partition", routing.keyed(F.col("key"), partitions))


def log(spark: SparkSession, sf_dir: str, partitions: int = P) -> DataFrame:
    records = events_table(spark, sf_dir)
    records = routed(records, partitions) if partitions > 1 else records.withColumn("topic", F.lit("events")).withColumn("partition", F.lit(0))
    return offsets.with_offsets(records, ["topic", "partition"], "seq").select("topic", "partition", "offset", "key", "payload", "timestamp")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partition, n of the canonical log; offsets aren't needed for it."""
    return routed(events_table(spark, sf_dir)).groupBy("partition").agg(F.count("*").alias("n"))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.appends(routing.batches(events_table(spark, sf_dir), P), SEGMENT, KEEP)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        return f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names}))"


def fnv_sql(key: str) -> str:
    return f"""list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, length(hex(encode({key}))) // 2), lambda i: ('0x' || substr(hex(encode({key})), 2 * i + 1, 2))::INT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) & 18446744073709551615::HUGEINT)"""


RECORDS_SQL = f"records AS (SELECT event_id, event_id // {PRODUCED} AS batch_id, 'user-' || user_id AS key, event_type || '|' || props AS payload, ts FROM events)"
KEYS_SQL = f"keys AS (SELECT key, {fnv_sql('key')} AS h FROM (SELECT DISTINCT key FROM records))"
LOG_SQL = f"{RECORDS_SQL}, {KEYS_SQL}, routed AS (SELECT r.*, (h % {P})::INT AS partition FROM records r JOIN keys USING (key)), log AS (SELECT 'events' AS topic, partition, (row_number() OVER (PARTITION BY partition ORDER BY event_id) - 1)::BIGINT AS \"offset\", key, payload, ts AS \"timestamp\", event_id FROM routed)"
COUNTS_SQL = f"{LOG_SQL}, counts AS (SELECT partition, count(*) AS n FROM log GROUP BY partition)"


def start_sql(n: str) -> str:
    return f"least((greatest({n}, 1) - 1) // {SEGMENT} * {SEGMENT}, (greatest({n} - {KEEP}, 0) + {SEGMENT - 1}) // {SEGMENT} * {SEGMENT})"


APPENDS_SQL = f"""{RECORDS_SQL}, {KEYS_SQL}, firsts AS (SELECT batch_id, arg_min_null(key, event_id) AS key, count(*) AS n FROM records GROUP BY batch_id),
 batches AS (SELECT batch_id, (h % {P})::INT AS partition, n FROM firsts JOIN keys USING (key)),
 summed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY partition ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM batches),
 appends AS (SELECT batch_id, partition, before AS base_offset, before + n - 1 AS last_offset, n AS count, CASE WHEN {start_sql('(before + n)')} > {start_sql('before')} THEN {start_sql('(before + n)')} END AS truncated_to FROM summed)"""


# hashing, routing


@query(f"WITH {RECORDS_SQL}, {KEYS_SQL} SELECT key, lower(lpad(hex(h::UBIGINT), 16, '0')) AS hash_hex FROM keys")
def fnv1a_hash(spark, sf_dir):
    return events_table(spark, sf_dir).select("key").distinct().select("key", hashing.fnv1a_hex(F.col("key")).alias("hash_hex"))


@query(f"WITH {LOG_SQL} SELECT event_id, partition FROM routed")
def route_keyed(spark, sf_dir):
    return routed(events_table(spark, sf_dir)).select("event_id", "partition")


@query(f"WITH {APPENDS_SQL} SELECT batch_id, partition, n FROM batches")
def route_batch(spark, sf_dir):
    return routing.batches(events_table(spark, sf_dir), P)


@query(f"WITH {RECORDS_SQL} SELECT batch_id, ((row_number() OVER (ORDER BY batch_id) - 1) % {P})::INT AS partition FROM (SELECT DISTINCT batch_id FROM records)")
def route_round_robin(spark, sf_dir):
    keyless = events_table(spark, sf_dir).withColumn("key", F.lit(None).cast("string"))
    return routing.batches(keyless, P).select("batch_id", "partition")


# append, segments


@query(f'WITH {LOG_SQL} SELECT topic, partition, "offset", key, payload, "timestamp" FROM log')
def log_append(spark, sf_dir):
    return log(spark, sf_dir)


@query(f"""WITH {LOG_SQL} SELECT partition, "offset" // {SEGMENT} * {SEGMENT} AS segment_base, lpad(("offset" // {SEGMENT} * {SEGMENT})::VARCHAR, 20, '0') AS segment_id, min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS n FROM log GROUP BY ALL""")
def segment_assign(spark, sf_dir):
    return logstats.segments(log(spark, sf_dir), SEGMENT, ["partition"]).select("partition", "segment_base", "segment_id", "first_offset", "last_offset", "n")


@query(f'WITH {LOG_SQL} SELECT partition, "offset", key FROM log WHERE partition = 0 AND "offset" >= 300 AND "offset" < 512 ORDER BY "offset" LIMIT 50')
def segment_read(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("segment_base", offsets.segment_base(F.col("offset"), SEGMENT)).where(F.col("segment_base") == 256)
    return fetch.fetch(rows, 0, 300, 50, segment_max=SEGMENT).select("partition", "offset", "key")


@query(f"WITH {COUNTS_SQL} SELECT partition, {start_sql('n')} AS start_offset, n AS next_offset, (n + {SEGMENT - 1}) // {SEGMENT} - {start_sql('n')} // {SEGMENT} AS segments FROM counts")
def recover_partition_state(spark, sf_dir):
    left = logstats.segments(log(spark, sf_dir), SEGMENT, ["partition"])
    start = retention.segmented(counts(spark, sf_dir), SEGMENT, KEEP).select("partition", "start_offset")
    return logstats.recovered(left.join(start, "partition").where("segment_base >= start_offset").drop("start_offset"), ["partition"])


@query(f"WITH {APPENDS_SQL} SELECT * REPLACE (coalesce(truncated_to, -1) AS truncated_to) FROM appends")
def produce_results(spark, sf_dir):
    """truncated_to is -1 where nothing was truncated, so that both engines compare plain integers."""
    return appended(spark, sf_dir).fillna(-1, ["truncated_to"])


# fetch


@query(f'WITH {LOG_SQL} SELECT "offset", key, payload FROM log WHERE partition = 0 AND "offset" >= 100 ORDER BY "offset" LIMIT 100')
def fetch_range(spark, sf_dir):
    """Offsets follow from the order of one partition's records: tasks keep their first 200, nothing else is numbered or shuffled."""
    mine = routed(events_table(spark, sf_dir)).where(F.col("partition") == 0)
    return fetch.head(mine, "seq", 100, 100).select("offset", "key", "payload")


@query(f"""WITH {RECORDS_SQL}, one AS (SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS "offset", key, payload FROM records)
 SELECT 0 AS requested_max, * FROM one WHERE "offset" < 1 UNION ALL SELECT 5000 AS requested_max, * FROM one WHERE "offset" < 1024""")
def fetch_max_clamp(spark, sf_dir):
    one, most = events_table(spark, sf_dir), schemas.LogOptions().fetch_max
    parts = [fetch.head(one, "seq", 0, fetch.clamped(m, most)).select(F.lit(m).alias("requested_max"), "offset", "key", "payload") for m in (0, 5000)]
    return parts[0].unionByName(parts[1])


@query(f'WITH {COUNTS_SQL} SELECT partition, "offset" FROM log JOIN counts USING (partition) WHERE "offset" >= {start_sql("n")} AND "offset" < {start_sql("n")} + 100')
def fetch_after_retention(spark, sf_dir):
    bounds = retention.segmented(counts(spark, sf_dir), SEGMENT, KEEP).select("partition", "start_offset")
    rows = log(spark, sf_dir).join(fetch.narrow(bounds), "partition")
    begin = F.greatest(F.lit(0), "start_offset")
    return rows.where((F.col("offset") >= begin) & (F.col("offset") < begin + 100)).select("partition", "offset")


_REQUESTS = [(p, start, 100) for p in range(P) for start in (0, 100, 1_000_000)]


@query(f"""WITH {COUNTS_SQL}, asked AS {sql_values(_REQUESTS, "partition, from_offset, most")}, found AS (SELECT a.partition, from_offset::BIGINT AS from_offset, greatest(from_offset, {start_sql('n')}) AS b, n AS hw FROM asked a JOIN counts USING (partition))
 SELECT partition, from_offset, greatest(0, least(100, hw - b))::BIGINT AS n, (b + greatest(0, least(100, hw - b)))::BIGINT AS next_offset, hw AS high_watermark FROM found""")
def fetch_cursor(spark, sf_dir):
    bounds = retention.segmented(counts(spark, sf_dir), SEGMENT, KEEP).select("partition", "start_offset", "high_watermark")
    return fetch.cursors(log(spark, sf_dir), values(spark, _REQUESTS, "partition int, from_offset long, max int"), bounds)


_ASKED = [(1, "events", 0), (2, "events", 3), (3, "events", 4), (4, "nowhere", 0), (5, "orders", 2), (6, "orders", 1)]
_TOPICS = [("events", 4, 256, 1000), ("lineitem", 8, 1024, 0), ("orders", 2, 1024, 1_000_000)]


@query(f"""SELECT request_id, CASE WHEN t.name IS NULL THEN 'TOPIC_NOT_FOUND' WHEN partition >= partitions THEN 'PARTITION_OUT_OF_RANGE' ELSE 'OK' END AS code FROM {sql_values(_ASKED, "request_id, topic, partition")} a LEFT JOIN {sql_values(_TOPICS, "name, partitions, s, m")} t ON a.topic = t.name""")
def fetch_request_errors(spark, sf_dir):
    asked, known = values(spark, _ASKED, "request_id int, topic string, partition int"), values(spark, _TOPICS, schemas.TOPICS)
    return asked.join(known, asked.topic == known.name, "left").select("request_id", fetch.request_code(F.col("partition"), F.col("partitions")).alias("code"))


# validation


@query(f"""SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'EMPTY_PAYLOAD' WHEN strlen(text) > {schemas.MAX_PAYLOAD_BYTES} THEN 'PAYLOAD_TOO_LARGE' END AS code FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '' UNION ALL SELECT -2, repeat('x', {schemas.MAX_PAYLOAD_BYTES + 1}) UNION ALL SELECT -3, repeat('x', {schemas.MAX_PAYLOAD_BYTES}))""")
def validate_records(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = lambda i, n: spark.range(1).select(F.lit(i).cast("long").alias("doc_id"), F.repeat(F.lit("x"), F.lit(n)).alias("text"))
    rows = docs.unionByName(x(-1, 0)).unionByName(x(-2, schemas.MAX_PAYLOAD_BYTES + 1)).unionByName(x(-3, schemas.MAX_PAYLOAD_BYTES))
    return rows.select("doc_id", validate.payload_code(F.col("text")).alias("code"))


_NAMES = ["orders.v1_2-A", "", "bad name", "é", "a" * 255, "a" * 256, "b" * 128, "b" * 129, "x\ny", "c" * 300]
_NAMES_SQL = "(SELECT url AS name FROM pages UNION SELECT p_name FROM part UNION SELECT c_name FROM customer UNION SELECT * FROM " + sql_values([(n.replace("\n", "' || chr(10) || '"),) for n in _NAMES], "name") + ")"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("name")) for t, c in (("pages", "url"), ("part", "p_name"), ("customer", "c_name"))]
    return parts[0].union(parts[1]).union(parts[2]).union(values(spark, [(n,) for n in _NAMES], "name string")).distinct()


def names_sql(most: int) -> str:
    return f"SELECT name, CASE WHEN strlen(name) = 0 THEN 'EMPTY_TOPIC_NAME' WHEN strlen(name) > {most} THEN 'TOPIC_NAME_TOO_LONG' WHEN NOT regexp_full_match(name, '[A-Za-z0-9._-]+') THEN 'INVALID_TOPIC_CHAR' END AS code FROM {_NAMES_SQL}"


@query(names_sql(schemas.MAX_TOPIC_BYTES))
def validate_topic_names(spark, sf_dir):
    return names(spark, sf_dir).select("name", validate.topic_code(F.col("name")).alias("code"))


@query(names_sql(schemas.MAX_CONNECTOR_BYTES))
def validate_connector_ids(spark, sf_dir):
    return names(spark, sf_dir).select("name", validate.connector_code(F.col("name")).alias("code"))


_CONFIGS = [("fine", 3, 1024), ("no-partitions", 0, 1024), ("no-segment", 3, 0), ("neither", 0, 0)]


@query(f"SELECT name, CASE WHEN partitions = 0 THEN 'ZERO_PARTITIONS' WHEN size = 0 THEN 'ZERO_SEGMENT_SIZE' END AS code FROM {sql_values(_CONFIGS, 'name, partitions, size')}")
def validate_topic_configs(spark, sf_dir):
    return values(spark, _CONFIGS, "name string, partitions int, size long").select("name", validate.config_code(F.col("partitions"), F.col("size")).alias("code"))


# retention, statistics


@query(f"WITH {COUNTS_SQL} SELECT partition, {start_sql('n')} AS start_offset, n AS high_watermark, n - {start_sql('n')} AS retained, ((n - 1) // {SEGMENT} * {SEGMENT} - {start_sql('n')}) // {SEGMENT} + 1 AS segments FROM counts")
def retention_segmented(spark, sf_dir):
    return retention.segmented(counts(spark, sf_dir), SEGMENT, KEEP)


@query(f"WITH {COUNTS_SQL} SELECT partition, greatest(n - {KEEP}, 0) AS start_offset, n AS high_watermark, least(n, {KEEP}) AS retained, (n + {SEGMENT - 1}) // {SEGMENT} AS segments FROM counts")
def retention_exact(spark, sf_dir):
    return retention.exact(counts(spark, sf_dir), SEGMENT, KEEP)


@query(f"WITH {APPENDS_SQL} SELECT batch_id, partition, truncated_to AS new_start FROM appends WHERE truncated_to IS NOT NULL")
def truncation_events(spark, sf_dir):
    return appended(spark, sf_dir).where("truncated_to is not null").select("batch_id", "partition", F.col("truncated_to").alias("new_start"))


_SOURCES = {"events": ("user-", "user_id", 4), "orders": ("cust-", "o_custkey", 2), "lineitem": ("order-", "l_orderkey", 8)}
_COUNTS3_SQL = "counts3 AS (" + " UNION ALL ".join(f"SELECT '{t}' AS topic, (h % {p})::INT AS partition, sum(c)::BIGINT AS n FROM (SELECT {fnv_sql('key')} AS h, c FROM (SELECT '{x}' || {k} AS key, count(*) AS c FROM {t} GROUP BY 1)) GROUP BY 1, 2" for t, (x, k, p) in _SOURCES.items()) + ")"


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by topic and partition; each key is hashed once, on its own table's single column."""
    parts = []
    for t, (prefix, key, p) in _SOURCES.items():
        keys = spark.read.parquet(f"{sf_dir}/{t}.parquet").groupBy(key).agg(F.count("*").alias("c"))
        route = routing.keyed(F.concat(F.lit(prefix), F.col(key).cast("string")), p)
        parts.append(keys.select(F.lit(t).alias("topic"), route.alias("partition"), "c").groupBy("topic", "partition").agg(F.sum("c").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_COUNTS3_SQL} SELECT count(DISTINCT topic) AS topics, count(*) AS partitions, sum(n)::BIGINT AS records, sum((n + {SEGMENT - 1}) // {SEGMENT})::BIGINT AS segments, sum(n)::BIGINT AS produced_total FROM counts3")
def log_stats(spark, sf_dir):
    return logstats.totals(topic_counts(spark, sf_dir), SEGMENT)


@query(f"WITH {_COUNTS3_SQL} SELECT topic, partition, 0::BIGINT AS start_offset, n AS high_watermark, (n + {SEGMENT - 1}) // {SEGMENT} AS segments FROM counts3")
def partition_stats(spark, sf_dir):
    return logstats.partitions(topic_counts(spark, sf_dir), SEGMENT)


# topics


@query(f"SELECT name, partitions, segment_max_records::BIGINT AS segment_max_records, max_records::BIGINT AS max_records FROM {sql_values(_TOPICS, 'name, partitions, segment_max_records, max_records')} ORDER BY name")
def topics_list(spark, sf_dir):
    return values(spark, _TOPICS, schemas.TOPICS).orderBy("name")


@query(f"SELECT name, partitions, segment_max_records::BIGINT AS segment_max_records, max_records::BIGINT AS max_records FROM {sql_values(_TOPICS, 'name, partitions, segment_max_records, max_records')} WHERE name = 'orders'")
def topic_lookup(spark, sf_dir):
    return values(spark, _TOPICS, schemas.TOPICS).where("name = 'orders'")


_CREATES = [(1, "a", 3), (2, "b", 0), (3, "a", 1), (4, "c", 1), (5, "b", 1), (6, "d", 2)]
_CAPACITY = 3


@query(f"""WITH asked AS {sql_values(_CREATES, "id, name, partitions")}, first AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) = 1 AS fresh FROM asked), held AS (SELECT *, coalesce(sum(fresh::INT) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM first)
 SELECT id, name, CASE WHEN had >= {_CAPACITY} THEN 'CAPACITY_EXCEEDED' WHEN NOT fresh THEN 'TOPIC_EXISTS' ELSE 'CREATED' END AS code, CASE WHEN partitions = 0 THEN 3 ELSE partitions END AS partitions FROM held""")
def topic_create_outcomes(spark, sf_dir):
    from pyspark.sql import Window

    asked = values(spark, _CREATES, "id int, name string, partitions int")
    fresh = asked.withColumn("fresh", F.row_number().over(Window.partitionBy("name").orderBy("id")) == 1)
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # a row a command
    had = F.coalesce(F.sum(F.col("fresh").cast("int")).over(before), F.lit(0))
    code = F.when(had >= _CAPACITY, "CAPACITY_EXCEEDED").when(~F.col("fresh"), "TOPIC_EXISTS").otherwise("CREATED")
    default = schemas.LogOptions().default_partitions
    return fresh.select("id", "name", code.alias("code"), F.when(F.col("partitions") == 0, default).otherwise(F.col("partitions")).alias("partitions"))


# delivery


@query(f"""WITH {LOG_SQL} SELECT partition, "offset", CASE WHEN "offset" % {FAIL} = 0 THEN 'permanent' ELSE 'delivered' END AS outcome FROM log""")
def sink_delivery(spark, sf_dir):
    return log(spark, sf_dir).select("partition", "offset", delivery.outcome(F.col("offset"), FAIL).alias("outcome"))


@query(f"WITH {COUNTS_SQL} SELECT partition, n AS delivered FROM counts")
def sink_collect(spark, sf_dir):
    """Every record goes through the runtime's delivery to a sink that never fails."""
    done = runtime.delivered(log(spark, sf_dir), runtime.FailingSink(0), schemas.SinkOptions())
    return done.where("reason is null").groupBy("partition").agg(F.count("*").alias("delivered"))


@query(f"""WITH {LOG_SQL} SELECT 'sink-1' AS connector, topic, partition, "offset", payload, 'permanent failure: poison record at offset ' || "offset" AS reason, {ATTEMPTS} AS attempts FROM log WHERE "offset" % {FAIL} = 0""")
def dead_letters(spark, sf_dir):
    return delivery.dead_letters(log(spark, sf_dir), "sink-1", FAIL, ATTEMPTS)


@query(f"""WITH {LOG_SQL} SELECT partition, "offset" // {BATCH} AS batch_no, count(*) AS polled, count(*) FILTER ("offset" % {FAIL} <> 0) AS delivered, count(*) FILTER ("offset" % {FAIL} = 0) AS dead_lettered, max("offset") + 1 AS checkpoint FROM log GROUP BY 1, 2""")
def delivery_reports(spark, sf_dir):
    return delivery.reports(log(spark, sf_dir), BATCH, FAIL)


@query(f"""WITH {LOG_SQL} SELECT 'sink-1' AS connector, partition, max("offset") + 1 AS "offset" FROM log GROUP BY partition""")
def checkpoint_latest(spark, sf_dir):
    saved = delivery.reports(log(spark, sf_dir), BATCH, FAIL).select(F.lit("sink-1").alias("connector"), "partition", F.col("checkpoint").alias("offset"), F.col("batch_no").alias("version"))
    return delivery.latest(saved, ["connector", "partition"], "offset")


_SAVED = [("sink-1", 0, 1000), ("sink-1", 2, 2000), ("sink-2", 1, 10)]


@query(f"""WITH {LOG_SQL} SELECT l.partition, "offset" FROM log l LEFT JOIN {sql_values([r[1:] for r in _SAVED if r[0] == "sink-1"], "partition, since")} c ON l.partition = c.partition WHERE "offset" >= coalesce(since, 0)""")
def checkpoint_resume(spark, sf_dir):
    saved = values(spark, _SAVED, "connector string, partition int, offset long")
    return delivery.resumed(log(spark, sf_dir), saved, "sink-1").select("partition", "offset")


class FlakySink:
    """Fails for good as FailingSink does, and ``offset % 5`` times in passing."""

    def __init__(self, fail_every: int):
        self.fail_every, self.tries = fail_every, {}

    def __call__(self, record: dict) -> None:
        runtime.FailingSink(self.fail_every)(record)
        at = record["topic"], record["partition"], record["offset"]
        self.tries[at] = self.tries.get(at, 0) + 1
        if self.tries[at] <= record["offset"] % 5:
            raise runtime.SinkError("transient", f"try {self.tries[at]}")
        del self.tries[at]


@query(f"""WITH {LOG_SQL} SELECT partition, "offset", CASE WHEN "offset" % {FAIL} = 0 THEN 'permanent' WHEN "offset" % 5 < {ATTEMPTS} THEN 'delivered' ELSE 'exhausted' END AS outcome, (CASE WHEN "offset" % {FAIL} = 0 THEN 1 ELSE least("offset" % 5 + 1, {ATTEMPTS}) END)::INT AS attempts_made, CASE WHEN "offset" % {FAIL} = 0 OR "offset" % 5 >= {ATTEMPTS} THEN {ATTEMPTS} ELSE -1 END AS attempts_reported FROM log""")
def retry_outcomes(spark, sf_dir):
    """The runtime's retries against a sink that fails in passing and for good; a dead letter reports the bound."""
    done = runtime.delivered(log(spark, sf_dir), FlakySink(FAIL), schemas.SinkOptions(max_attempts=ATTEMPTS, base_backoff_ms=0))
    outcome = F.when(F.col("reason").isNull(), "delivered").when(F.col("reason").startswith("permanent"), "permanent").otherwise("exhausted")
    return done.select("partition", "offset", outcome.alias("outcome"), F.col("tries").alias("attempts_made"), F.when(F.col("reason").isNotNull(), F.lit(ATTEMPTS)).otherwise(-1).alias("attempts_reported"))


_FAILURES = [("unavailable", "dependency unavailable"), ("not_found", "not found"), ("transient", "transient failure"), ("permanent", "permanent failure")]


@query(f"SELECT class, text, class IN ('unavailable', 'transient') AS retryable FROM {sql_values(_FAILURES, 'class, text')}")
def error_classes(spark, sf_dir):
    found = values(spark, list(runtime.SinkError.WORDS.items()), "class string, text string")
    return found.select("class", "text", delivery.retryable(F.col("class")).alias("retryable"))


@query("SELECT i::INT AS attempt, least(20 * pow(2, least(i, 16)), 1000) / 2 AS lower_ms, least(20 * pow(2, least(i, 16)), 1000)::DOUBLE AS upper_ms FROM range(0, 21) t(i)")
def backoff_bounds(spark, sf_dir):
    lower, upper = delivery.backoff_bounds(F.col("attempt"), 20, 1000)
    return spark.range(21).select(F.col("id").cast("int").alias("attempt")).select("attempt", lower.alias("lower_ms"), upper.alias("upper_ms"))


class Witness:
    """A sink that writes down each offset, in a file a task, and dies after some records of a batch.

    What has died stays dead until the next run: a task that Spark runs again finds it so.
    """

    def __init__(self, folder: str, dies_at: int | None):
        self.folder, self.dies_at, self.out = folder, dies_at, None

    def __call__(self, record: dict) -> None:
        if self.dies_at is not None and (record["offset"] == self.dies_at or TaskContext.get().attemptNumber()):
            raise RuntimeError("the sink dies")
        if self.out is None:
            files, path = FileSystem.from_uri(self.folder)
            files.create_dir(path)
            self.out = files.open_output_stream(f"{path}/{uuid.uuid4().hex}")
        self.out.write(b"%d\n" % record["offset"])


CRASH = 2 * BATCH + 123


def engine_of_events(spark: SparkSession, sf_dir: str, partitions: list[int], crash: bool = False) -> LogEngine:
    """A log written by the engine, a named batch a partition. crash: its first attempts die between their rows and their commit."""
    engine = LogEngine(spark, scratch(spark))
    engine.create_topic("events", P, SEGMENT, 0)
    records = routed(events_table(spark, sf_dir))
    for p in partitions:
        mine = records.where(F.col("partition") == p).select("seq", "key", "payload")
        if crash:
            dying = LogEngine(spark, engine.root)
            dying._commit = lambda row: (_ for _ in ()).throw(ConnectionError("died before the commit"))
            with contextlib.suppress(ConnectionError):
                dying.append("events", p, mine, batch=f"load-{p}")
        for _ in range(2):  # the second one is a replay of a batch that is known
            engine.append("events", p, mine, batch=f"load-{p}")
    return engine


_REPLAYED = "partition int, delivered_once long, delivered_twice long, lost long"


def replayed(spark: SparkSession, sf_dir: str, guarantee: str) -> DataFrame:
    """Partition 0 delivered by the runtime, with a sink that dies in the third batch, and a restart."""
    engine = engine_of_events(spark, sf_dir, [0])
    seen = f"{engine.root}/seen"  # in the shared folder, as any executor may deliver
    n, options = engine._bounds("events", 0)[1], schemas.SinkOptions(guarantee=guarantee, batch_size=BATCH)
    for _ in range(2):
        if n > 0:
            runtime.run_once(engine, "s", "events", 0, Witness(seen, None), options)
    if n > CRASH:
        with contextlib.suppress(Exception):
            runtime.run_once(engine, "s", "events", 0, Witness(seen, CRASH), options)
    runtime.drain(engine, "s", "events", 0, Witness(seen, None), dataclasses.replace(options, batch_size=1_000_000))
    if not n:
        return values(spark, [], _REPLAYED)
    times = spark.read.schema("offset long").csv(seen).groupBy("offset").agg(F.count("*").alias("times"))
    return times.agg(F.lit(0).alias("partition"), F.count_if(F.col("times") == 1).alias("delivered_once"), F.count_if(F.col("times") == 2).alias("delivered_twice"), (F.lit(n) - F.count("*")).alias("lost"))


def replay_sql(twice: str, lost: str) -> str:
    return f"WITH {COUNTS_SQL}, hit AS (SELECT partition, n, greatest(0, least({BATCH}, n - {2 * BATCH})) AS size FROM counts WHERE partition = 0), done AS (SELECT *, CASE WHEN n > {CRASH} THEN {CRASH - 2 * BATCH} ELSE 0 END AS done, n > {CRASH} AS died FROM hit) SELECT partition, (n - {twice} - {lost})::BIGINT AS delivered_once, ({twice})::BIGINT AS delivered_twice, ({lost})::BIGINT AS lost FROM done"


@query(replay_sql("done", "0"))
def replay_at_least_once(spark, sf_dir):
    return replayed(spark, sf_dir, "at_least_once")


@query(replay_sql("0", "(CASE WHEN died THEN size - done ELSE 0 END)"))
def replay_at_most_once(spark, sf_dir):
    return replayed(spark, sf_dir, "at_most_once")


@query(f'WITH {LOG_SQL} SELECT topic, partition, "offset", key, payload FROM log')
def engine_log_after_crashes(spark, sf_dir):
    """What the engine's log holds after every append died once before its commit, was run again, and replayed."""
    rows = engine_of_events(spark, sf_dir, list(range(P)), crash=True).log()
    return rows.select("topic", "partition", "offset", "key", F.col("payload").cast("string").alias("payload"))


@query(f"WITH {COUNTS_SQL} SELECT 1::BIGINT AS topics, {P}::BIGINT AS partitions, sum(n)::BIGINT AS records, sum((n + {SEGMENT - 1}) // {SEGMENT})::BIGINT AS segments, sum(n)::BIGINT AS produced_total, (SELECT least(100, n)::BIGINT FROM counts WHERE partition = 0) AS fetched_total FROM counts")
def engine_stats_after_crashes(spark, sf_dir):
    engine = engine_of_events(spark, sf_dir, list(range(P)), crash=True)
    engine.fetch("events", 0, 0, 100)
    return engine.stats()


@query(f"""WITH {LOG_SQL} SELECT 'sink-1' AS connector, topic, partition, "offset", payload, 'permanent failure: poison record at offset ' || "offset" AS reason, {ATTEMPTS} AS attempts FROM log WHERE "offset" % {FAIL} = 0""")
def sink_stream_dead_letters(spark, sf_dir):
    """Dead letters of the streaming sink over the engine's log; its batch is run twice, as its end is lost."""
    engine = engine_of_events(spark, sf_dir, list(range(P)))
    for _ in range(2):
        runtime.log_to_sink(engine, "sink-1", ["events"], runtime.FailingSink(FAIL), schemas.SinkOptions(max_attempts=ATTEMPTS), f"{engine.root}/stream", availableNow=True).awaitTermination()
        engine._delete(f"{engine.root}/stream/commits/0")
    return engine.dead_letters().drop("failed_at").withColumn("payload", F.col("payload").cast("string"))


# events, registry, projections

_EVENTS_SQL = f"""SELECT 'topic_created' AS kind, name AS topic, -1 AS partition, -1::BIGINT AS "offset", -1 AS count FROM {sql_values(_TOPICS, "name, p, s, m")}
 UNION ALL SELECT 'records_appended', 'events', partition, base_offset, count::INT FROM appends UNION ALL SELECT 'records_truncated', 'events', partition, truncated_to, -1 FROM appends WHERE truncated_to IS NOT NULL"""


@query(f"WITH {APPENDS_SQL} {_EVENTS_SQL}")
def event_stream(spark, sf_dir):
    """Missing fields are -1, so that both engines compare plain integers."""
    return events.of_topics(values(spark, _TOPICS, schemas.TOPICS)).unionByName(events.of_appends(appended(spark, sf_dir), "events")).fillna(-1, ["partition", "offset", "count"])


@query(f"WITH {APPENDS_SQL} SELECT * FROM ({_EVENTS_SQL}) WHERE topic IN ('orders', 'lineitem')")
def events_filtered(spark, sf_dir):
    return events.for_topics(event_stream(spark, sf_dir), ["orders", "lineitem"])


_STATUSES = [("sink-1", "sink", "at-least-once", True, 1, 0, 1, 1), ("sink-1", "sink", "at-least-once", True, 5, 1, 6, 2), ("source-1", "source", "at-least-once", True, 9, 0, 0, 1), ("sink-2", "sink", "at-most-once", False, 3, 0, 3, 4), ("sink-2", "sink", "at-most-once", True, 2, 0, 2, 3)]


@query(f"SELECT id, kind, replace(guarantee, '-', '_') AS guarantee, running, processed::BIGINT AS processed, dead_lettered::BIGINT AS dead_lettered, checkpoint::BIGINT AS checkpoint FROM {sql_values(_STATUSES, 'id, kind, guarantee, running, processed, dead_lettered, checkpoint, version')} QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def connector_status(spark, sf_dir):
    return registry.statuses(values(spark, _STATUSES, schemas.STATUSES))


@query(f'WITH {LOG_SQL} SELECT partition, "offset", "timestamp", key, payload FROM log')
def record_projection(spark, sf_dir):
    return log(spark, sf_dir).withColumn("payload", F.col("payload").cast("binary")).select("partition", "offset", "timestamp", "key", F.make_valid_utf8(F.col("payload").cast("string")).alias("payload"))


# sequential operators, by user in the order of events


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    return rows.select("event_id", "user_id", micros.alias("at"), (F.col("event_type") == "error").alias("failed"), F.round(F.col("value") * 60_000_000).cast("long").alias("length"))


TRACE_SQL = "trace AS (SELECT event_id, user_id, epoch_us(ts) AS moment, event_type = 'error' AS failed, round(value * 60000000)::BIGINT AS length, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(f"""WITH RECURSIVE {TRACE_SQL}, walk AS (
 SELECT user_id, k, event_id, moment, {48 * HOUR}::BIGINT - {24 * HOUR}::BIGINT AS tokens, TRUE AS admitted FROM trace WHERE k = 1
 UNION ALL SELECT t.user_id, t.k, t.event_id, t.moment, CASE WHEN least({48 * HOUR}, w.tokens + t.moment - w.moment) >= {24 * HOUR} THEN least({48 * HOUR}, w.tokens + t.moment - w.moment) - {24 * HOUR} ELSE least({48 * HOUR}, w.tokens + t.moment - w.moment) END, least({48 * HOUR}, w.tokens + t.moment - w.moment) >= {24 * HOUR} FROM walk w JOIN trace t ON t.user_id = w.user_id AND t.k = w.k + 1)
 SELECT event_id, admitted FROM walk""")
def rate_limit_admission(spark, sf_dir):
    return folds.fold(trace(spark, sf_dir), "user_id", ["at", "event_id"], ["at"], lambda: folds.Bucket(2, 24 * HOUR), lambda b, at: (b.take(at),), ["event_id"], "admitted boolean")


@query(f"""WITH RECURSIVE {TRACE_SQL}, walk AS (
 SELECT user_id, k, event_id, moment, CASE WHEN failed THEN 1 ELSE 0 END AS failures, 'closed' AS state, 0::BIGINT AS opened, TRUE AS admitted FROM trace WHERE k = 1
 UNION ALL SELECT user_id, k, event_id, moment,
  CASE WHEN now = 'open' THEN failures WHEN failed THEN failures + 1 ELSE 0 END,
  CASE WHEN now = 'open' THEN 'open' WHEN NOT failed THEN 'closed' WHEN failures + 1 >= 3 OR now = 'half_open' THEN 'open' ELSE now END,
  CASE WHEN now <> 'open' AND failed AND (failures + 1 >= 3 OR now = 'half_open') THEN moment ELSE opened END, now <> 'open'
 FROM (SELECT t.user_id, t.k, t.event_id, t.moment, t.failed, w.failures, w.opened, CASE WHEN w.state = 'open' AND t.moment - w.opened >= {6 * HOUR} THEN 'half_open' ELSE w.state END AS now FROM walk w JOIN trace t ON t.user_id = w.user_id AND t.k = w.k + 1))
 SELECT event_id, state, admitted FROM walk""")
def circuit_breaker_states(spark, sf_dir):
    def step(b: folds.Breaker, at: int, failed: bool) -> tuple:
        admitted = b.call(at, failed)
        return b.state, admitted

    return folds.fold(trace(spark, sf_dir), "user_id", ["at", "event_id"], ["at", "failed"], lambda: folds.Breaker(3, 6 * HOUR), step, ["event_id"], "state string, admitted boolean")


@query(f"""WITH RECURSIVE {TRACE_SQL}, walk AS (
 SELECT user_id, k, event_id, [moment + length] AS ends, TRUE AS admitted FROM trace WHERE k = 1
 UNION ALL SELECT user_id, k, event_id, CASE WHEN len(live) < 2 THEN list_append(live, until) ELSE live END, len(live) < 2
 FROM (SELECT t.user_id, t.k, t.event_id, t.moment + t.length AS until, list_filter(w.ends, lambda e: e > t.moment) AS live FROM walk w JOIN trace t ON t.user_id = w.user_id AND t.k = w.k + 1))
 SELECT event_id, admitted FROM walk""")
def bulkhead_admission(spark, sf_dir):
    return folds.fold(trace(spark, sf_dir), "user_id", ["at", "event_id"], ["at", "length"], lambda: folds.Bulkhead(2), lambda b, at, length: (b.enter(at, at + length),), ["event_id"], "admitted boolean")


# generator, framing, demo

_M64 = "18446744073709551615::HUGEINT"
_GENERATOR_SQL = f"""x AS (SELECT 0 AS n, {0xC0FFEE | 1}::HUGEINT AS s UNION ALL SELECT n + 1, xor(c, (c << 17) & {_M64}) FROM (SELECT n, xor(b, b >> 7) AS c FROM (SELECT n, xor(s, (s << 13) & {_M64}) AS b FROM x WHERE n < 2000))),
 made AS (SELECT n::BIGINT AS n, 'key-' || (s % 1000) AS key, rpad('record-' || (s % 1000) || '-' || n, greatest(32, length('record-' || (s % 1000) || '-' || n))::INT, '.') AS payload FROM x WHERE n > 0)"""


def generated(spark: SparkSession, total: int) -> DataFrame:
    generator.register(spark)
    return spark.read.format("logloom_generator").options(total=total, keySpace=1000, payloadBytes=32, seed=0xC0FFEE, batchSize=BATCH).load()


@query(f"WITH RECURSIVE {_GENERATOR_SQL} SELECT n, key, payload FROM made")
def generator_records(spark, sf_dir):
    return generated(spark, 2000).select("n", "key", F.col("payload").cast("string").alias("payload"))


@query(f"WITH RECURSIVE {_GENERATOR_SQL} SELECT (n - 1) // {BATCH} AS batch, count(*) AS records, 2000 - max(n) AS remaining FROM made GROUP BY 1")
def generator_batches(spark, sf_dir):
    return generated(spark, 2000).groupBy("batch").agg(F.count("*").alias("records"), (F.lit(2000) - F.max("n")).alias("remaining"))


def _le_sql(x: str, size: int) -> str:
    return "concat(" + ", ".join(f"substr(lpad(lower(hex(({x})::UBIGINT)), {2 * size}, '0'), {2 * i + 1}, 2)" for i in range(size - 1, -1, -1)) + ")"


@query(f"""WITH {LOG_SQL} SELECT partition, "offset", concat({_le_sql('"offset"', 8)}, {_le_sql('epoch_us("timestamp") // 1000', 8)}, '01', {_le_sql("strlen(key)", 4)}, lower(hex(encode(key))), {_le_sql("strlen(payload)", 4)}, lower(hex(encode(payload)))) AS frame_hex FROM log""")
def codec_encode(spark, sf_dir):
    return log(spark, sf_dir).select("partition", "offset", framing.frame_hex(F.col("offset"), F.col("timestamp"), F.col("key"), F.col("payload")).alias("frame_hex"))


@query(f"""WITH {LOG_SQL} SELECT 'events/' || partition || '/' || lpad(("offset" // {SEGMENT} * {SEGMENT})::VARCHAR, 20, '0') || '.log' AS segment, "offset", date_trunc('millisecond', "timestamp") AS "timestamp", key, payload FROM log""")
def codec_roundtrip(spark, sf_dir):
    return segments.decode(segments.images(log(spark, sf_dir), SEGMENT)).withColumn("payload", F.col("payload").cast("string"))


@query(f"""WITH {LOG_SQL}, framed AS (SELECT partition, "offset" // {SEGMENT} * {SEGMENT} AS base, count(*) AS n, sum(8 + 8 + 1 + 4 + strlen(key) + 4 + strlen(payload)) AS bytes, arg_max(8 + 8 + 1 + 4 + strlen(key) + 4 + strlen(payload), "offset") AS last FROM log GROUP BY 1, 2)
 SELECT 'events/' || partition || '/' || lpad(base::VARCHAR, 20, '0') || '.log' AS segment, n - 1 AS records, (bytes - last)::BIGINT AS valid_bytes FROM framed""")
def crash_tail_recovery(spark, sf_dir):
    whole = segments.images(log(spark, sf_dir), SEGMENT)
    cut = whole.withColumn("data", F.expr("substring(data, 1, length(data) - 5)"))  # the last write didn't end
    return segments.recover(cut).select("segment", "records", "valid_bytes")


@query("SELECT 20000::BIGINT AS sourced, count(*) FILTER (i % 500 <> 0) AS delivered, count(*) FILTER (i % 500 = 0) AS dead_lettered, count(*) FILTER (i % 500 = 0) AS dlq_size FROM range(0, 20000) t(i)")
def pipeline_summary(spark, sf_dir):
    """The demo: 20,000 generated records, poison at every 500th offset."""
    made = generated(spark, 20_000).select(F.lit("demo").alias("topic"), F.lit(0).alias("partition"), F.col("n").alias("seq"), "key", "payload")
    rows = offsets.with_offsets(made, ["topic", "partition"], "seq")
    failed = F.count_if(delivery.poisoned(F.col("offset"), FAIL))
    return rows.agg(F.count("*").alias("sourced"), (F.count("*") - failed).alias("delivered"), failed.alias("dead_lettered"), failed.alias("dlq_size"))
