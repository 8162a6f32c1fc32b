"""Facade, connectors and streaming queries over a real folder."""

import pytest
from pyspark.sql import functions as F

from logloom.engine import LogEngine
from logloom.operators import folds
from logloom.schemas import LogError, LogOptions, SinkOptions
from logloom.sources import generator
from logloom.streaming import runtime


def batch(spark, *rows):
    return spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(rows)], "seq long, key string, payload binary")


def code(f):
    with pytest.raises(LogError) as e:
        f()
    return e.value.code


def test_create_produce_fetch(spark, tmp_path):
    engine = LogEngine(spark, str(tmp_path), LogOptions(max_topics=3))
    engine.create_topic("orders", 1)
    r = engine.produce("orders", batch(spark, ("k", b"hello"), (None, b"world")))
    assert (r.base_offset, r.last_offset, r["count"], r.truncated_to) == (0, 1, 2, None)
    rows, cursor = engine.fetch("orders", 0, 0)
    assert [bytes(x.payload) for x in rows.collect()] == [b"hello", b"world"] and tuple(cursor) == (2, 2)
    rows, cursor = engine.fetch("orders", 0, 7)
    assert rows.count() == 0 and tuple(cursor) == (7, 2)
    assert engine.fetch("orders", 0, 0, 0)[0].count() == 1
    assert code(lambda: engine.produce("orders", batch(spark))) == "EMPTY_BATCH"
    assert code(lambda: engine.produce("orders", batch(spark, (None, b"")))) == "EMPTY_PAYLOAD"
    assert code(lambda: engine.produce("no", batch(spark, (None, b"x")))) == "TOPIC_NOT_FOUND"
    assert code(lambda: engine.fetch("orders", 1)) == "PARTITION_OUT_OF_RANGE"
    assert code(lambda: engine.fetch("no", 0)) == "TOPIC_NOT_FOUND"
    assert code(lambda: engine.create_topic("orders")) == "TOPIC_EXISTS"
    assert code(lambda: engine.create_topic("bad name")) == "INVALID_TOPIC_CHAR"
    assert engine.create_topic("p", 0).partitions == 3
    engine.create_topic("q", 2)
    assert code(lambda: engine.create_topic("orders")) == "CAPACITY_EXCEEDED"
    s = engine.stats().first()
    assert (s.topics, s.partitions, s.records, s.segments, s.produced_total, s.fetched_total) == (3, 6, 2, 1, 2, 3)
    assert [x.name for x in engine.topics().collect()] == ["orders", "p", "q"]
    kinds = [(x.kind, x.topic) for x in engine.events(["orders"]).collect()]
    assert sorted(kinds) == [("records_appended", "orders"), ("topic_created", "orders")]
    again = LogEngine(spark, str(tmp_path))  # a restart goes on
    assert again.produce("orders", batch(spark, ("k", b"x"))).base_offset == 2


def test_rate_limit(spark, tmp_path):
    engine = LogEngine(spark, str(tmp_path), LogOptions(rate_per_second=0.001, burst=2))
    engine.create_topic("t")
    engine.produce("t", batch(spark, ("a", b"1"), ("a", b"2")))
    assert code(lambda: engine.produce("t", batch(spark, ("a", b"1")))) == "RATE_LIMITED"
    assert {r.metric: r.value for r in engine.counters().collect()}["produce_rate_limited_total"] == 1


def test_append_is_seen_once_however_often_it_dies(spark, tmp_path):
    """Deaths before and after the commit, and a source whose rows differ each time they are computed."""
    engine = LogEngine(spark, str(tmp_path))
    engine.create_topic("t")
    rows = spark.range(10).select(F.col("id").alias("seq"), F.lit(None).cast("string").alias("key"), F.uuid().cast("binary").alias("payload")).where(F.rand() < 0.9)

    def die(row):
        raise ConnectionError

    for _ in range(2):
        dying = LogEngine(spark, str(tmp_path))
        dying._commit = die
        with pytest.raises(ConnectionError):
            dying.append("t", 0, rows, batch="b-0")
    assert engine.log().count() == 0 and engine.stats().first().records == 0
    first = engine.append("t", 0, rows, batch="b-0")
    again = LogEngine(spark, str(tmp_path)).append("t", 0, rows, batch="b-0")
    assert again["count"] == first["count"] and again.base_offset == 0
    kept = [r.offset for r in engine.log().orderBy("offset").collect()]
    assert kept == list(range(first["count"])) and engine.stats().first().records == first["count"]


def test_versions_outlast_a_clock_that_goes_back(spark, tmp_path, monkeypatch):
    engine = LogEngine(spark, str(tmp_path))
    engine.create_topic("t")
    engine.save_checkpoint("s", "t", 0, 5)
    monkeypatch.setattr("time.time_ns", lambda: 1)
    engine.save_checkpoint("s", "t", 0, 7)
    LogEngine(spark, str(tmp_path)).save_checkpoint("s", "t", 0, 9)
    assert engine.load_checkpoint("s", "t", 0) == 9


def test_dead_letters_of_a_batch_that_runs_twice(spark, tmp_path, monkeypatch):
    engine = LogEngine(spark, str(tmp_path))
    engine.create_topic("t")
    engine.append("t", 0, batch(spark, *[(None, b"x")] * 6))
    save = engine.save_checkpoint
    monkeypatch.setattr(engine, "save_checkpoint", lambda *a: (_ for _ in ()).throw(ConnectionError()))
    with pytest.raises(ConnectionError):  # dies after its dead letters, before its checkpoint
        runtime.run_once(engine, "s", "t", 0, runtime.FailingSink(2))
    monkeypatch.setattr(engine, "save_checkpoint", save)
    runtime.drain(engine, "s", "t", 0, runtime.FailingSink(2))
    assert sorted(r.offset for r in engine.dead_letters().collect()) == [0, 2, 4]
    engine.replace_dead_letters("s", engine.dead_letters().where("offset = 2"))
    assert [r.offset for r in engine.dead_letters().collect()] == [2]


def test_supervisor_goes_on_after_a_restart(spark, tmp_path):
    made = lambda tick: spark.createDataFrame([(i, "k", b"%d" % tick) for i in range(4)], "seq long, key string, payload binary")
    for ticks in (2, 1):
        last = runtime.supervise(LogEngine(spark, str(tmp_path)), "t", 0, made, "src", "snk", runtime.FailingSink(5), ticks=ticks, pause=0)
    engine = LogEngine(spark, str(tmp_path))
    assert last["produced"] == 12 and [bytes(r.payload) for r in engine.log().orderBy("offset").collect()] == [b"0"] * 4 + [b"1"] * 4 + [b"2"] * 4
    status = {r.id: (r.kind, r.processed, r.dead_lettered, r.checkpoint) for r in engine.connectors().collect()}
    assert status == {"src": ("source", 12, 0, 0), "snk": ("sink", 9, 3, 12)}


def test_retention_and_prune(spark, tmp_path):
    engine = LogEngine(spark, str(tmp_path))
    engine.create_topic("t", 1, 2, 4)
    cuts = [engine.append("t", 0, batch(spark, (None, b"x"))).truncated_to for _ in range(7)]
    assert cuts == [None, None, None, None, 2, None, 4]
    rows, cursor = engine.fetch("t", 0, 0)
    assert [r.offset for r in rows.collect()] == [4, 5, 6] and tuple(cursor) == (7, 7)
    assert len(engine.prune()) == 2
    assert [r.offset for r in engine.fetch("t", 0, 0)[0].collect()] == [4, 5, 6]


def test_sink_drains_with_dead_letters(spark, tmp_path):
    engine = LogEngine(spark, str(tmp_path))
    engine.create_topic("t")
    engine.append("t", 0, batch(spark, *[(None, b"x")] * 7))
    total = runtime.drain(engine, "sink-1", "t", 0, runtime.FailingSink(3), SinkOptions(batch_size=3))
    assert total == {"polled": 7, "delivered": 4, "dead_lettered": 3, "checkpoint": 7}
    dead = engine.dead_letters().orderBy("offset").collect()
    assert [(d.offset, d.attempts, d.reason) for d in dead] == [(o, 3, f"permanent failure: poison record at offset {o}") for o in (0, 3, 6)]
    s = engine.connectors().first()
    assert (s.id, s.guarantee, s.processed, s.dead_lettered, s.checkpoint) == ("sink-1", "at_least_once", 4, 3, 7)
    assert runtime.run_once(engine, "sink-1", "t", 0, runtime.FailingSink(3))["polled"] == 0
    counters = {r.metric: r.value for r in engine.counters().collect()}
    assert counters == {"topic_created_total": 1, "records_appended_total": 1, "records_produced_total": 7, "records_delivered_total": 4, "records_dead_lettered_total": 3, "dlq_size": 3, "records_fetched_total": 0, "produce_rate_limited_total": 0}


def crash_at(offset):
    """A sink that dies at an offset; a closure, so that workers need not import this module."""

    def sink(record):
        if record["offset"] == offset:
            raise RuntimeError("Boom")

    return sink


@pytest.mark.parametrize(("guarantee", "next_offset"), [("at_least_once", 0), ("at_most_once", 3)])
def test_crash_in_a_batch(spark, tmp_path, guarantee, next_offset):
    engine = LogEngine(spark, str(tmp_path))
    engine.create_topic("t")
    engine.append("t", 0, batch(spark, *[(None, b"x")] * 5))
    with pytest.raises(Exception, match="Boom"):
        runtime.run_once(engine, "s", "t", 0, crash_at(1), SinkOptions(guarantee=guarantee, batch_size=3))
    assert (engine.load_checkpoint("s", "t", 0) or 0) == next_offset
    assert runtime.drain(engine, "s", "t", 0, runtime.FailingSink(0), SinkOptions(guarantee=guarantee))["delivered"] == 5 - next_offset


def test_retries():
    calls = []

    def flaky(record):
        calls.append(record)
        if len(calls) < 3:
            raise runtime.SinkError("transient", "later")

    assert runtime.deliver_one(flaky, {}, SinkOptions(base_backoff_ms=0)) is None and len(calls) == 3
    calls.clear()
    assert runtime.deliver_one(flaky, {}, SinkOptions(base_backoff_ms=0, max_attempts=2)) == "transient failure: later"

    def broken(record):
        calls.append(record)
        raise runtime.SinkError("permanent", "no")

    calls.clear()
    assert runtime.deliver_one(broken, {}, SinkOptions()) == "permanent failure: no" and len(calls) == 1


def test_source_stream_appends_once(spark, tmp_path):
    generator.register(spark)
    engine = LogEngine(spark, f"{tmp_path}/log")
    engine.create_topic("t")
    stream = spark.readStream.format("logloom_generator").options(total=40, batchSize=15, keySpace=5, partitions=2).load().select(F.col("n").alias("seq"), "key", "payload")
    query = runtime.source_to_log(engine, stream, "t", 0, "source-1", f"{tmp_path}/cp", processingTime="0 seconds")
    runtime.stop_when_done(query, lambda: engine._bounds("t", 0)[1] >= 40)
    rows, _ = engine.fetch("t", 0, 0)
    assert [r.offset for r in rows.collect()] == list(range(40))
    known = engine.append("t", 0, batch(spark, (None, b"x")), 1, "source-1-0")
    assert known["count"] == 15 and engine._bounds("t", 0)[1] == 40


@pytest.mark.parametrize("guarantee", ["at_least_once", "at_most_once"])
def test_sink_stream_keeps_dead_letters_and_checkpoints(spark, tmp_path, guarantee):
    engine = LogEngine(spark, f"{tmp_path}/log")
    engine.create_topic("t", 2)
    options = SinkOptions(guarantee=guarantee)

    def run():
        runtime.log_to_sink(engine, "s", ["t"], runtime.FailingSink(3), options, f"{tmp_path}/cp", availableNow=True).awaitTermination()

    def seen():
        metrics = {r.metric: r.value for r in engine.counters().collect()}
        s = engine.connectors().where("id = 's'").first()
        dead = sorted((d.connector, d.topic, d.partition, d.offset, d.payload, d.attempts) for d in engine.dead_letters().collect())
        return dead, (s.guarantee, s.processed, s.dead_lettered, s.checkpoint), [engine.load_checkpoint("s", "t", p) for p in (0, 1)], metrics["dlq_size"], metrics["records_dead_lettered_total"]

    engine.append("t", 0, batch(spark, *[(None, b"x")] * 5))
    run()
    engine.append("t", 0, batch(spark, *[(None, b"y")] * 3))
    engine.append("t", 1, batch(spark, *[(None, b"z")] * 2))
    run()
    dead = [("s", "t", 0, 0, b"x", 3), ("s", "t", 0, 3, b"x", 3), ("s", "t", 0, 6, b"y", 3), ("s", "t", 1, 0, b"z", 3)]
    want = (dead, (guarantee, 6, 4, 8), [8, 2], 4, 4)
    assert seen() == want
    # the last batch's end is lost, so that it is run again: nothing counts twice
    for name in ("1", ".1.crc"):
        (tmp_path / "cp/commits" / name).unlink(missing_ok=True)
    run()
    assert seen() == want
    # dead letters of a drain stand beside the stream's
    assert runtime.drain(engine, "other", "t", 0, runtime.FailingSink(3))["dead_lettered"] == 3 and engine.dead_letters().count() == 7


def test_at_most_once_stream_passes_over_a_claim(spark, tmp_path):
    engine = LogEngine(spark, f"{tmp_path}/log")
    engine.create_topic("t")
    engine.append("t", 0, batch(spark, *[(None, b"x")] * 4))

    def run(sink, options, name):
        q = runtime.log_to_sink(engine, name, None, sink, options, f"{tmp_path}/cp-{name}", availableNow=True)
        q.awaitTermination()

    out = lambda name: sorted(r.offset for r in spark.read.parquet(f"{tmp_path}/log/deliveries/{name}").collect())
    with pytest.raises(Exception, match="Boom"):
        run(crash_at(2), SinkOptions(), "once")
    run(runtime.FailingSink(0), SinkOptions(), "once")
    assert out("once") == [0, 1, 2, 3]
    most = SinkOptions(guarantee="at_most_once")
    with pytest.raises(Exception, match="Boom"):
        run(crash_at(2), most, "most")
    run(runtime.FailingSink(0), most, "most")
    assert not engine._exists(f"{tmp_path}/log/deliveries/most/batch=0/_SUCCESS")


def test_subscription(spark, tmp_path):
    engine = LogEngine(spark, f"{tmp_path}/log")
    engine.create_topic("a")
    engine.create_topic("b")
    q = engine.subscribe(["b"]).writeStream.format("memory").queryName("subscribed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert [r.topic for r in spark.sql("select * from subscribed").collect()] == ["b"]


def test_bucket_breaker_bulkhead():
    b = folds.Bucket(2, 1_000_000)
    assert [b.take(0), b.take(0), b.take(0), b.take(1_000_000), b.take(1_000_001)] == [True, True, False, True, False]
    assert folds.Bucket(2, 10).take(0, 3) is False
    c = folds.Breaker(2, 10)
    assert [c.call(0, True), c.call(1, True), c.call(2, False), c.state] == [True, True, False, "open"]
    assert c.call(11, True) and c.state == "open" and c.call(21, False) and c.state == "closed"
    h = folds.Bulkhead(2)
    assert [h.enter(0, 10), h.enter(0, 5), h.enter(4, 9), h.enter(5, 9)] == [True, True, False, True]


def test_demo(spark, tmp_path):
    from logloom import demo

    got = demo.run(spark, str(tmp_path), records=1200, keys=50, fail_every=500)
    assert {k: got[k] for k in ("sourced", "delivered", "dead_lettered", "dlq_size")} == {"sourced": 1200, "delivered": 1197, "dead_lettered": 3, "dlq_size": 3}
