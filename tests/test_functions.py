"""Expressions against plain Python."""

import datetime
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions import framing, hashing, validate
from logloom.operators import offsets, retention, routing
from logloom.sources import generator, segments


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv_of_any_text(spark):
    texts = ["", "user-8", "user-42", "é", "日本", "a" * 300, None, "\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "k string")
    for r in df.select("k", hashing.fnv1a_hex(F.col("k")).alias("x"), hashing.fnv1a_mod(F.col("k"), 7).alias("m")).collect():
        if r.k is None:
            assert r.x is None and r.m is None
        else:
            assert (r.x, r.m) == (f"{fnv(r.k.encode()):016x}", fnv(r.k.encode()) % 7)
    assert f"{fnv(b'user-8'):016x}" == "f84b9baa754a3fef"


def test_routes(spark):
    rows = [(0, 0, None), (0, 1, "x"), (1, 2, "user-42"), (1, 3, None), (2, 4, None)]
    got = {r.batch_id: (r.partition, r.n) for r in routing.batches(spark.createDataFrame(rows, "batch_id long, seq long, key string"), 8).collect()}
    assert got == {0: (0, 2), 1: (3, 2), 2: (1, 1)}


def test_validation(spark):
    cases = {"orders.v1_2-A": None, "": "EMPTY_TOPIC_NAME", "bad name": "INVALID_TOPIC_CHAR", "a" * 256: "TOPIC_NAME_TOO_LONG", "a\n": "INVALID_TOPIC_CHAR", "é" * 128: "TOPIC_NAME_TOO_LONG"}
    df = spark.createDataFrame([(k,) for k in cases], "k string").select("k", validate.topic_code(F.col("k")).alias("c"), validate.connector_code(F.col("k")).alias("d"))
    assert {r.k: r.c for r in df.collect()} == cases
    assert df.where(F.col("k") == "a" * 256).first().d == "TOPIC_NAME_TOO_LONG"
    sizes = spark.createDataFrame([(b"",), (b"x",), (bytes(schemas.MAX_PAYLOAD_BYTES + 1),)], "p binary").select(validate.payload_code(F.col("p")).alias("c"))
    assert [r.c for r in sizes.collect()] == ["EMPTY_PAYLOAD", None, "PAYLOAD_TOO_LARGE"]


def stores(batches, s, m):
    """Plain models: (start, segments) of a store that drops whole head segments, and of one that drops records."""
    segs, n, first = [], 0, 0
    for k in batches:
        for _ in range(k):
            if not segs or segs[-1][1] >= s:
                segs.append([n, 0])
            segs[-1][1] += 1
            n += 1
        while m and sum(x[1] for x in segs) > m and len(segs) > 1:
            segs.pop(0)
        first = max(first, n - m) if m else 0
    return n, (segs[0][0] if segs else 0, len(segs)), (min(first, max(n - 1, 0)) if n else 0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 6), st.integers(1, 20)), min_size=1, max_size=8))
def test_retention_models(cases):
    for batches, s, m in cases:
        n, (start, count), exact = stores(batches, s, m)
        last = (n - 1) // s * s
        assert start == min(last, -(-max(0, n - m) // s) * s) and count == (last - start) // s + 1 and exact == max(0, n - m)


def test_retention_columns(spark):
    df = spark.createDataFrame([(0, n) for n in (1, 4, 5, 6, 10, 0)], "partition int, n long")
    got = {r.high_watermark: (r.start_offset, r.retained, r.segments) for r in retention.segmented(df, 2, 4).collect()}
    assert got[10] == (6, 4, 2) and got[0] == (0, 0, 0)
    assert {r.high_watermark: r.start_offset for r in retention.exact(df, 2, 3).collect()}[6] == 3


def test_offsets_are_dense_over_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("int").alias("partition"))
    rows = offsets.with_offsets(df, ["partition"], "seq", block=64).collect()
    for p in range(3):
        assert [r.offset for r in sorted(rows, key=lambda r: r.seq) if r.partition == p] == list(range(len(range(p, 1000, 3))))


def plain_frame(o, ms, key, payload):
    k = b"\x00" if key is None else b"\x01" + struct.pack("<I", len(key.encode())) + key.encode()
    return struct.pack("<Qq", o, ms) + k + struct.pack("<I", len(payload)) + payload


def test_frames(spark):
    ts = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(0, ts, "kä", b"p\xff"), (1, ts, None, b"q"), (2, ts, "", b"r")]
    df = spark.createDataFrame(rows, "offset long, timestamp timestamp_ntz, key string, payload binary")
    ms = int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    got = [bytes(r[0]) for r in df.orderBy("offset").select(framing.frame(F.col("offset"), F.col("timestamp"), F.col("key"), F.col("payload"))).collect()]
    assert got == [plain_frame(o, ms, k, p) for o, _, k, p in rows]
    data = b"".join(got)
    for cut in range(len(data) + 1):
        found, valid = framing.parse(data[:cut])
        ends = [sum(map(len, got[: i + 1])) for i in range(3)]
        assert len(found) == sum(e <= cut for e in ends) and valid == max([0, *(e for e in ends if e <= cut)])


def test_segment_files(spark, tmp_path):
    data = plain_frame(5, 1000, "k5", b"p5") + plain_frame(6, 2000, None, b"p6")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "00000000000000000005.log").write_bytes(data + b"\x07\x00")
    loaded = segments.load(spark, str(tmp_path))
    assert [(r.offset, r.key, bytes(r.payload)) for r in segments.decode(loaded).collect()] == [(5, "k5", b"p5"), (6, None, b"p6")]
    r = segments.recover(loaded).first()
    assert (r.records, r.valid_bytes, bytes(r.data)) == (2, len(data), data)


@pytest.mark.parametrize("seed", [0, 42, 0xC0FFEE])
def test_generator_jumps(seed):
    x = seed | 1
    for n in range(200):
        assert generator.jump(seed | 1, n) == x
        x = generator.step(x)
    assert [generator.step(0xC0FFEE | 1), generator.jump(0xC0FFEE | 1, 2)] == [13614285660054992, 13905813403210831643]


def test_generator_partitions_agree(spark):
    generator.register(spark)
    read = lambda parts: [tuple(r) for r in spark.read.format("logloom_generator").options(total=100, keySpace=4, seed=7, partitions=parts, payloadBytes=8).load().orderBy("n").collect()]
    one = read(1)
    assert one == read(7) and len(one) == 100 and {r[2] for r in one} <= {f"key-{i}" for i in range(4)}
    assert spark.read.format("logloom_generator").options(total=0).load().count() == 0
