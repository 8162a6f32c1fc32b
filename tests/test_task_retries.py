"""Deliveries where Spark runs a failed task again, as it does on a cluster."""

import os
import subprocess
import sys

import duckdb
import pytest

from logloom.plans import catalogue

SESSION = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession

tmp, sf = sys.argv[1:]
spark = SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tmp + "/shared").config("spark.sql.warehouse.dir", tmp + "/warehouse").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
"""

RECOVERS = """
from logloom.engine import LogEngine
from logloom.schemas import SinkOptions
from logloom.streaming import runtime

engine = LogEngine(spark, tmp + "/log")
engine.create_topic("t")
engine.append("t", 0, spark.createDataFrame([(i, None, b"x") for i in range(5)], "seq long, key string, payload binary"))
seen = tmp + "/seen"

def sink(record):
    from pyspark import TaskContext
    if record["offset"] == 3 and not TaskContext.get().attemptNumber():
        raise RuntimeError("Boom")
    with open(seen, "a") as f:
        f.write(f"{record['offset']} ")

for guarantee in ("at_most_once", "at_least_once"):
    try:
        runtime.drain(engine, guarantee, "t", 0, sink, SinkOptions(guarantee=guarantee))
    except Exception:
        pass
    print(Path(seen).read_text(), engine.load_checkpoint(guarantee, "t", 0), sep="|")
    Path(seen).unlink()
"""

REPLAY = """
from logloom.plans import catalogue

print(*catalogue.QUERIES["%s"](spark, sf).first())
"""


def run(code, tmp_path, sf):
    out = subprocess.run([sys.executable, "-c", SESSION + code, str(tmp_path), sf], capture_output=True, text=True, env=os.environ, check=True)
    return out.stdout.strip().splitlines()


def test_at_most_once_delivers_nothing_again(tmp_path, sf):
    most, least = run(RECOVERS, tmp_path, sf)
    assert most == "0 1 2 |5"
    assert least == "0 1 2 0 1 2 3 4 |5"


@pytest.mark.parametrize("name", ["replay_at_most_once", "replay_at_least_once"])
def test_replay(tmp_path, name):
    """Enough events for a batch that breaks off."""
    duckdb.execute(f"copy (select i as event_id, timestamp '2024-01-01' as ts, i % 997 as user_id, 'view' as event_type, 1.0::double as value, '' as props from range(6000) t(i)) to '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name]).fetchone()
    assert want[2] + want[3] > 100
    assert run(REPLAY % name, tmp_path, str(tmp_path))[-1] == " ".join(map(str, want))
