"""Demo: generated records through a log to a sink that fails at times.

python -m logloom.demo --records 20000 --keys 1000 --fail-every 500 [--data-dir DIR]
python -m logloom.demo --ticks N: a source of 200 records a tick and the sink side by side, N times (0: until it is ended).
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logloom.engine import LogEngine, scratch
from logloom.schemas import SinkOptions
from logloom.sources import generator
from logloom.streaming import runtime


def run(spark: SparkSession, root: str, records: int = 20_000, keys: int = 1_000, fail_every: int = 500, topic: str = "demo", batch_size: int | None = None) -> dict:
    """sourced, delivered, dead_lettered, dlq_size, seconds."""
    generator.register(spark)
    engine = LogEngine(spark, root)
    engine.create_topic(topic, 1)
    began = time.perf_counter()
    made = spark.read.format("logloom_generator").options(total=records, keySpace=keys, seed=0xC0FFEE).load()
    engine.append(topic, 0, made.select(F.col("n").alias("seq"), "key", "payload"), records, "demo-source-0")
    total = runtime.drain(engine, "demo-sink", topic, 0, runtime.FailingSink(fail_every), SinkOptions(batch_size=batch_size or records))
    seconds = time.perf_counter() - began
    return {"sourced": records, "delivered": total["delivered"], "dead_lettered": total["dead_lettered"], "dlq_size": engine.dead_letters().count(), "seconds": round(seconds, 3)}


def supervised(spark: SparkSession, root: str, ticks: int | None, keys: int = 1_000, fail_every: int = 500, topic: str = "connector-demo", pause: float = 2.0) -> dict:
    generator.register(spark)
    total = 200
    made = lambda tick: spark.read.format("logloom_generator").options(total=total * (tick + 1), keySpace=keys, seed=0xC0FFEE).load().where(F.col("n") > total * tick).select(F.col("n").alias("seq"), "key", "payload")
    return runtime.supervise(LogEngine(spark, root), topic, 0, made, "stream-source", "logging-sink", runtime.FailingSink(fail_every), ticks=ticks, pause=pause)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--records", type=int, default=20_000)
    args.add_argument("--keys", type=int, default=1_000)
    args.add_argument("--fail-every", type=int, default=500)
    args.add_argument("--data-dir")
    args.add_argument("--ticks", type=int)
    given = args.parse_args()
    spark = SparkSession.builder.appName("logloom demo").getOrCreate()
    if given.ticks is not None:
        print(supervised(spark, given.data_dir or scratch(spark), given.ticks or None, given.keys, given.fail_every))
        return
    for name, value in run(spark, given.data_dir or scratch(spark), given.records, given.keys, given.fail_every).items():
        print(f"  {name:<14}: {value}")
    spark.stop()


if __name__ == "__main__":
    main()
