"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import textblocks as tb


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset, as in tests on one machine."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, *partition_by: str, **options: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read from there: later jobs neither compute them again nor lose them with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.options(**options)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name from ``name`` that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: Up to so many rows of one or two small columns, a side of a join is broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000


def small_or_not(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The narrow side of a join with a broadcast hint if it has ``most`` rows or fewer, counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None = None, hot_rows: int = 1_000, salts: int = 32) -> DataFrame:
    """left join on ``keys``, of which ``right`` has one row a value. Keys with more than ``hot_rows`` rows on the left are dealt over ``salts`` tasks.

    hot: those keys, if they are known; else the left side is counted. Null keys match nothing; rows of the left are
    neither lost nor repeated; empty sides are fine. Apart from the keys the two sides share no column names.
    """
    mark, salt = fresh(left, "hot"), fresh(left, "salt")
    if hot is None:
        hot = left.groupBy(*keys).count().where(F.col("count") > hot_rows)
    hot = written(hot.select(*keys, F.lit(True).alias(mark)), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, "left")
    hot = small_or_not(hot)
    dealt = left.join(hot, keys, "left").withColumn(salt, F.when(F.col(mark), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0)).drop(mark)
    copied = right.join(hot, keys, "left").withColumn(salt, F.explode(F.when(F.col(mark), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(mark)
    return dealt.join(copied, [*keys, salt], "left").drop(salt)


def extended(docs: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]], into: str | None = None, block_bytes: int = tb.BLOCK_BYTES) -> DataFrame:
    """The named columns, and the columns ``fields`` that make() gives for each block of texts.

    Columns of docs that have the name of a new one give way to it; with ``into`` the new ones go into one struct of
    that name and all columns stay.
    """
    names = [f.name for f in fields]
    new = {n.lower() for n in ([into] if into else names)}
    keep = [c for c in keep if c.lower() not in new]
    own = text_col in keep
    at = keep.index(text_col) if own else len(keep)
    kinds = [docs.schema[c] for c in keep] + ([T.StructField(into, T.StructType(fields))] if into else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.blocks(batch, at, block_bytes):
                made = make(part.column(at))
                columns = part.columns[: len(keep)] + ([pa.StructArray.from_arrays(made, names)] if into else made)
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in kinds])

    sent = [F.col(f"`{c}`") for c in keep]
    return docs.select(*sent, *[F.col(text_col).alias(fresh(docs, "text"))] * (not own)).mapInArrow(run, T.StructType(kinds))
