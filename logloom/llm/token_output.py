"""Token-id files in Simple-8b coding, in ascending id order, and their reader.

A file set is a Parquet folder of shards. A shard holds whole documents: their ids, how many tokens each has, the
number of token ids before the shard in its part (``before``), the words of each 128-id block and the words
themselves. Parts are ranges of document ids, so all shards in order of (part, before) hold all token ids in
ascending order of document id; only the totals of the parts (one number a part) meet in the driver.

Cases: null text counts as empty (the end id alone); a null document id comes first; equal document ids stay
beside each other, in an order that isn't promised; an empty table gives an empty file set; columns besides the
two named ones are ignored. Document ids are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import byte_bpe, simple8b, tables
from logloom.llm import textblocks as tb

BLOCK_BYTES = 16 << 20
#: A shard ends with the document that brings it to so many token ids.
SHARD_IDS = 1 << 20
SHARDS = "part int, before long, ids long, doc_ids array<long>, doc_tokens array<long>, block_words binary, words binary"


def packed(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int], id_col: str, text_col: str) -> DataFrame:
    """part, id, tokens, block_words, words of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(tokenizer)
        for batch in batches:
            for rows in tb.blocks(batch, text_col, BLOCK_BYTES):
                ids, at = bpe.encode(rows.column(1), bpe.table.merge_all)
                n = rows.num_rows
                ended = np.full(len(ids) + n, end_id, np.uint32)
                own = np.ones(len(ended), bool)
                own[at[1:] + np.arange(n)] = False
                ended[own] = ids
                words, used, n_blocks = simple8b.encode(ended, np.diff(at) + 1)
                edge = np.concatenate(([0], np.cumsum(n_blocks)))
                total = np.concatenate(([0], np.cumsum(used)))[edge]
                key = rows.column(0).cast(pa.int64())
                part = np.searchsorted(np.array(bounds, np.int64), key.fill_null(0).to_numpy(), "right").astype(np.int32)
                part[key.is_null().to_numpy(zero_copy_only=False)] = 0
                small = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(used.astype(np.uint8))])
                large = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((8 * total).astype(np.int32)), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([pa.array(part), key, pa.array(np.diff(at) + 1), small, large], ["part", "id", "tokens", "block_words", "words"])

    return docs.select(id_col, text_col).mapInArrow(run, "part int, id long, tokens long, block_words binary, words binary")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order of (part, id) into shards."""
    part, before, held, ids = None, 0, [], 0

    def shard() -> pa.RecordBatch:
        docs, tokens, small, large = zip(*held, strict=True)
        rows = [part, before, ids, list(docs), list(tokens), b"".join(small), b"".join(large)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["part", "before", "ids", "doc_ids", "doc_tokens", "block_words", "words"])

    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (p != part or ids >= SHARD_IDS):
                yield shard()
                before, held, ids = (before + ids if p == part else 0), [], 0
            elif p != part:
                before = 0
            part = p
            held.append(row)
            ids += row[1]
    if held:
        yield shard()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text, ends it with ``end_id`` and writes a file set to ``path``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(id_col, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    bounds = sorted(set(cuts or []))
    rows = packed(docs, tokenizer, end_id, bounds, id_col, text_col)
    rows = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first())
    rows.mapInArrow(_shards, SHARDS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (token ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for."""
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = dict(shards.groupBy("part").agg(F.sum("ids").alias("n")).collect())  # a number for each range of ids
    first, base = {}, 0
    for part in sorted(totals):
        first[part] = base
        base += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, _, docs, tokens, small, large in zip(*(batch.column(x).to_pylist() for x in ("part", "before", "ids", "doc_ids", "doc_tokens", "block_words", "words")), strict=True):
                count = np.array(tokens, np.int64)
                n_blocks = -(-count // simple8b.BLOCK)
                last = np.cumsum(n_blocks)
                values = np.full(int(n_blocks.sum()), simple8b.BLOCK, np.int64)
                values[last - 1] = count - (n_blocks - 1) * simple8b.BLOCK
                ids = simple8b.decode(np.frombuffer(large, np.uint64), np.frombuffer(small, np.uint8).astype(np.int64), values).astype("<u4")
                end = np.cumsum(count)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((end - count).tolist(), end.tolist(), strict=True)]
                out = [pa.array(docs, pa.int64()), pa.array(first[part] + before + end - count), pa.array(count), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], end)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A file set in the shared folder, written and read back."""
    import uuid

    path = f"{tables.shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, end_id, path, id_col, text_col)
    return read_token_files(docs.sparkSession, path)
