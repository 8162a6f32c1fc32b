"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Words and word pairs are hashed into buckets. One multinomial is counted over the trusted documents, one over all
documents. A document's score is the mean over its n-grams of the log ratio of the two, so its length doesn't
matter; every document meets the same threshold. A bucket's ratio is (trusted + k) / (expected + k), where
expected is the raw count scaled to the trusted total: buckets that were hardly seen say nothing.

Buckets grow with the square root of the corpus: 2 ** (5 + log2(bytes) / 2) of them, 2 ** 16 at least.

Cases: null or empty text has no words: zero counts, base_failed. Equal texts get equal rows. Repeated or
contradicting labels of a document: it is trusted if its lowest quality label is 1. Without labels every ratio
is 1 and only the base rules decide. An empty table gives an empty result; a null id stays null and is never
trusted. The driver holds one pair of counts a bucket; a very long text is a block of its own.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import tables
from logloom.llm import textblocks as tb

#: Ranges of buckets that counts are sent and summed by.
PARTS = 256
SYMBOLS = np.zeros(256, bool)
#: The symbols of the rule.
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclasses.dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: 2 ** bits buckets; None: by the bytes of all texts.
    bits: int | None = None
    #: k above, in n-grams.
    weight: float = 20.0
    #: Mean log ratio from which a document is kept.
    threshold: float = -0.15


def _words(rows: pa.RecordBatch, column: int) -> tuple[tb.Words, np.ndarray]:
    words = tb.Words(*tb.flat(rows.column(column)))
    return words, words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)


def _ngrams(words: tb.Words, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text of each."""
    pairs, pair_text, _ = tb.windows(hashes, words.first, 2)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    return np.concatenate((tb.mixed(hashes), pairs)) >> np.uint64(64 - bits), np.concatenate((text, pair_text))


def bits_for(total: int) -> int:
    """Bits of a bucket's number for so many bytes of text."""
    return max(16, math.ceil(math.log2(max(total, 1)) / 2) + 5)


def train(docs: DataFrame, labels: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio by bucket, from counts over all documents."""
    bits = rules.bits or bits_for(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    trusted = labels.groupBy(F.col("doc_id").alias(id_col)).agg((F.min("quality") == 1).alias("trusted")).where("trusted").select(id_col)
    texts, n = docs.select(F.col(id_col), F.col(text_col)), 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros(2 * n, np.int64)
        for batch in batches:
            for rows in tb.blocks(batch, 0):
                words, hashes = _words(rows, 0)
                bucket, text = _ngrams(words, hashes, bits)
                bucket = bucket.astype(np.int64)
                bucket += n * rows.column(1).to_numpy(zero_copy_only=False)[text]
                np.add.at(both, bucket, 1)
        # the counts of a range of buckets are one blob: mostly small numbers, so that it takes a fraction of its rows
        both = both.reshape(2, PARTS, -1)
        blobs = [zlib.compress(np.ascontiguousarray(both[:, k]).tobytes(), 1) for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(zlib.decompress(blob.as_py()), np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            other, good = counts.reshape(2, -1)
            seen = np.flatnonzero(other + good)
            yield pa.RecordBatch.from_arrays([pa.array((part * (n // PARTS) + seen).astype(np.int32)), pa.array(other[seen]), pa.array(good[seen])], ["bucket", "other", "trusted"])

    def counted(marked: DataFrame) -> DataFrame:
        shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return marked.mapInArrow(count, "part int, counts binary").repartition(min(shuffled, PARTS), "part").mapInArrow(total, "bucket int, other long, trusted long")

    if trusted.limit(tables.BROADCAST_ROWS + 1).count() <= tables.BROADCAST_ROWS:
        marked = texts.join(F.broadcast(trusted.withColumn("__trusted", F.lit(1).cast("long"))), id_col, "left")
        found = [counted(marked.select(text_col, F.coalesce("__trusted", F.lit(0).cast("long"))))]
    else:  # only trusted texts go through a join; all of them are counted as others first
        good = counted(texts.join(trusted, id_col, "left_semi").select(text_col, F.lit(1).cast("long")))
        found = [counted(texts.select(text_col, F.lit(0).cast("long"))), good.withColumn("other", -F.col("trusted"))]
    raw, good = np.zeros(n), np.zeros(n)
    for part in found:
        got = part.toArrow()
        at = got["bucket"].to_numpy()
        raw[at] += got["other"].to_numpy() + got["trusted"].to_numpy()
        good[at] += got["trusted"].to_numpy()
    if not good.sum():
        return np.zeros(n, np.float32)
    return np.log((good + rules.weight) / (raw * (good.sum() / raw.sum()) + rules.weight)).astype(np.float32)


def apply_rules(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    trained = train(docs, labels, rules, id_col, text_col)
    model, bits = docs.sparkSession.sparkContext.broadcast(trained), len(trained).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tb.blocks(batch, 1):
                words, hashes = _words(rows, 1)
                n = words.counts()
                repeat = tb.repeated_words(words.codes, words.first, rules.window)
                failed = (n < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n)
                bucket, text = _ngrams(words, hashes, bits)
                total = np.bincount(text, weights=model.value[bucket], minlength=rows.num_rows)
                score = total / np.maximum(np.bincount(text, minlength=rows.num_rows), 1)
                symbols = tb.per_text(SYMBOLS[words.data], words.at)
                lines = tb.repeated_lines(words.data, words.at, words.inside)
                out = [rows.column(0), *map(pa.array, (n, words.chars(), symbols, lines, repeat, failed, score, ~failed & (score >= rules.threshold)))]
                yield pa.RecordBatch.from_arrays(out, [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {tables.id_type(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
