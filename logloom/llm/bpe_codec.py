"""BPE encoding and decoding by a pair occurrence index.

Method: the distinct pre-tokens of a block form one linked row of symbols. An index maps each mergeable pair to
all its positions; active ranks are taken in ascending order, all occurrences of a pair are merged at once, and
the pairs that arise beside them are added to the lists of their own ranks.

Cases: null text counts as empty and has no ids; equal texts and repeated rows get equal results; an empty table
gives an empty result; columns besides the two named ones are ignored; a null id stays null.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import byte_bpe
from logloom.llm import textblocks as tb
from logloom.llm.merges import MergeTable

#: Larger blocks share more pre-tokens; work arrays take about twelve times this.
BLOCK_BYTES = 16 << 20


def merge_by_index(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Surviving symbols of all sequences in a row, and how many each has. Ranks are the indexes of the table's pairs."""
    lengths = np.asarray(lengths, np.int64)
    if not table.together.all():
        raise ValueError("the pair index needs ranks in order of creation")
    sym, n = np.array(symbols, np.int32), len(symbols)
    ends = np.cumsum(lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    full = lengths > 0
    after[ends[full] - 1] = n
    before[(ends - lengths)[full]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(positions: np.ndarray) -> None:
        pairs = table.find(sym[positions], sym[after[positions]])
        found = np.flatnonzero(pairs >= 0)
        if not len(found):
            return
        pairs, positions = pairs[found], positions[found]
        order = np.argsort(pairs, kind="stable")
        pairs, positions = pairs[order], positions[order]
        edges = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
        begin = 0
        for end in [*edges.tolist(), len(pairs)]:
            pair = int(pairs[begin])
            if pair in index:
                index[pair].append(positions[begin:end])
            else:
                index[pair] = [positions[begin:end]]
                heapq.heappush(active, pair)
            begin = end

    add(np.flatnonzero(after < n))
    while active:
        pair = heapq.heappop(active)
        lists = index.pop(pair)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = table.left[pair], table.right[pair]
        at = at[sym[at] == a]
        next_ = after[at]
        ok = next_ < n
        at, next_ = at[ok], next_[ok]
        ok = sym[next_] == b
        at, next_ = at[ok], next_[ok]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # left to right without overlap
            fresh = np.ones(len(at), bool)
            fresh[1:] = next_[:-1] != at[1:]
            k = np.arange(len(at))
            use = (k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0
            at, next_ = at[use], next_[use]
        sym[at], sym[next_] = table.merged[pair], -1
        beyond = after[next_]
        after[at] = beyond
        inner = beyond < n
        before[beyond[inner]] = at[inner]
        left = before[at]
        around = np.concatenate((left[left >= 0], at[inner]))
        if len(around):
            add(np.unique(around) if len(at) > 1 else around)
    live = sym >= 0
    return sym[live], tb.per_text(live, np.concatenate(([0], ends)))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>, as the tokenizer's encode without special tokens) and decoded (string, of those ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, at, text, ends in _codec(batches, tokenizer):
            yield pa.RecordBatch.from_arrays(
                [key, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())],
                [id_col, "ids", "decoded"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def _codec(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple]:
    bpe = byte_bpe.load(path)
    for batch in batches:
        for part in tb.blocks(batch, batch.schema.names[1], BLOCK_BYTES):
            ids, at = bpe.encode(part.column(1), lambda s, n: merge_by_index(bpe.table, s, n))
            text, each = bpe.decode_bytes(ids)
            total = np.concatenate(([0], np.cumsum(each)))
            yield part.column(0), ids, at, text, total[at]


def codec_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded text), without shipping ids or texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, at, text, ends in _codec(batches, tokenizer):
            raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            body = memoryview(text.tobytes())
            id_digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            # bytes that aren't UTF-8 become U+FFFD, as in the library
            texts = [hashlib.sha256(bytes(body[a:b]).decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(at)), pa.array(id_digests, pa.string()), pa.array(texts, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
