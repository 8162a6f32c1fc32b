"""Vector bin packing of examples into sequences by the dot-product heuristic.

An example has three sizes: tokens, one segment, and loss-bearing tokens (its last ones, as in a prompt with its
answer). A sequence has a limit for each. A sequence is filled by the example whose size vector has the largest
dot product with the space left, weighted by the group's demand; when none fits whole, the best one is cut. A
sequence that ends short is cut back to a power of two tokens and the rest goes on, so that nothing is padded.

Groups are blocks of rows of one task: no row is shuffled and no group outgrows a task. Sequence ids hold the
task's partition in the high bits.

Cases: null text counts as empty (its end id is packed); equal rows are packed apart; an empty table gives no
pieces; an example of no tokens gives no piece; columns besides the named ones are ignored.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logloom.llm import byte_bpe, tables
from logloom.llm import textblocks as tb

BLOCK_BYTES = 4 << 20
SEQUENCE_BITS = 36


@dataclasses.dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


def pack_group(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, int]:
    """Pieces (example, start, length, sequence, offset) of one group, and the number of sequences."""
    if limits.tokens & (limits.tokens - 1) or min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("the token limit must be a power of two, and every limit positive")
    tokens = np.asarray(tokens, np.int64)
    loss_at = tokens - np.minimum(np.asarray(loss, np.int64), tokens)  # loss-bearing from here on
    done, left = np.zeros(len(tokens), np.int64), tokens.copy()
    pieces: list[tuple[int, int, int, int, int]] = []
    n = 0
    # whole sequences out of long examples
    for i in np.flatnonzero(left >= limits.tokens):
        while left[i] >= limits.tokens and min(done[i] + limits.tokens, tokens[i]) - max(done[i], loss_at[i]) <= limits.loss:
            pieces.append((i, done[i], limits.tokens, n, 0))
            done[i] += limits.tokens
            left[i] -= limits.tokens
            n += 1
    live = np.flatnonzero(left > 0)
    caps = np.array([limits.tokens, limits.segments, limits.loss], float)
    while len(live):
        need_loss = tokens[live] - np.maximum(done[live], loss_at[live])
        size = np.stack([left[live], np.ones(len(live)), need_loss], axis=1) / caps
        demand = size.sum(axis=0)
        demand /= demand.sum()
        space, row, used = np.array([1.0, 1.0, 1.0]), [], 0
        room, segments, room_loss = limits.tokens, limits.segments, limits.loss
        open_ = np.ones(len(live), bool)
        token_left = left[live]
        while room and segments and open_.any():
            worth = size @ (demand * space)
            fits = open_ & (token_left <= room) & (need_loss <= room_loss)
            if fits.any():
                k = int(np.argmax(np.where(fits, worth, -1.0)))
                length = int(token_left[k])
            else:
                k = int(np.argmax(np.where(open_, worth, -1.0)))
                i = live[k]
                free = max(0, int(loss_at[i] - done[i]))  # tokens before the loss-bearing ones
                length = min(room, int(token_left[k]), free + room_loss)
                if length <= 0:
                    open_[k] = False
                    continue
            i = live[k]
            end = done[i] + length
            cost = max(0, int(end - max(done[i], loss_at[i])))
            row.append((i, int(done[i]), length))
            room -= length
            room_loss -= cost
            segments -= 1
            used += length
            done[i] = end
            left[i] -= length
            open_[k] = False
            space = np.array([room, segments, room_loss]) / caps
        if used & (used - 1):  # cut back to a power of two
            keep = 1 << (used.bit_length() - 1)
            while used > keep:
                i, start, length = row.pop()
                back = min(length, used - keep)
                done[i] -= back
                left[i] += back
                used -= back
                if length > back:
                    row.append((i, start, length - back))
        offset = 0
        for i, start, length in row:
            pieces.append((i, start, length, n, offset))
            offset += length
        n += 1
        live = live[left[live] > 0]
    return np.array(pieces, np.int64).reshape(-1, 5), n


class _Ids:
    """Sequence ids of a task."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << SEQUENCE_BITS

    def take(self, n: int) -> int:
        self.next += n
        return self.next - n


def pack_examples(examples: DataFrame, limits: Limits, id_col: str, tokens_col: str, loss_col: str) -> DataFrame:
    """id, start, length, sequence_id, offset of each piece; lengths are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            got, n = pack_group(batch.column(1).fill_null(0).to_numpy(), batch.column(2).fill_null(0).to_numpy(), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(got[:, 0])), pa.array(got[:, 1]), pa.array(got[:, 2]), pa.array(got[:, 3] + ids.take(n)), pa.array(got[:, 4])], [id_col, "start", "length", "sequence_id", "offset"])

    return examples.selectExpr(f"`{id_col}`", f"cast(`{tokens_col}` as long)", f"cast(`{loss_col}` as long)").mapInArrow(run, f"`{id_col}` {tables.id_type(examples, id_col)}, start long, length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each text's ids and an end id, all loss-bearing: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, ids = byte_bpe.load(tokenizer), _Ids()
        for batch in batches:
            for rows in tb.blocks(batch, text_col, BLOCK_BYTES):
                tokens, at = bpe.encode(rows.column(1), bpe.table.merge_all)
                n_rows = rows.num_rows
                at = at + np.arange(n_rows + 1)
                ended = np.full(at[-1], end_id, "<u4")
                own = np.ones(len(ended), bool)
                own[at[1:] - 1] = False
                ended[own] = tokens
                count = np.diff(at)
                got, n = pack_group(count, count, limits)
                begin = at[got[:, 0]] + got[:, 1]
                raw = memoryview(ended.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + got[:, 2]).tolist(), strict=True)]
                out = [rows.column(0).take(pa.array(got[:, 0])), pa.array(got[:, 1]), pa.array(got[:, 2]), pa.array(crc, pa.int64()), pa.array(count[got[:, 0]]), pa.array(got[:, 3] + ids.take(n)), pa.array(got[:, 4])]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    edges = np.concatenate(([0], np.cumsum(got[:, 2])))
                    out.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(tb.ragged(ended, begin, got[:, 2]).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {tables.id_type(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
