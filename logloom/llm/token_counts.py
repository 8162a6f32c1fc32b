"""Token counts by rank-synchronous array merging.

Method: distinct chunks of a block are held as one ragged numpy array of symbols; in each round every sequence's
lowest-rank pair is merged, all sequences at once; when no pair is left, surviving symbols are counted. The file
is a sentencepiece BPE model with byte fallback: a symbol that is no piece counts as its UTF-8 bytes.

Cases: null text counts as empty and has 0 tokens; equal texts and repeated rows get equal counts; an empty table
gives an empty result; columns besides the two named ones are ignored; a null id stays null. Sequences beyond
``merges.LONG`` symbols go through the same rounds one by one, on arrays that keep merged symbols as gaps.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm import textblocks as tb
from logloom.llm.merges import MergeTable

#: Fixed value: the character that stands for a space.
SPACE = "▁"
BLOCK_BYTES = 16 << 20


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are known")
        pieces = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        chars = sorted({c for p in pieces for c in p})
        symbol = {p: i for i, p in enumerate([*chars, *(p for p in pieces if len(p) > 1)])}
        rank = {s: i for i, s in enumerate(sorted({pieces[p] for p in pieces if len(p) > 1}, reverse=True))}
        left, right, ranks, merged = [], [], [], []
        for p, score in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    left.append(symbol[p[:k]])
                    right.append(symbol[p[k:]])
                    ranks.append(rank[score])
                    merged.append(symbol[p])
        self.table = MergeTable(left, right, ranks, merged)
        n = len(symbol)
        #: Symbols n + 1 to n + 4: a character in no piece, of so many bytes.
        self.cost = np.array([1 if p in pieces else len(p.encode()) for p in symbol] + [0, 1, 2, 3, 4], np.int64)
        self.of_char = np.empty(0x110000, np.int32)
        for begin, end, size in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.of_char[begin:end] = n + size
        self.of_char[[ord(c) for c in chars]] = [symbol[c] for c in chars]
        self.of_char[32] = symbol[SPACE]
        joined = {c for p in pieces if len(p) > 1 for c in p}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in pieces):
            raise ValueError("a piece goes on across a space")
        #: Characters in no longer piece: texts may be cut before and after them.
        self.alone = np.zeros(256, bool)
        self.alone[[b for b in range(128) if chr(b) not in joined and b != 32]] = True

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        blank = data == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        alone = self.alone[data]
        cut |= alone
        cut[1:] |= alone[:-1]
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        for row in np.unique(np.searchsorted(at, mark, "right") - 1):
            cut[at[row] : at[row + 1]] = False
        return np.flatnonzero(cut | tb.doc_starts(data, at)[:-1])

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text. Null counts as empty."""
        data, at = tb.flat(column)
        n = len(at) - 1
        sizes = np.diff(at)
        if not len(data):
            return sizes, np.zeros(n, np.int64)
        led = at + np.arange(n + 1)  # each text gets a space in front
        spaced = np.empty(len(data) + n, np.uint8)
        ahead = np.zeros(len(spaced), bool)
        ahead[led[:-1]] = True
        spaced[ahead], spaced[~ahead] = 32, data
        starts = self.starts(spaced, led)
        codes, chunks = tb.encoded(spaced, np.append(starts, len(spaced)))
        raw, ends = tb.flat(chunks)
        symbols = self.of_char[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        left, lengths = self.table.merge_all(symbols, tb.per_text(~tb.IS_TAIL[raw], ends))
        total = np.concatenate(([0], np.cumsum(self.cost[left])))
        end = np.cumsum(lengths)
        each = (total[end] - total[end - lengths])[codes]
        total = np.concatenate(([0], np.cumsum(each)))
        edge = np.searchsorted(starts, led)
        return sizes, np.where(sizes > 0, total[edge[1:]] - total[edge[:-1]], 0)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.blocks(batch, text_col, BLOCK_BYTES):
                sizes, tokens = counter(model).count(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
