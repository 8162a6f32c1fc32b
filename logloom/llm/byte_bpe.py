"""Byte-level BPE files (tokenizer JSON with merges): pre-tokens of chunks and the merge table.

Two pre-tokenizers are known: ``byte`` (GPT-2 pattern, spaces kept) and ``word`` (lower case, spaces dropped,
word-end symbols). A chunk of plain characters is cut by arrays; any other chunk goes by the pattern itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from logloom.llm import textblocks as tb
from logloom.llm.merges import MergeTable

#: The pre-tokenizer patterns of the two files.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_LETTER, _DIGIT, _SPACE, _OTHER, _ODD = 1, 2, 3, 4, 5
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[list(tb.SPACES)] = _SPACE
_CLASS[128:] = _ODD
_CLASS[ord("'")] = _ODD
_CLASS[:9] = _ODD
_CLASS[14:32] = _ODD
_CLASS[127] = _ODD
_CLASS[ord("<")] = _ODD


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.end = model.get("end_of_word_suffix") or ""
        self.word = bool(self.end)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        v = self.vocab
        self.table = MergeTable([v[a] for a, _ in pairs], [v[b] for _, b in pairs], range(len(pairs)), [v[a + b] for a, b in pairs])
        alphabet = byte_alphabet()
        self.first = np.array([v[c] for c in alphabet], np.int32)
        self.final = np.array([v[c + self.end] for c in alphabet], np.int32)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        byte_of = {c: i for i, c in enumerate(alphabet)}
        n = max([*v.values(), *self.specials.values()]) + 1
        raw = [b""] * n
        for s, i in (v | self.specials).items():
            raw[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.raw_lengths = np.fromiter(map(len, raw), np.int64, n)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def pretokens(self, chunk: bytes) -> list[bytes | int]:
        """Pre-tokens of a chunk by the pattern, special tokens as ids."""
        out: list[bytes | int] = []
        for part in self.special.split(chunk.decode("utf-8")):
            if part in self.specials:
                out.append(self.specials[part])
            elif self.word:
                part = "".join(map(str.lower, regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part))))
                out += [x.encode() for x in WORD_PATTERN.findall(part)]
            else:
                out += [x.encode() for x in BYTE_PATTERN.findall(part)]
        return out

    def cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of distinct chunks: bytes in a row, their offsets, count by chunk, and special id by pre-token (-1: none)."""
        kind = _CLASS[data]
        lead = np.flatnonzero(data == 0xC3)  # Latin-1 letters
        lead = lead[lead + 1 < len(data)]
        tail = data[lead + 1]
        lead = lead[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        begins = tb.doc_starts(data, at)[:-1]
        odd = tb.per_text(kind == _ODD, at) > 0
        if not self.word:  # two blanks in a row go by the pattern
            twice = np.zeros(len(data), bool)
            twice[1:] = (kind[1:] == _SPACE) & (kind[:-1] == _SPACE) & ~begins[1:]
            odd |= tb.per_text(twice, at) > 0
        new = begins.copy()
        new[1:] |= kind[1:] != kind[:-1]
        if self.word:
            new |= kind == _DIGIT
        else:  # one blank before a word belongs to it
            blank = np.flatnonzero((data == 32) & (kind == _SPACE))
            blank = blank[blank + 1 < len(data)]
            blank = blank[~begins[blank + 1]]
            new[blank + 1] = False
        plain = np.repeat(~odd, np.diff(at))
        starts = np.flatnonzero(new & plain)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if len(starts):  # an odd chunk may follow
            ends = np.minimum(ends, at[np.searchsorted(at, starts, "right")])
        if self.word:
            keep = kind[starts] != _SPACE
            starts, ends = starts[keep], ends[keep]
        chunk = np.searchsorted(at, starts, "right") - 1
        lengths, special = ends - starts, np.full(len(starts), -1, np.int64)
        rows = np.flatnonzero(odd)
        if len(rows):
            extra = [(row, p) for row in rows.tolist() for p in self.pretokens(data[at[row] : at[row + 1]].tobytes())]
            texts = [b"" if isinstance(p, int) else p for _, p in extra]
            more = np.fromiter(map(len, texts), np.int64, len(texts))
            tail_bytes = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.concatenate((starts, len(data) + np.cumsum(more) - more))
            lengths = np.concatenate((lengths, more))
            special = np.concatenate((special, [p if isinstance(p, int) else -1 for _, p in extra])).astype(np.int64)
            chunk = np.concatenate((chunk, [row for row, _ in extra])).astype(np.int64)
            data = np.concatenate((data, tail_bytes))
            order = np.argsort(chunk, kind="stable")
            starts, lengths, special, chunk = starts[order], lengths[order], special[order], chunk[order]
        count = np.bincount(chunk, minlength=len(at) - 1)
        return tb.ragged(data, starts, lengths), np.concatenate(([0], np.cumsum(lengths))), count, special

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starting symbols of distinct pre-tokens."""
        out = self.first[data]
        ends = offsets[1:][np.diff(offsets) > 0] - 1
        out[ends] = self.final[data[ends]]
        return out

    def lowered(self, data: np.ndarray) -> np.ndarray:
        """Lower case of ASCII and Latin-1 letters; the rest is lowered with its chunk."""
        data = tb.LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[lead + 1]
        lead = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)]
        data[lead + 1] += 32
        return data

    def encode(self, column: pa.Array, merge) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and n + 1 offsets. Null counts as empty.

        merge(symbols, lengths): merges the symbols of the distinct pre-tokens.
        """
        data, at = tb.flat(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        whole = tb.wide_space(data, at)
        starts = tb.chunk_starts(data, at, tb.IS_SPACE, whole)
        if self.word:  # special tokens are found before anything is lowered: chunks that may hold one are lowered after that
            ends = np.append(starts, len(data))
            data = np.where(np.repeat(tb.per_text(data == ord("<"), ends) > 0, np.diff(ends)), data, self.lowered(data))
        codes, chunks = tb.encoded(data, np.append(starts, len(data)))
        del data
        pre, offsets, count, special = self.cut(*tb.flat(chunks))
        pre_codes, distinct = tb.encoded(pre, offsets)
        symbols, ends = tb.flat(distinct)
        ids, lengths = merge(self.symbols(symbols, ends), np.diff(ends))
        first = np.cumsum(lengths) - lengths
        each, begin = lengths[pre_codes], first[pre_codes]
        extra = np.flatnonzero(special >= 0)
        if len(extra):
            begin[extra] = len(ids) + np.arange(len(extra))
            each[extra] = 1
            ids = np.concatenate((ids, special[extra]))
        by_chunk = tb.ragged(ids.astype(np.uint32), begin, each)
        total = np.concatenate(([0], np.cumsum(each)))
        edge = np.concatenate(([0], np.cumsum(count)))
        lengths, first = total[edge[1:]] - total[edge[:-1]], total[edge[:-1]]
        each = lengths[codes]
        total = np.concatenate(([0], np.cumsum(each)))
        return tb.ragged(by_chunk, first[codes], each), total[np.searchsorted(starts, at)]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids in a row, and how many each has."""
        return tb.ragged(self.raw, self.raw_starts[ids], self.raw_lengths[ids]), self.raw_lengths[ids]


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
