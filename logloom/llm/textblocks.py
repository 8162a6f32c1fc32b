"""Vectorised text helpers for Arrow batches: flat UTF-8 bytes, words, lines and chunks as numpy arrays.

Everything works on one Arrow batch at a time (Spark bounds a batch by rows and bytes), never on a partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The white space of the word contract.
SPACES = bytes([9, 10, 11, 12, 13, 32])
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: UTF-8 bytes that continue a character.
IS_TAIL = np.zeros(256, bool)
IS_TAIL[0x80:0xC0] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Rows are handled in blocks of about so many bytes, so that work arrays stay small.
BLOCK_BYTES = 4 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def released() -> None:
    """Gives memory that is free in this process back to the system: workers live on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batch: pa.RecordBatch, column: str | int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, whole rows each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin, n = 0, batch.num_rows
    while begin < n:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
        released()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenates values[start : start + length] for each pair."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)]


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the byte strings data[offsets[i]:offsets[i + 1]], and the dictionary."""
    strings = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def doc_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    flags = np.zeros(len(data) + 1, bool)
    flags[at[:-1]] = True
    return flags


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text of a block.

    codes: word codes in order; first: offsets of each text's words in codes; hashes: 64-bit hash by code.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        inside = ~IS_SPACE[data]
        begins = doc_starts(data, at)
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        starts = inside & (~before | begins[:-1])
        self.data, self.at, self.inside = data, at, inside
        where = np.flatnonzero(starts)
        self.first = np.searchsorted(where, at)
        letters = data[inside]
        # position among the kept bytes
        rank = np.cumsum(inside, dtype=np.int64)
        offsets = np.append(rank[where] - 1, len(letters)) if len(where) else np.zeros(1, np.int64)
        self.codes, self.dictionary = encoded(letters, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.dictionary.to_pylist()), np.uint64, len(self.dictionary))

    def chars(self) -> np.ndarray:
        """Code points inside words, by text."""
        return per_text(self.inside & ~IS_TAIL[self.data], self.at)


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of ``size`` words inside a text, the text's row of each, and its first word's place.

    hashes: one per word in order; first: offsets of each text's words.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.full(n, 0x9E3779B97F4A7C15 * size % 2**64, np.uint64)
    for k in range(size):
        total = mixed(total * np.uint64(0x100000001B3) ^ hashes[k : k + n])
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n])
    return total[place], text[place], place


def chunk_starts(data: np.ndarray, at: np.ndarray, spaces: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Starts of chunks: a run of white space with what follows up to the next run. Texts flagged in ``whole`` stay uncut."""
    blank = spaces[data]
    begins = doc_starts(data, at)[:-1]
    cut = blank.copy()
    if len(cut):
        cut[1:] &= ~blank[:-1]
    for row in np.flatnonzero(whole):
        cut[at[row] : at[row + 1]] = False
    return np.flatnonzero(cut | begins)


def wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts that hold white space outside ASCII (there a cut before an ASCII space may be wrong)."""
    found = [np.zeros(0, np.int64)]
    n = len(data)
    for lead, rest in ((0xC2, None), (0xE1, 0x9A), (0xE2, None), (0xE3, 0x80)):
        where = np.flatnonzero(data == lead)
        where = where[where + 1 < n]
        second = data[where + 1]
        if lead == 0xC2:
            where = where[(second == 0x85) | (second == 0xA0)]
        elif lead == 0xE2:
            third = data[np.minimum(where + 2, n - 1)]
            low = (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
            where = where[low | ((second == 0x81) & (third == 0x9F))]
        else:
            where = where[second == rest]
        found.append(where)
    flags = np.zeros(len(at) - 1, bool)
    hits = np.concatenate(found)
    if len(hits):
        flags[np.searchsorted(at, hits, "right") - 1] = True
    return flags


def repeated_words(codes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Words of each text in windows of ``size`` words that are found twice or more in it, the first one included."""
    hashes, text, place = windows(mixed(codes.astype(np.uint64) + np.uint64(1)), first, size)
    key = mixed(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(codes) + 1, np.int32)
    begin = place[twice]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + size, -1)
    return per_text(np.cumsum(cover[:-1]) > 0, first)


def repeated_lines(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Lines of each text with a word in them (``inside``: bytes of words) that equal an earlier one."""
    if not len(data):
        return np.zeros(len(at) - 1, np.int64)
    begins = doc_starts(data, at)[:-1]
    begins[1:] |= data[:-1] == 10
    starts = np.flatnonzero(begins)
    worded = per_text(inside, np.append(starts, len(data))) > 0
    kept = data != 10
    rank = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
    codes, _ = encoded(data[kept], rank[np.append(starts, len(data))])
    text = np.searchsorted(at, starts, "right") - 1
    key = (text * (int(codes.max()) + 1) + codes)[worded]
    n = np.bincount(text[worded], minlength=len(at) - 1)
    return n - np.bincount(text[worded][np.unique(key, return_index=True)[1]], minlength=len(at) - 1)
