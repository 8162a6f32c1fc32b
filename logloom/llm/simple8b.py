"""Simple-8b word-aligned coding of unsigned integers in blocks of 128, over numpy arrays.

A 64-bit word holds a selector in its low 4 bits and so many values of so many bits above. Selector 15 is the
escape: the next word is one raw 64-bit value. The last word of a block may hold fewer values than its selector
says; the block's count tells. Every block starts at a word of its own, so any block can be decoded alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: Fixed values: (values, bits) by selector; 60 data bits a word.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
COUNT = np.array([c for c, _ in PACKS] + [0, 1], np.int64)
#: Bit lengths of the numbers of 16 bits.
_BITS = np.fromiter(map(int.bit_length, range(1 << 16)), np.uint8, 1 << 16)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    out = _BITS[values & values.dtype.type(0xFFFF)]
    wide = np.flatnonzero(values > 0xFFFF)
    rest, add = values[wide], 0
    while len(wide):
        rest, add = rest >> rest.dtype.type(16), add + 16
        out[wide] = _BITS[rest & rest.dtype.type(0xFFFF)] + add
        more = rest > 0xFFFF
        wide, rest = wide[more], rest[more]
    return out


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values: all lists in a row; lengths: of each list. Returns the words, words of each block, and blocks of each list.

    The selector that would begin at each value comes from sliding maxima of the bit lengths, for all values at once;
    the blocks then step from word to word side by side.
    """
    values, lengths = np.asarray(values), np.asarray(lengths, np.int64)
    values = values if values.dtype in (np.uint32, np.uint64) else values.astype(np.uint64)
    n_blocks = -(-lengths // BLOCK)
    total = int(n_blocks.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_blocks
    size = np.full(total, BLOCK, np.int64)
    some = n_blocks > 0
    size[np.cumsum(n_blocks)[some] - 1] = (lengths - (n_blocks - 1) * BLOCK)[some]
    first = np.cumsum(size) - size
    row = BLOCK + PACKS[0][0]  # no window passes the zeros behind a block
    high = np.zeros((total, row), np.uint8)
    high[np.arange(row) < size[:, None]] = bit_lengths(values)
    high, chosen = high.ravel(), np.full(total * row, ESCAPE, np.uint8)
    reach = 1
    for s in range(len(PACKS) - 1, -1, -1):
        count, width = PACKS[s]
        step, reach = count - reach, count
        high = np.maximum(high[: len(high) - step], high[step:])
        chosen[: len(high)][high <= width] = s
    begins, at, end = np.zeros(total * row, bool), np.arange(total) * row, np.arange(total) * row + size
    while len(at):
        begins[at] = True
        at = at + COUNT[chosen[at]]
        open_ = at < end
        at, end = at[open_], end[open_]
    at = np.flatnonzero(begins)
    chosen, block = chosen[at], at // row
    begin, left = first[block] + at % row, size[block] - at % row
    each = 1 + (chosen == ESCAPE)
    place = np.cumsum(each) - each
    words = np.empty(int(each.sum()), np.uint64)
    values = np.concatenate((values, np.zeros(PACKS[0][0], values.dtype)))
    for s in np.unique(chosen).tolist():
        some = np.flatnonzero(chosen == s)
        here = begin[some]
        word = np.full(len(some), s, np.uint64)
        if s == ESCAPE:
            words[place[some] + 1] = values[here]
        else:
            count, width = PACKS[s]
            for j in range(count):
                word |= values[here + j].astype(np.uint64) << np.uint64(4 + width * j)
            cut = np.flatnonzero(left[some] < count)  # values of the next block lie above those of this one
            word[cut] &= (np.uint64(1) << (4 + width * left[some[cut]]).astype(np.uint64)) - np.uint64(1)
        words[place[some]] = word
    return words, np.bincount(block, each, total).astype(np.int64), n_blocks


def decode(words: np.ndarray, block_words: np.ndarray, block_values: np.ndarray) -> np.ndarray:
    """All values in a row. block_words, block_values: words and values of each block."""
    selector = (words & np.uint64(15)).astype(np.int64)
    count = COUNT[selector]
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    count[raw] = 0
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s, (n, width) in enumerate(PACKS):
        rows = np.flatnonzero((selector == s) & ~raw)
        if len(rows):
            mask = np.uint64((1 << width) - 1)
            for j in range(n):
                out[start[rows] + j] = words[rows] >> np.uint64(4 + width * j) & mask
    rows = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[start[rows]] = words[np.minimum(rows + 1, len(words) - 1)]
    ends = np.cumsum(block_words)
    total = np.concatenate(([0], np.cumsum(count)))
    first = total[ends - block_words]
    place = np.arange(len(out)) - np.repeat(first, total[ends] - first)
    return out[place < np.repeat(np.asarray(block_values, np.int64), total[ends] - first)]
