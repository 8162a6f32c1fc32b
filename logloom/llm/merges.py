"""Byte-pair merges over ragged numpy arrays.

``MergeTable`` holds (left, right) -> (rank, merged) in an open-addressed array. ``merge_all`` applies each
sequence's lowest-rank pair, all sequences at once, round by round; ``merge_long`` does the same rounds on one very
long sequence, where a round doesn't pass over the whole of it.

Cases: no sequences, and sequences of no or one symbol, come back as they are; equal sequences give equal results;
pairs of equal rank go leftmost first.
"""

from __future__ import annotations

import numpy as np

from logloom.llm import textblocks as tb

NONE = np.int32(2**31 - 1)
#: Longer sequences go through merge_long, whose time is not rounds times length.
LONG = 1024
#: Symbols of a cell there.
CELL = 256


class MergeTable:
    """lefts, rights: symbols of each pair; ranks: lower first; merged: the symbol that results.

    A pair is ``together`` if all its occurrences may be merged in one round: its rank is its own, and no pair
    with the merged symbol has a lower rank.
    """

    def __init__(self, lefts, rights, ranks, merged):
        self.left, self.right = np.asarray(lefts, np.int64), np.asarray(rights, np.int64)
        self.rank, self.merged = np.asarray(ranks, np.int32), np.asarray(merged, np.int32)
        n_symbols = int(max(self.left.max(), self.right.max(), self.merged.max())) + 1
        lowest = np.full(n_symbols, NONE, np.int32)
        np.minimum.at(lowest, self.left, self.rank)
        np.minimum.at(lowest, self.right, self.rank)
        result_of = np.full(int(self.rank.max()) + 1, -1, np.int64)
        shared = np.zeros(len(result_of), bool)
        result_of[self.rank] = self.merged
        np.logical_or.at(shared, self.rank, result_of[self.rank] != self.merged)
        self.together = (lowest[self.merged] > self.rank) & ~shared[self.rank]
        self.bits = max(16, int(np.ceil(np.log2(len(self.left) * 8))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.where = np.full(1 << self.bits, -1, np.int32)
        key = self.left << 32 | self.right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]
            won = self.keys[at] == key[todo]
            self.where[at[won]] = todo[won]
            todo = todo[~won]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.where[slot], np.int32(-1))
        open_ = np.flatnonzero((got != key) & (got != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            got = self.keys[slot[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.where[slot[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        index = self.find(left, right)
        return np.where(index >= 0, self.rank[index], NONE)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The rounds of merge_all for one long sequence: merged symbols stay in place as gaps, and the lowest rank is kept by cell, so that a round costs its own changes."""
        n = len(symbols)
        cells = -(-n // CELL)
        sym, rank = np.asarray(symbols, np.int32).copy(), np.full(cells * CELL, NONE, np.int32)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank[: n - 1] = self.ranks(sym[:-1], sym[1:])
        grid = rank.reshape(cells, CELL)
        low = grid.min(axis=1)
        alive = np.ones(n, bool)
        while (now := low.min()) != NONE:
            some = np.flatnonzero(low == now)
            cell, place = np.nonzero(grid[some] == now)
            hit = some[cell] * CELL + place
            index = self.find(sym[hit], sym[after[hit]])
            if self.together[index].all():
                run = np.concatenate(([True], after[hit[:-1]] != hit[1:]))  # left to right without overlap
                use = (np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0
                hit, index = hit[use], index[use]
            else:
                hit, index = hit[:1], index[:1]
            gone = after[hit]
            sym[hit] = self.merged[index]
            alive[gone], rank[gone] = False, NONE
            after[hit] = after[gone]
            inner = hit[after[hit] < n]
            before[after[inner]] = inner
            led = before[hit]
            changed = np.concatenate((hit, led[led >= 0]))
            rank[changed] = NONE
            right = changed[after[changed] < n]
            rank[right] = self.ranks(sym[right], sym[after[right]])
            touched = np.unique(np.concatenate((changed, gone)) // CELL)
            low[touched] = grid[touched].min(axis=1)
        return sym[alive]

    def merge_all(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all sequences in a row, and how many each has."""
        lengths = np.asarray(lengths, np.int64)
        first = np.cumsum(lengths) - lengths
        final, pieces, ids = np.zeros(len(lengths), np.int64), [], []
        for i in np.flatnonzero(lengths > LONG):
            pieces.append(self.merge_long(symbols[first[i] : first[i] + lengths[i]]))
            final[i] = len(pieces[-1])
            ids.append(np.array([i]))
        seq = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        sym = tb.ragged(np.asarray(symbols, np.int32), first[seq], lengths[seq])
        size = lengths[seq]
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(seq):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            if done.any():
                stay = np.repeat(~done, size)
                pieces.append(sym[~stay])
                ids.append(seq[done])
                final[seq[done]] = size[done]
                sym, rank, last = sym[stay], rank[stay], last[stay]
                seq, size, low = seq[~done], size[~done], low[~done]
                if not len(seq):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            owner = np.searchsorted(np.cumsum(size), hit, "right")
            index = self.find(sym[hit], sym[hit + 1])
            # left to right without overlap; only the first one of pairs that must not go together
            fresh = np.empty(len(hit), bool)
            fresh[0] = True
            fresh[1:] = hit[1:] != hit[:-1] + 1
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            use = (np.arange(len(hit)) - begin) % 2 == 0
            lead = np.empty(len(hit), bool)
            lead[0] = True
            lead[1:] = owner[1:] != owner[:-1]
            alone = ~self.together[index]
            if alone.any():
                some = np.zeros(len(seq), bool)
                some[owner[alone]] = True
                use = np.where(some[owner], lead, use)
            hit, owner, index = hit[use], owner[use], index[use]
            sym[hit] = self.merged[index]
            last[hit] = last[hit + 1]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, rank, last = sym[stay], rank[stay], last[stay]
            size = size - np.bincount(owner, minlength=len(seq))
            at = hit - np.arange(len(hit))
            rank[at] = NONE
            right = at[~last[at]]
            rank[right] = self.ranks(sym[right], sym[right + 1])
            left = at[at > 0] - 1
            left = left[~last[left]]
            rank[left] = self.ranks(sym[left], sym[left + 1])
        if not pieces:
            return np.zeros(0, np.int32), final
        order = np.concatenate(ids)
        at = np.empty(len(lengths), np.int64)
        at[order] = np.cumsum(final[order]) - final[order]
        return tb.ragged(np.concatenate(pieces), np.where(final > 0, at, 0), final), final
