"""N-gram Jaccard self-join with a prefix tree, and the components of its links.

A document's set: its distinct word 4-grams (fewer words: the whole sequence as one). Two documents link when
100 * intersection >= percent * union.

1. Sets are made by block of documents, on 64-bit hashes (equal sets of a block count once). Each distinct n-gram of
   a block goes to its hash's bucket once, with its number of sets there; n-grams of one set only are dropped, the
   rest go back to their block with the power of two of their total. Buckets follow the bytes of the input.
2. Sets are ordered by (power of two of the number of sets, hash), rarest first. A set whose n-grams of two or more
   sets are under ``percent`` of it can't link. For linked sets x and y, y no larger than x, one of the first
   size - ceil(percent * size) + 1 n-grams of x (probe prefix) is among the first size - ceil(2 * percent /
   (100 + percent) * size) + 1 of y (index prefix). Equal sets are collapsed into one node.
3. Sets that share a prefix n-gram form a list. A list is stored in a path-compressed trie and sets traverse it:
   nodes share the overlap of their path, and subtrees fall when the overlap plus the shorter remaining length can't
   reach the threshold, or when their sizes can't. Pairs known to be connected are passed over.
4. To know most connections early, each set first meets those that chose the same one of its n-grams, and large
   groups meet by representatives. Then every list whose sets aren't one component yet is joined whole. A list
   beyond ``chunk`` sets or ``chunk_bytes`` is dealt out by size bands (linked sets are in the same or neighbouring
   bands) and into cells, in each of which a part of the index sides stands in the trie and a part of all sets
   traverses it: no link is lost, and no task holds more than a cell.
5. Components by alternating stars.

The hash order keeps 59 bits beside the power of two: within a pair of sets of a million n-grams the chance of a
false match is 2e-6; ``n_shingles`` is counted on all 64. Nothing but counts meets in the driver.

Cases: null, empty or blank text: size 0, linked with nothing, its own component. Each row is a document of its own:
a repeated row links with its copy, and rows that share an id but not their text get a row each, by their own text.
A null id gets a null component and links nothing. An empty table gives an empty result; columns besides the two
named ones are ignored. A very long text is a block and a cell of its own.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import tables
from logloom.llm import textblocks as tb


@dataclasses.dataclass(frozen=True)
class Settings:
    words: int = 4
    percent: int = 85
    #: Sets, and bytes of their n-grams, that meet in one trie; longer lists are dealt into cells.
    chunk: int = 2048
    chunk_bytes: int = 4 << 20
    #: Text bytes for each bucket of n-grams.
    bucket_bytes: int = 12 << 20


BLOCK_BYTES = 4 << 20
#: Bits of a row's place in its block, and of a block's number in its task.
ROW_BITS, BLOCK_BITS = 16, 24
#: N-grams of so many sets of a block leave the sets' places with the block; the bucket only counts them.
HOT = 16
_INFO, _PLACES, _DATA = 0, 1, 2


def sets_of(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit n-grams of each text in a row, ascending by text, and n + 1 offsets."""
    found = tb.Words(*tb.flat(column), lower=True)
    n_texts = len(found.first) - 1
    hashes = found.hashes()[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    grams, text, _ = tb.windows(hashes, found.first, words)
    count = found.counts()
    for k in range(1, words):
        short, short_text, _ = tb.windows(hashes, found.first, k)
        only = count[short_text] == k
        grams, text = np.concatenate((grams, short[only])), np.concatenate((text, short_text[only]))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[fresh], text[fresh]
    return grams, np.searchsorted(text, np.arange(n_texts + 1))


def _equal_sets(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text the first row with the same set; itself for empty sets."""
    n = len(at) - 1
    size = np.diff(at)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mixed(grams))))
    other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mixed(grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))))
    a, b = total[at[1:]] - total[at[:-1]], other[at[1:]] - other[at[:-1]]
    order = np.lexsort((np.arange(n), b, a, size))
    new = np.ones(n, bool)
    new[1:] = (size[order[1:]] != size[order[:-1]]) | (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    out = np.empty(n, np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    out[size == 0] = np.flatnonzero(size == 0)
    return out


def _packed(*parts: np.ndarray) -> bytes:
    """The number of values of the first part, and all parts."""
    return len(parts[0]).to_bytes(8, "little") + b"".join(p.tobytes() for p in parts)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams (or keys), numbers of sets, and places."""
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.uint16, n, 8 + 8 * n), np.frombuffer(blob, np.uint16, -1, 8 + 10 * n)


def _dealt(docs: DataFrame, settings: Settings, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Per block of documents: an info row, the places of its frequent n-grams, and for each bucket the distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << BLOCK_BITS
        for batch in batches:
            for big in tb.blocks(batch, "text", BLOCK_BYTES):
                for begin in range(0, big.num_rows, 1 << ROW_BITS):
                    rows = big.slice(begin, 1 << ROW_BITS)
                    grams, at = sets_of(rows.column(1), settings.words)
                    known = ~rows.column(0).is_null().to_numpy(zero_copy_only=False)
                    ids = rows.column(0).fill_null(0).to_numpy()
                    n, size = len(ids), np.diff(at)
                    first = np.arange(n)
                    first[known] = _first_known(_equal_sets(grams, at), known)[known]
                    text = np.repeat(np.arange(n), size)
                    use = ((first == np.arange(n)) & known)[text]
                    order = np.argsort(grams[use], kind="stable")
                    grams, text = grams[use][order], text[use][order].astype(np.uint16)
                    edge = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1], [True]))) if len(grams) else np.zeros(1, np.int64)
                    count, grams = np.diff(edge), grams[edge[:-1]]
                    often = np.repeat(count >= HOT, count)
                    bucket = (grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                    some = np.flatnonzero(np.diff(cut))
                    rest, rest_at = text[~often], np.concatenate(([0], np.cumsum(np.where(count >= HOT, 0, count))))
                    counted = np.minimum(count, 65_535).astype(np.uint16)
                    info = np.stack([ids, rows.column(2).fill_null(0).to_numpy(), size, first, known], axis=1).astype(np.int64).tobytes()
                    blobs = [info, text[often].tobytes(), *(_packed(grams[cut[k] : cut[k + 1]], counted[cut[k] : cut[k + 1]], rest[rest_at[cut[k]] : rest_at[cut[k + 1]]]) for k in some)]
                    kinds = [_INFO, _PLACES] + [_DATA] * len(some)
                    to = np.concatenate(([block % buckets] * 2, some)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(to), block, np.int64)), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "block", "kind", "data"])
                    block += 1

    ids = F.col(id_col).cast("long").alias("id")
    return docs.select(ids, F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).mapInArrow(run, "bucket int, block long, kind int, data binary")


def _first_known(first: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The first row of each group that has an id."""
    own = np.full(len(first), len(first))
    np.minimum.at(own, first[known], np.flatnonzero(known))
    return own[first]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket, the n-grams that are in two sets or more, back by block: (power of two of the number of sets, hash)."""
    names = ["block", "kind", "bucket", "data"]
    head, parts = [], []
    for batch in batches:
        kind = batch.column(2).to_numpy()
        info = batch.filter(pa.array(kind != _DATA))
        if info.num_rows:
            yield info.select(names)
        data = batch.filter(pa.array(kind == _DATA))
        head += zip(data.column(1).to_pylist(), data.column(0).to_pylist(), strict=True)
        parts += data.column(3).to_pylist()
    if not parts:
        return
    found = [_unpacked(p) for p in parts]
    grams, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(grams, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], grams[order[1:]] != grams[order[:-1]])))
    total = np.add.reduceat(counts[order].astype(np.int64), edge)
    power = np.empty(len(grams), np.uint8)
    power[order] = np.repeat(np.minimum(np.frexp(total.astype(np.float64))[1] - 1, 31), np.diff(np.append(edge, len(grams))))
    del order, counts
    grams >>= np.uint64(5)
    grams |= power.astype(np.uint64) << np.uint64(59)
    at = 0
    for (block, bucket), (own, count, places) in zip(head, found, strict=True):
        part = slice(at, at + len(own))
        at += len(own)
        shared = power[part] > 0
        if shared.any():
            few = count < HOT
            blob = _packed(grams[part][shared], count[shared], places[np.repeat(shared[few], count[few])])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_DATA], pa.int32()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names)


_SETS = "id long, mark long, node long, size long, first long, prefix array<long>, n_index int, keys binary"


def _assembled(settings: Settings):
    """Rows sorted by block, kind and bucket into a row for each document; sets that can link come with their ordered n-grams."""

    def finish(block: int, info: np.ndarray, places: bytes, data: list[bytes]) -> pa.RecordBatch:
        ids, mark, size, first, known = info.T
        found = [_unpacked(d) for d in data] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint16))]
        keys, count, rest = (np.concatenate([f[i] for f in found]) for i in range(3))
        often = np.repeat(count >= HOT, count)
        text = np.empty(len(often), np.int64)
        text[~often], text[often] = rest, np.frombuffer(places, np.uint16)
        keys = np.repeat(keys, count)
        order = np.lexsort((keys, text))
        keys, text = keys[order], text[order]
        edge = np.searchsorted(text, np.arange(len(ids) + 1))
        shared = np.diff(edge)
        need = -(-settings.percent * size // 100)
        need_index = -(-2 * settings.percent * size // (100 + settings.percent))
        can = (shared >= need) & (size > 0)
        sets: list[bytes | None] = [None] * len(ids)
        prefix: list[np.ndarray | None] = [None] * len(ids)
        for k in np.flatnonzero(can).tolist():
            own = keys[edge[k] : edge[k + 1]]
            sets[k] = own.tobytes()
            prefix[k] = own[: shared[k] - need[k] + 1].view(np.int64)
        at = block << ROW_BITS
        n_index = np.maximum(shared - need_index + 1, 0).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(mark), pa.array(at + np.arange(len(ids))), pa.array(size), pa.array(at + first), pa.array(prefix, pa.list_(pa.int64())), pa.array(n_index), pa.array(sets, pa.binary())], ["id", "mark", "node", "size", "first", "prefix", "n_index", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, info, places, data = None, None, b"", []
        for batch in batches:
            for block, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if block != now:
                    if now is not None:
                        yield finish(now, info, places, data)
                    now, data = block, []
                if kind == _INFO:
                    info = np.frombuffer(blob.as_py(), np.int64).reshape(-1, 5)
                elif kind == _PLACES:
                    places = blob.as_py()
                else:
                    data.append(blob.as_py())
        if now is not None:
            yield finish(now, info, places, data)

    return run


class Trie:
    """Ordered sets in a path-compressed trie, in arrays. Node 0 is the root."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, n_ranks: int):
        """sets: ascending ranks below n_ranks of each set; sizes: of the full sets (n-grams of one set only are left out of ``sets``)."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        begin, end, parent, segments = [0], [0], [-1], [np.zeros(0, np.int64)]
        terminal = np.empty(len(sets), np.int64)
        path = [0]  # nodes of the last set's path
        for k, i in enumerate(order):
            own = sets[i]
            common = 0
            if k:
                last = sets[order[k - 1]]
                m = min(len(own), len(last))
                differ = np.flatnonzero(own[:m] != last[:m])
                common = int(differ[0]) if len(differ) else m
            while end[path[-1]] > common and begin[path[-1]] >= common and len(path) > 1:
                path.pop()
            top = path[-1]
            if end[top] > common:  # cut this node's segment in two; the upper half takes a new number
                cut = len(begin)
                begin.append(begin[top])
                end.append(common)
                parent.append(parent[top])
                segments.append(segments[top][: common - begin[top]])
                segments[top] = segments[top][common - begin[top] :]
                begin[top] = common
                parent[top] = cut
                path[-1] = cut
            if len(own) > common:
                node = len(begin)
                begin.append(common)
                end.append(len(own))
                parent.append(path[-1])
                segments.append(own[common:])
                path.append(node)
            terminal[i] = path[-1]
        self.sizes, self.n_ranks = sizes, n_ranks
        n = len(begin)
        self.length = np.array([len(s) for s in segments])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.concatenate(segments).astype(np.int64)
        self.last = np.array([int(s[-1]) if len(s) else -1 for s in segments])
        end_, parent_ = np.array(end), np.array(parent)
        levels = [np.array([0])]
        children: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            children[parent[node]].append(node)
        while len(nxt := np.array([c for p in levels[-1].tolist() for c in children[p]], np.int64)):
            levels.append(nxt)
        self.child_count = np.array([len(c) for c in children])
        self.child_start = np.cumsum(self.child_count) - self.child_count
        self.children = np.array([c for cs in children for c in cs], np.int64)
        # bounds over each subtree
        self.low, self.high, self.top, deep = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.full(n, -1), end_.copy()
        np.minimum.at(self.low, terminal, sizes)
        np.maximum.at(self.high, terminal, sizes)
        np.maximum.at(self.top, terminal, np.arange(len(sets)))
        for level in levels[:0:-1]:
            np.minimum.at(self.low, parent_[level], self.low[level])
            np.maximum.at(self.high, parent_[level], self.high[level])
            np.maximum.at(self.top, parent_[level], self.top[level])
            np.maximum.at(deep, parent_[level], deep[level])
        self.left = deep - end_
        by_node = np.argsort(terminal, kind="stable")
        self.members, self.member_start = by_node, np.searchsorted(terminal[by_node], np.arange(n + 1))
        self.lone = (self.child_count == 0) & (np.diff(self.member_start) == 1)
        self.only = self.members[np.minimum(self.member_start[:-1], len(sets) - 1)]

    def partners(self, probes: list[np.ndarray], sizes: np.ndarray, own: np.ndarray, after: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, set) that link and aren't in one component; only sets that come later than ``after``.

        probes: ranks of each; sizes, own: their full sizes and components; component: of the trie's sets. All probes go
        down the trie together.
        """
        lengths = np.array([len(p) for p in probes])
        mark = np.zeros((len(probes), self.n_ranks), bool)
        mark[np.repeat(np.arange(len(probes)), lengths), np.concatenate(probes)] = True
        passed = np.zeros((len(probes), self.n_ranks + 1), np.int32)
        np.cumsum(mark, axis=1, out=passed[:, 1:])
        who, nodes, overlap = np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
        left, right = [], []
        while len(nodes):
            # sets that end here
            count = self.member_start[nodes + 1] - self.member_start[nodes]
            if count.any():
                ends = tb.ragged(self.members, self.member_start[nodes], count)
                w, both = np.repeat(who, count), np.repeat(overlap, count)
                link = (100 * both >= percent * (sizes[w] + self.sizes[ends] - both)) & (component[ends] != own[w]) & (ends > after[w])
                left.append(w[link])
                right.append(ends[link])
            count = self.child_count[nodes]
            below = tb.ragged(self.children, self.child_start[nodes], count)
            w, carried = np.repeat(who, count), np.repeat(overlap, count)
            # sizes, subtrees of earlier sets only, and lone leaves that are connected with the probe already
            keep = (self.top[below] > after[w]) & (100 * self.high[below] >= percent * sizes[w]) & (100 * sizes[w] >= percent * self.low[below])
            keep &= ~(self.lone[below] & (component[self.only[below]] == own[w]))
            below, w, carried = below[keep], w[keep], carried[keep]
            if not len(below):
                break
            length = self.length[below]
            hits = mark[np.repeat(w, length), tb.ragged(self.flat, self.start[below], length)]
            total = np.concatenate(([0], np.cumsum(hits, dtype=np.int32)))
            edge = np.cumsum(length)
            carried = carried + total[edge] - total[edge - length]
            # remaining length: of the probe beyond this path, and of the longest set below
            rest = np.minimum(lengths[w] - passed[w, self.last[below] + 1], self.left[below])
            need = -(-percent * (sizes[w] + self.low[below]) // (100 + percent))
            keep = carried + rest >= need
            who, nodes, overlap = w[keep], below[keep], carried[keep]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(left or none), np.concatenate(right or none)


#: Probes go together while the n-grams they may meet on one level of the trie are so many at most.
MARKS = 1 << 20


def join_list(keys: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, percent: int, members: np.ndarray | None = None, probes: np.ndarray | None = None) -> np.ndarray:
    """Components of a list of sets after its links; component: the ones known before.

    members: sets in the trie, probes: sets that traverse it; all of them by default, when each pair is looked at once.
    """
    whole = members is None
    members = np.arange(len(keys)) if members is None else members
    probes = np.arange(len(keys)) if probes is None else probes
    values = np.unique(np.concatenate(keys))
    ranks = [np.searchsorted(values, k) for k in keys]
    trie = Trie([ranks[i] for i in members.tolist()], sizes[members], len(values))
    component = component.copy()
    together = max(1, min(64, MARKS // max(len(values), len(trie.flat))))
    for begin in range(0, len(probes), together):
        some = probes[begin : begin + together]
        after = some if whole else np.full(len(some), -1)
        a, b = trie.partners([ranks[i] for i in some.tolist()], sizes[some], component[some], after, component[members], percent)
        parent: dict[int, int] = {}

        def find(x: int, parent=parent) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for x, y in np.unique(np.stack((component[some[a]], component[members[b]]), axis=1), axis=0).tolist() if len(a) else []:
            parent[find(x)] = find(y)
        for x in parent:
            component[component == x] = find(x)
    return component


_TRIE, _PROBE = 1, 2


def _joined(percent: int):
    """Rows (name, node, role, size, keys, component), sorted by name, into links (a, b), a < b, of a star for each component of a list."""

    def links(rows: list[tuple]) -> pa.RecordBatch | None:
        role: dict[int, int] = {}
        held: dict[int, tuple] = {}
        for node, part, *rest in rows:
            role[node] = role.get(node, 0) | part
            held[node] = rest
        nodes = np.array(sorted(held))
        known = np.unique(np.array([held[i][2] for i in nodes.tolist()]), return_inverse=True)[1]
        if not known.any():
            return None
        roles = np.array([role[i] for i in nodes.tolist()])
        all_ = (roles == _TRIE | _PROBE).all()
        members, probes = (None, None) if all_ else (np.flatnonzero(roles & _TRIE), np.flatnonzero(roles & _PROBE))
        if not all_ and not (len(members) and len(probes)):
            return None
        after = join_list([np.frombuffer(held[i][1], np.uint64) for i in nodes.tolist()], np.array([held[i][0] for i in nodes.tolist()]), known, percent, members, probes)
        # a star for what the list has connected anew: the smallest node of each component before, hung on that of its component after
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, known, nodes)
        first = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(first, after, nodes)
        more = (least[known] == nodes) & (first[after] != nodes)
        return pa.RecordBatch.from_arrays([pa.array(first[after][more]), pa.array(nodes[more])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for name, node, role, size, key, component in zip(*(c if k == 4 else c.to_pylist() for k, c in enumerate(batch.columns)), strict=True):
                if name != now:
                    if len(rows) > 1 and (made := links(rows)):
                        yield made
                    now, rows = name, []
                rows.append((node, role, size, key.as_py(), component))
        if len(rows) > 1 and (made := links(rows)):
            yield made

    return run


#: Links for each file of an edge table, and nodes of which a round's smallest neighbours are broadcast.
EDGES_A_FILE = SMALL = 200_000


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """id, component (smallest id reachable) of all ids in edges (a, b), by alternating large and small stars.

    Runs until nothing changes; with ``most_rounds``, fails if that isn't enough. Each round is written to the shared
    folder; only a count and a sum of hashes come back to see whether it changed.
    """

    def settled(df: DataFrame, most: int) -> tuple[DataFrame, tuple]:
        out = tables.written(df.coalesce(max(1, -(-most // EDGES_A_FILE))), "edges")
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, seen = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), edges.count())
    rounds = 0
    while seen[0]:
        if rounds == most_rounds:
            raise RuntimeError(f"components have not settled in {most_rounds} rounds")
        rounds += 1
        held = F.broadcast if 2 * seen[0] <= SMALL else lambda df: df  # a row a node, two nodes a link at most
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(held(least), "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # every node now points at smaller ones: (a, b), a < b; the small star hangs them all on the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(held(least), "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        then, after = settled(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), 2 * seen[0])
        if after == seen:
            break
        now, seen = then, after
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))


def _joined_lists(rows: DataFrame, nodes: DataFrame, found: DataFrame | None, settings: Settings) -> DataFrame:
    """Links (a, b) within each list. rows: name, node, role; found: components known before."""
    rows = rows.join(nodes.select("node", "size", "keys"), "node")
    rows = _labelled(rows, found)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("name", "node", "role", "size", "keys", "component").repartition(n, "name").sortWithinPartitions("name")
    return dealt.mapInArrow(_joined(settings.percent), "a long, b long")


def _labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """With the node's component, itself where none is known."""
    if found is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _parts(n: Column, size: Column, settings: Settings) -> Column:
    """Parts that a list of n sets and so many bytes is dealt into."""
    return F.greatest(F.ceil(n / settings.chunk), F.ceil(size / settings.chunk_bytes)).cast("int")


def _dealt_by(columns: list[str], parts: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), parts).cast("int")


def _lists(nodes: DataFrame, settings: Settings) -> DataFrame:
    """gram, node, bytes, size, index (in the index prefix), n and list_bytes of the list; lists without an index side can't link."""
    rows = nodes.select("node", "size", F.length("keys").cast("long").alias("bytes"), "n_index", F.posexplode("prefix").alias("at", "gram"))
    rows = rows.select("gram", "node", "size", "bytes", (F.col("at") < F.col("n_index")).alias("index"))
    counts = rows.groupBy("gram").agg(F.count("*").alias("n"), F.sum("bytes").alias("list_bytes"), F.max("index").alias("some")).where("n > 1 and some").drop("some")
    return rows.join(_narrow(counts, "ngram-counts"), "gram")


def _narrow(df: DataFrame, name: str) -> DataFrame:
    """A row an n-gram, written; joined by a broadcast while there are few of them, so that a long list isn't dealt to one task."""
    return tables.small_or_not(tables.written(df, name), SMALL)


def _first_links(lists: DataFrame, nodes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame | None]:
    """Edges and components after each set has met those that chose the same of its n-grams, the one of the longest list.

    Groups beyond a trie are dealt out by hash, then meet by up to eight sets of each component and n-gram; this only
    brings connections forward.
    """
    best = F.max(F.struct("n", "gram")).alias("best")
    chosen = tables.written(lists.groupBy("node").agg(best, F.max("bytes").alias("bytes")).select("best.gram", "node", "bytes"), "ngram-chosen")
    edges, found = None, None
    rows = chosen
    for _ in range(3):
        groups = rows.groupBy("gram").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).where("n > 1")
        parts = tables.written(groups.select("gram", _parts(F.col("n"), F.col("total"), settings).alias("parts")), "ngram-parts")
        dealt = rows.join(tables.small_or_not(parts), "gram").withColumn("part", _dealt_by(["node"], F.col("parts")))
        name = F.concat_ws(":", F.col("gram").cast("string"), F.col("part").cast("string"))
        links = tables.written(_joined_lists(dealt.select(name.alias("name"), "node", F.lit(_TRIE | _PROBE).alias("role")), nodes, found, settings), "ngram-links")
        edges = links if edges is None else edges.unionByName(links)
        found = tables.written(components(edges), "ngram-components")
        long = parts.where("parts > 1").select("gram")
        if long.isEmpty():
            break
        left = _labelled(rows.join(tables.small_or_not(long), "gram", "left_semi"), found)
        open_ = left.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gram")
        some = left.join(_narrow(open_, "ngram-open"), "gram", "left_semi").groupBy("gram", "component", _dealt_by(["node"], F.lit(8)).alias("part")).agg(F.min(F.struct("node", "bytes")).alias("one"))
        rows = tables.written(some.select("gram", "one.node", "one.bytes"), "ngram-chosen")
        if rows.isEmpty():
            break
    return edges, found


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists whose sets aren't one component, with components."""
    labelled = _labelled(lists, found)
    open_ = labelled.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gram")
    return labelled.join(_narrow(open_, "ngram-open"), "gram", "left_semi")


def _cells(hot: DataFrame, settings: Settings) -> DataFrame:
    """name, node, role of lists beyond a trie, dealt by size band and into cells that cover all pairs with an index side."""
    ratio = float(np.log(100 / settings.percent)) * (1 + 1e-9)  # linked sets are less than one band apart
    band = F.floor(F.log(F.col("size").cast("double")) / ratio).cast("int")
    lower = F.array(F.struct(band.alias("band"), F.col("index").alias("index")), F.struct((band - 1).alias("band"), F.lit(False).alias("index")))
    rows = hot.select("gram", "node", "bytes", "component", F.explode(lower).alias("b")).select("gram", "node", "bytes", "component", "b.*")
    one = lambda c: F.sum(F.when(F.col("index"), c).otherwise(0))
    groups = rows.groupBy("gram", "band").agg(one(F.lit(1)).alias("n_in"), one(F.col("bytes")).alias("in_bytes"), F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"), F.min("component").alias("x"), F.max("component").alias("y")).where("n_in > 0 and n > 1 and x <> y")
    groups = groups.select("gram", "band", _parts(F.col("n_in"), F.col("in_bytes"), settings).alias("rows"), _parts(F.col("n"), F.col("all_bytes"), settings).alias("columns"))
    rows = rows.join(_narrow(groups, "ngram-bands"), ["gram", "band"])
    own = F.struct(_dealt_by(["node"], F.col("rows")).alias("row"), _dealt_by(["gram", "node"], F.col("columns")).alias("column"))
    rows = rows.withColumn("at", own)
    cell = lambda row, column, role: F.struct(row.alias("row"), column.alias("column"), F.lit(role).alias("role"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    probe = F.transform(every(F.col("rows")), lambda i: cell(i, F.col("at.column"), _PROBE))
    stand = F.transform(every(F.col("columns")), lambda j: cell(F.col("at.row"), j, _TRIE))
    cells = F.explode(F.concat(probe, F.when(F.col("index"), stand).otherwise(F.array().cast("array<struct<row: int, column: int, role: int>>"))))
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in ("gram", "band", "cell.row", "cell.column")])
    return rows.select("gram", "band", "node", cells.alias("cell")).select(name.alias("name"), "node", "cell.role")


def _components(nodes: DataFrame, settings: Settings) -> DataFrame:
    """id, component of all nodes that link: first links, then every list that isn't one component yet."""
    lists = tables.written(_lists(nodes, settings), "ngram-lists")
    edges, found = _first_links(lists, nodes, settings)
    short = (F.col("n") <= settings.chunk) & (F.col("list_bytes") <= settings.chunk_bytes)
    left = tables.written(_open(lists, found), "ngram-open")
    if left.isEmpty():
        return found
    # equal lists count once
    name = F.md5(F.array_join(F.transform("list", lambda x: x.cast("string")), ","))
    whole = left.where(short).groupBy("gram").agg(F.sort_array(F.collect_list("node")).alias("list")).groupBy("list").count()
    rows = whole.select(name.alias("name"), F.explode("list").alias("node")).withColumn("role", F.lit(_TRIE | _PROBE))
    edges = edges.unionByName(tables.written(_joined_lists(rows, nodes, found, settings), "ngram-links"))
    found = tables.written(components(edges), "ngram-components")
    hot = left.where(~short).drop("component")
    if hot.isEmpty():
        return found
    hot = tables.written(_open(hot, found), "ngram-open")
    if hot.isEmpty():
        return found
    edges = edges.unionByName(tables.written(_joined_lists(_cells(hot, settings), nodes, found, settings), "ngram-links"))
    return tables.written(components(edges), "ngram-components")


def linked(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, mark (64-bit hash of the text), node (number of the row), n_shingles, component_id, leader.

    leader: the row is the one of its component with the smallest id (of equal ones the first); rows without an id lead themselves.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // settings.bucket_bytes)), 1 << 16)
    dealt = _dealt(docs, settings, n, id_col, text_col).repartitionById(n, F.col("bucket"))
    back = dealt.mapInArrow(_counted, "block long, kind int, bucket int, data binary").repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")
    made = tables.written(back.mapInArrow(_assembled(settings), _SETS), "ngram-sets")
    can = made.where("keys is not null")
    # equal sets of different blocks: all their n-grams are shared
    whole = can.where(F.length("keys") == 8 * F.col("size")).select("node", F.md5("keys").alias("digest"))
    least = whole.groupBy("digest").agg(F.min("node").alias("class"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = tables.written(whole.join(least, "digest").where("node <> class").select("node", "class"), "ngram-equal")
    nodes = tables.written(can.join(tables.small_or_not(again.select("node")), "node", "left_anti").select("node", "size", "prefix", "n_index", "keys"), "ngram-nodes")
    found = _components(nodes, settings)
    rows = made.select("id", "mark", "node", F.col("size").alias("n_shingles"), "first")
    rows = rows.join(tables.small_or_not(again.withColumnRenamed("node", "first")), "first", "left").withColumn("class", F.coalesce("class", "first"))
    rows = rows.join(tables.small_or_not(found.withColumnRenamed("id", "class")), "class", "left").withColumn("component", F.coalesce("component", "class"))
    rows = tables.written(rows.select("id", "mark", "node", "n_shingles", "component"), "ngram-rows")
    groups = rows.groupBy("component").agg(F.min(F.struct("id", "node")).alias("one"), F.count("*").alias("n")).where("n > 1").select("component", "one")
    rows = rows.join(tables.small_or_not(tables.written(groups, "ngram-groups")), "component", "left")
    return rows.select("id", "mark", "node", "n_shingles", F.coalesce("one.id", "id").alias("component_id"), (F.coalesce("one.node", "node") == F.col("node")).alias("leader"))


def jaccard_components(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    return linked(docs, settings, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id")
