"""External induced sorting of suffixes over integer alphabets, in numpy.

The suffixes that begin local minima of the text are named and ordered by recursion; the order of all
others is induced in two scans, larger-first suffixes by ascending and smaller-first ones by
descending first symbol (Bingmann, Fischer and Osipov, 2013).  A scan takes its tuples (symbol, rank
of the following suffix, position, common prefix of that suffix and the one of the tuple before) from
a disk-backed queue that is cut into blocks of symbols.  A block is loaded, closed under predecessors
that belong to the same block, ordered, and its other predecessors are pushed to later blocks.  A
block is as large as ``block_items`` or the share of a single symbol.  What the recursion orders goes
through such a queue, too.  So memory holds the text, the type of each suffix, the places of the local
minima, one block and ``held_items`` rows of each queue; no order of all suffixes.  Within a block, a tuple's order depends on a chain of followers; chains are resolved
by pointer doubling.

Neighbours with the same first symbol share one symbol more than the suffixes that follow them, and
these share the least of the common prefixes between their ranks.  So values, capped at ``bound``,
go along with the tuples and through the recursion; only pieces that the recursion tells apart, and
the borders between larger-first and smaller-first suffixes of a symbol, are compared directly.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs

#: Suffixes of a block, and rows of a queue that are held before they are written: 4 MB of tuples.
BLOCK_ITEMS = 1 << 17
HELD_ITEMS = 1 << 17
IN_MEMORY = 1 << 15

_serial = itertools.count()


class Scratch:
    """A folder of the shared storage for queue runs, removed at the end."""

    def __init__(self, uri: str, name: str):
        uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
        self.fs, base = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
        self.base = f"{base}/{name}"
        self.made = False

    def write(self, rows: np.ndarray) -> str:
        if not self.made:
            self.fs.create_dir(self.base, recursive=True)
            self.made = True
        path = f"{self.base}/run-{next(_serial)}"
        with self.fs.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(rows).tobytes())
        return path

    def read(self, path: str, width: int, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi of a run."""
        with self.fs.open_input_file(path) as file:
            file.seek(lo * width * 8)
            return np.frombuffer(file.read((hi - lo) * width * 8), dtype=np.int64).reshape(-1, width)

    def delete(self, path: str) -> None:
        self.fs.delete_file(path)

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.base)
            self.made = False


class DiskQueue:
    """Rows of int64 for numbered blocks; once more than ``held_items`` are in memory, they are written
    as one run, sorted by block.  A run is deleted when all its blocks have been popped."""

    def __init__(self, scratch: Scratch, width: int, held_items: int):
        self.scratch, self.width, self.limit = scratch, width, held_items
        self.held: dict[int, list[np.ndarray]] = defaultdict(list)
        self.runs: dict[int, list[tuple[str, int, int]]] = defaultdict(list)
        self.unread: dict[str, int] = {}
        self.items = 0

    def push(self, block: np.ndarray, *columns: np.ndarray) -> None:
        if not len(block):
            return
        order = np.argsort(block, kind="stable")
        rows, block = np.stack(columns, 1)[order], block[order]
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for lo, hi in zip(at, np.r_[at[1:], len(block)]):
            self.held[int(block[lo])].append(rows[lo:hi])
        self.items += len(block)
        if self.items > self.limit:
            self._spill()

    def _spill(self) -> None:
        path = self.scratch.write(np.concatenate([part for b in sorted(self.held) for part in self.held[b]]))
        self.unread[path], at = len(self.held), 0
        for b in sorted(self.held):
            size = sum(map(len, self.held[b]))
            self.runs[b].append((path, at, at + size))
            at += size
        self.held.clear()
        self.items = 0

    def pop(self, block: int) -> np.ndarray:
        """All rows of a block, in the order in which they were pushed."""
        parts = []
        for path, lo, hi in self.runs.pop(block, []):
            parts.append(self.scratch.read(path, self.width, lo, hi))
            self.unread[path] -= 1
            if not self.unread[path]:
                self.scratch.delete(path)
                del self.unread[path]
        held = self.held.pop(block, [])
        self.items -= sum(map(len, held))
        return np.concatenate([*parts, *held]) if parts or held else np.zeros((0, self.width), np.int64)


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _resolved(rank: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """Ranks by (rank, rank of the follower, ...); an item that ends a chain follows itself."""
    n = len(rank)
    while n and rank.max() < n - 1:
        rank, follower = _dense(rank * (n + 1) + rank[follower]), follower[follower]
    return rank


def _doubling(text: np.ndarray) -> np.ndarray:
    """Suffix order of a short text in memory."""
    n, rank, k = len(text), _dense(text), 1
    while n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        rank, k = _dense(rank * (n + 1) + after), 2 * k
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _smaller_first(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the empty suffix is the smallest."""
    step = np.r_[text[:-1] != text[1:], True]
    up = np.r_[text[:-1] < text[1:], False]
    at = np.where(step, np.arange(len(text)), len(text) - 1)
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _named(text: np.ndarray, small: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """Names of the pieces between local minima (both included), in the order of the pieces."""
    symbol = text * 2 + small
    end = np.r_[minima[1:], len(text)]
    rank, depth = _dense(symbol[minima]), 0
    open_ = np.arange(len(minima))
    while len(open_):
        depth += 1
        sizes = np.bincount(rank)
        open_ = open_[(sizes[rank[open_]] > 1) & (minima[open_] + depth <= end[open_])]
        if not len(open_):
            break
        at = minima[open_] + depth
        sub = np.where(at < len(text), symbol[np.minimum(at, len(text) - 1)] + 1, 0)
        order = np.lexsort((sub, rank[open_]))
        r, s = rank[open_][order], sub[order]
        new = np.r_[False, (r[1:] == r[:-1]) & (s[1:] != s[:-1])]
        if new.any():
            # a group's later parts move up, and all that was above it with them
            whole, sub_rank = rank.copy(), np.zeros(len(rank), np.int64)
            begin = np.r_[True, r[1:] != r[:-1]]
            within = np.cumsum(new) - np.maximum.accumulate(np.where(begin, np.cumsum(new), 0))
            sub_rank[open_[order]] = within
            rank = _dense(whole * (int(within.max()) + 1) + sub_rank)
    return rank


def _blocks(count: np.ndarray, items: int) -> np.ndarray:
    """Block of each symbol: consecutive symbols with about ``items`` suffixes together."""
    total = np.cumsum(count)
    block = (total - count) // max(items, 1)
    return _dense(block)


def _compared(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, bound: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, of which ``known`` symbols are known, up to ``bound``."""
    out = np.minimum(known, bound).astype(np.int64)
    open_ = np.flatnonzero(out < bound)
    while len(open_):
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        open_, x, y = (z[(x < len(text)) & (y < len(text))] for z in (open_, x, y))
        open_ = open_[text[x] == text[y]]
        out[open_] += 1
        open_ = open_[out[open_] < bound]
    return out


class _RangeMinimum:
    def __init__(self, values: np.ndarray):
        self.tables = [values.astype(np.int16)]
        while 2 << (len(self.tables) - 1) <= len(values):
            half, last = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over lo..hi, both included."""
        out = np.zeros(len(lo), np.int64)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.tables[k][lo[at]], self.tables[k][hi[at] - (1 << int(k)) + 1])
        return out


def suffix_blocks(text: np.ndarray, scratch: Scratch, *, bound: int = 50, block_items: int = BLOCK_ITEMS, held_items: int = HELD_ITEMS, in_memory: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions in order, common prefix of each with the one before), from the last block to the first.

    ``text`` has symbols 0..; a symbol's suffixes are all in one block.  Common prefixes count up to ``bound``.
    """
    text = np.asarray(text, dtype=np.int64)
    n = len(text)
    if n <= in_memory:
        if n:
            order = _doubling(text)
            yield order, np.r_[0, _compared(text, order[:-1], order[1:], np.zeros(n - 1, np.int64), bound)]
        return
    small = _smaller_first(text)
    minima = np.flatnonzero(small & ~np.r_[True, small[:-1]])
    names = _named(text, small, minima)
    block_of = _blocks(np.bincount(text), block_items)
    blocks = int(block_of[-1]) + 1
    sorted_minima = DiskQueue(scratch, 2, held_items)
    options = {"bound": bound, "block_items": block_items, "held_items": held_items, "in_memory": in_memory}
    for at, common in _with_neighbours(text, _minima_down(n, minima, names, scratch, options), bound):
        sorted_minima.push(block_of[text[at]][::-1], at[::-1], common[::-1])
    del names, minima
    kept = DiskQueue(scratch, 2, held_items)
    first = (block_of[text[n - 1 :]], text[n - 1 :], np.array([-1]), np.array([n - 1]), np.array([0]))
    seeds = lambda b: tuple(sorted_minima.pop(b)[::-1].T)
    for b, at, common in _scanned(text, ~small, block_of, range(blocks), seeds, DiskQueue(scratch, 4, held_items), first, bound):
        larger = np.flatnonzero(~small[at])
        kept.push(np.full(len(larger), b), at[larger], common[larger])

    def larger_down(b: int) -> tuple[np.ndarray, np.ndarray]:
        rows = kept.pop(b)[::-1]  # what one shares with the one before, the one before shares with it
        return rows[:, 0], np.r_[0, rows[:-1, 1]][: len(rows)]

    for _, at, common in _scanned(text, small, block_of, range(blocks - 1, -1, -1), larger_down, DiskQueue(scratch, 4, held_items), None, bound):
        yield at[::-1], np.r_[0, common[1:][::-1]][: len(at)]


def _minima_down(n: int, minima: np.ndarray, names: np.ndarray, scratch: Scratch, options: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The local minima in the order of their suffixes, in parts from the last to the first, and how many
    symbols each is known to share with the one before it in its part."""
    if not len(minima):
        return
    if names.max() == len(minima) - 1:
        order = np.empty_like(minima)
        order[names] = minima
        yield order, np.zeros(len(order), np.int64)
        return
    ends = np.r_[minima, n]
    for order, shared in suffix_blocks(names, scratch, **options):
        yield minima[order], ends[order + np.minimum(shared, len(minima) - order)] - minima[order]


def _with_neighbours(text: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]], bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``parts`` with the common prefix of each position with the one before, also across parts."""
    later = None
    for part in itertools.chain(parts, [None]):
        if later is not None:
            at, known = later
            before = np.r_[at[:1] if part is None else part[0][-1:], at[:-1]]
            common = _compared(text, before, at, np.r_[0, known[1:]], bound)
            if part is None:
                common[0] = 0
            yield at, common
        later = part


def _scanned(text, wanted, block_of, sequence, seeds, queue: DiskQueue, first, bound: int):
    """One scan: (block, positions, common prefixes with the position before), as the scan meets them.

    In a symbol's share, suffixes of the wanted kind come first: those that earlier blocks have
    pushed, then those that this block induces; the seeds come last.
    """
    up = sequence.step > 0
    if first is not None:
        queue.push(*first)
    base = 0
    for b in sequence:
        known, (ends, ends_common) = queue.pop(b), seeds(b)
        members, follower = _closed(np.r_[known[:, 2], ends], text, wanted, block_of, b)
        kind = np.full(len(members), 1)
        second, value = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
        k, e = len(known), len(known) + len(ends)
        kind[:k], kind[k:e] = 0, 2
        second[:k], second[k:e] = known[:, 1], np.arange(len(ends))
        value[:k], value[k:e] = np.minimum(known[:, 3] + 1, bound), ends_common
        symbol = text[members] if up else -text[members]
        done = _ordered(symbol, kind, second, follower)
        at, kind, common = members[done], kind[done], value[done]
        place = np.empty_like(done)
        place[done] = np.arange(len(done))
        same = np.r_[False, text[at[1:]] == text[at[:-1]]][: len(at)]
        common[~same] = 0
        border = np.flatnonzero(same & (kind == 2) & (np.r_[2, kind[:-1]] != 2)) if len(at) else np.zeros(0, np.int64)
        common[border] = _compared(text, at[border - 1], at[border], np.ones(len(border), np.int64), bound)
        inner = np.flatnonzero(same & (kind == 1))
        common[inner] = 1  # where the one before is of an earlier block, as their followers begin differently
        inner = inner[kind[inner - 1] == 1]
        if len(inner):
            lo, hi = place[follower[done[inner - 1]]] + 1, place[follower[done[inner]]]
            common[inner] = bound
            while True:
                now = np.minimum(_RangeMinimum(common).least(lo, hi) + 1, bound)
                if np.array_equal(now, common[inner]):
                    break
                common[inner] = now
        ok = np.flatnonzero(at > 0)
        ok = ok[wanted[at[ok] - 1]]
        to = block_of[text[at[ok] - 1]]
        ok = ok[to > b if up else to < b]
        before = at[ok] - 1
        turn = np.argsort(text[before], kind="stable")
        here, c = ok[turn], text[before[turn]]
        pair = np.flatnonzero(np.r_[False, c[1:] == c[:-1]]) if len(c) else np.zeros(0, np.int64)
        carried = np.zeros(len(ok), np.int64)
        if len(pair):
            carried[turn[pair]] = _RangeMinimum(common).least(here[pair - 1] + 1, here[pair])
        queue.push(block_of[text[before]], text[before], base + ok, before, carried)
        base += len(at)
        yield b, at, common


def _closed(start: np.ndarray, text, wanted, block_of, b) -> tuple[np.ndarray, np.ndarray]:
    """``start`` and all predecessors of the wanted kind that lie in block b; who follows each."""
    members, follower, front, at = [start], [np.arange(len(start))], start, np.arange(len(start))
    size = len(start)
    while len(front):
        ok = np.flatnonzero(front > 0)
        ok = ok[wanted[front[ok] - 1]]
        ok = ok[block_of[text[front[ok] - 1]] == b]
        front, before = front[ok] - 1, at[ok]
        at = size + np.arange(len(front))
        members.append(front)
        follower.append(before)
        size += len(front)
    return np.concatenate(members), np.concatenate(follower)


def _ordered(symbol, kind, second, follower) -> np.ndarray:
    order = np.lexsort((second, kind, symbol))
    a, b, c = symbol[order], kind[order], second[order]
    new = np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])][: len(order)]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    rank = _resolved(rank, follower)
    done = np.empty_like(order)
    done[rank] = np.arange(len(order))
    return done


def common_runs(common: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Group number of each position of a block: neighbours share it whose first ``length`` symbols are
    equal; -1 where fewer than ``length`` symbols remain (``room``)."""
    able = room >= length
    same = np.r_[False, (common[1:] >= length) & able[1:] & able[:-1]][: len(common)]
    return np.where(able, np.cumsum(~same), -1)
