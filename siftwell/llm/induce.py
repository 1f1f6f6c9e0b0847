"""Suffix order and common prefixes of a long text by induced sorting with queues that spill to disk.

Suffixes that start a rise after a fall are sorted first: their substrings are
named, and the string of names is sorted by the same routine. Two scans then
induce all others. A scan takes suffixes from a priority queue in order; each
one enters the suffix before it, with the prefix length it shares with its
neighbour. Suffixes enter a queue in the order of their rests, so the queue is
one list per first symbol, and lists beyond the memory allowed lie on disk.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from bisect import bisect_left
from pathlib import Path

import numpy as np

#: Reduced strings up to this length are sorted in memory by doubling.
IN_MEMORY = 1 << 23
#: Bytes of queue entries that stay in memory.
QUEUE_BYTES = 256 << 20


NONE = np.zeros(0, np.int32)


def place_type(n: int) -> type:
    """The smaller integer that holds every place of a text of this length."""
    return np.int32 if n < 1 << 31 else np.int64


class Spool:
    """Arrays put aside: in memory up to a limit, then in files of the task's own that go with it."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.held, self.files = limit, 0, 0
        self.folder: tempfile.TemporaryDirectory | None = None

    def put(self, array: np.ndarray):
        if self.held + array.nbytes <= self.limit:
            self.held += array.nbytes
            return array
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.files += 1
        path = Path(self.folder.name, f"{self.files}.npy")
        np.save(path, array)
        return path

    def take(self, item) -> np.ndarray:
        if isinstance(item, Path):
            array = np.load(item)
            os.unlink(item)
            return array
        self.held -= item.nbytes
        return item

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


class SuffixQueue:
    """Suffixes by first symbol; those of one symbol leave in the order they came.

    An entry is a position and the prefix length shared with the entry before it
    in the same list. Symbols leave in rising order, or falling with sign -1.
    """

    def __init__(self, spool: Spool, sign: int = 1):
        self.spool, self.sign = spool, sign
        self.lists: dict[int, list] = {}
        self.symbols: list[int] = []

    def push(self, symbol: int, positions: np.ndarray, shared: np.ndarray) -> None:
        if symbol not in self.lists:
            self.lists[symbol] = []
            heapq.heappush(self.symbols, self.sign * symbol)
        self.lists[symbol].append(self.spool.put(np.stack([positions, shared])))

    def next_symbol(self) -> int | None:
        return self.sign * self.symbols[0] if self.symbols else None

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts = self.lists.pop(symbol, None)
        if parts is None:
            return NONE, NONE
        heapq.heappop(self.symbols)
        found = np.concatenate([self.spool.take(x) for x in parts], axis=1)
        return found[0], found[1]


class RangeMin:
    """Smallest value of any stretch, from a table of stretches of doubling length."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (1 << len(self.levels)) <= len(values):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima over first..last, both included; first <= last."""
        length = last - first + 1
        level = np.frexp(length.astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        return out


class Inducer:
    """One scan. Sources are fed in order; each enters the suffix before it if that has the scan's type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: SuffixQueue):
        self.text, self.wanted, self.queue = text, wanted, queue
        # Per symbol: bucket and batch of the last entry, and the smallest value behind it in its batch.
        size = int(text.max()) + 1
        self.bucket = np.full(size, -1, np.int64)
        self.batch = np.zeros(size, np.int64)
        self.tail = np.zeros(size, np.int64)
        self.kind = place_type(len(text))
        self.never = np.iinfo(self.kind).max
        self.now, self.turn = -1, 0
        self.turns: list[int] = []
        self.lows: list[int] = []

    def start(self, symbol: int) -> None:
        """The next bucket: it shares nothing with what came before."""
        self.now, self.turn, self.turns, self.lows = symbol, 0, [], []

    def feed(self, positions: np.ndarray, shared: np.ndarray) -> None:
        """A batch of sources of the bucket; ``shared`` with the source before each."""
        if not len(positions):
            return
        turn, self.turn = self.turn, self.turn + 1
        before = positions - 1
        at = np.flatnonzero((positions > 0) & self.wanted[before])
        lowest = RangeMin(shared)
        if len(at):
            symbols = self.text[before[at]]
            by_symbol = np.argsort(symbols, kind="stable")
            at, symbols = at[by_symbol], symbols[by_symbol]
            heads = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
            previous = np.concatenate(([-1], at[:-1]))
            previous[heads] = -1
            values = lowest(previous + 1, at)
            values[heads] = np.minimum(values[heads], self._since(symbols[heads]))
            values += 1
            values[heads[self.bucket[symbols[heads]] < 0]] = 0
            ends = np.concatenate((heads[1:], [len(at)]))
            present, last = symbols[heads], at[ends - 1]
            tails = np.full(len(last), self.never)
            open_ = last + 1 < len(positions)
            tails[open_] = lowest(last[open_] + 1, np.full(int(open_.sum()), len(positions) - 1))
            self.bucket[present], self.batch[present], self.tail[present] = self.now, turn, tails
            for symbol, a, b in zip(present.tolist(), heads.tolist(), ends.tolist()):
                self.queue.push(symbol, before[at[a:b]], values[a:b])
        low = int(shared.min())
        while self.lows and self.lows[-1] >= low:
            self.lows.pop()
            self.turns.pop()
        self.lows.append(low)
        self.turns.append(turn)

    def _since(self, symbols: np.ndarray) -> np.ndarray:
        """Smallest shared value since each symbol's last entry, before this batch."""
        out = np.zeros(len(symbols), np.int64)
        for i in np.flatnonzero(self.bucket[symbols] == self.now).tolist():
            s = symbols[i]
            k = bisect_left(self.turns, int(self.batch[s]) + 1)
            out[i] = min(int(self.tail[s]), self.lows[k] if k < len(self.lows) else self.never)
        return out


def refined(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tells ``active`` items, tied so far, apart by ``key``: ranks (places of the first of equals) change in place.

    Returns the items that are still tied. Ties are always given whole.
    """
    held = rank[active].astype(np.int64)
    if not held.any():
        by = np.argsort(key)
    elif key.dtype == np.uint64:
        by = np.lexsort((key, held))
    else:
        by = np.argsort(held * np.int64(len(rank) + 1) + key)
    items, keys, old = active[by], key[by], held[by]
    place = np.arange(len(items))
    new_group = np.concatenate(([True], old[1:] != old[:-1]))
    group = np.maximum.accumulate(np.where(new_group, place, 0))
    differs = new_group.copy()
    differs[1:] |= keys[1:] != keys[:-1]
    first = np.maximum.accumulate(np.where(differs, place, 0))
    rank[items] = old + first - group
    return items[~differs | ~np.append(differs[1:], True)]


def tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def named(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each start to the next, both ends included.

    Where one substring begins another, the longer one is smaller: there the text
    still falls. As many symbols are taken at a time as a word has room for, and
    only while ties remain.
    """
    bits = (int(text.max()) + 1).bit_length()
    per = 64 // bits
    lengths = np.diff(starts, append=starts[-1]) + 1
    padded = np.concatenate((text, np.zeros(per, text.dtype)))
    top = np.uint64((1 << bits) - 1)

    def word(items: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(items), np.uint64)
        at, left = starts[items] + k * per, lengths[items] - k * per
        for j in range(per):
            symbol = padded[np.minimum(at + j, len(text))].astype(np.uint64)
            symbol[left <= j] = top
            out <<= np.uint64(bits)
            out |= symbol
        return out

    rank = np.zeros(len(starts), place_type(len(starts)))
    active, k = np.arange(len(starts)), 0
    while len(active):
        active = refined(rank, active, word(active, k))
        k += 1
        # One that ends with the last word still has to meet longer ones that go on.
        active = active[lengths[active] >= k * per]
    return rank


def doubled(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a string of ranks and the number of names neighbours share, all in memory."""
    n, step = len(names), 1
    rank = names.astype(place_type(n))
    levels = [rank.copy()]
    active = tied(rank)
    while len(active):
        ahead = np.minimum(active + step, n - 1)
        key = np.where(active + step < n, rank[ahead].astype(np.int64), -1)
        active = refined(rank, active, key)
        levels.append(rank.copy())
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + shared[1:], b + shared[1:]
        inside = np.maximum(i, j) < n
        same = inside.copy()
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        shared[1:][same] += 1 << k
    return order, shared


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal symbols from a and from b on; the last symbol of the text is unique."""
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left):
        i, j = a[left] + out[left], b[left] + out[left]
        inside = np.maximum(i, j) < len(text)
        left = left[inside]
        left = left[text[i[inside]] == text[j[inside]]]
        out[left] += 1
    return out


def suffix_order(text: np.ndarray, in_memory: int = IN_MEMORY, queue_bytes: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the number of symbols each shares with the one before it.

    ``text`` is unsigned and ends with its only zero.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    rises = text[1:] > text[:-1]
    changes = np.concatenate((text[1:] != text[:-1], [True]))
    # Where the run of equal symbols that holds a position ends; its direction there decides the type.
    kind = place_type(n)
    everywhere = np.arange(n, dtype=kind)
    run_end = np.minimum.accumulate(np.where(changes, everywhere, kind(n))[::-1])[::-1]
    small = np.concatenate((rises, [True]))[run_end]
    run = run_end - everywhere + kind(1)
    del rises, changes, run_end, everywhere
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    rank = named(text, starts)
    if len(np.unique(rank)) == len(rank):
        order, alike = np.argsort(rank), np.zeros(len(rank), np.int64)
    elif len(rank) <= in_memory:
        order, alike = doubled(rank)
    else:
        _, dense = np.unique(rank, return_inverse=True)
        order, alike = suffix_order(dense.astype(np.uint32), in_memory, queue_bytes)
    del rank
    seeds = starts[order]
    seed_shared = np.zeros(len(seeds), np.int64)
    if len(seeds) > 1:
        i, j = order[:-1] + alike[1:], order[1:] + alike[1:]
        matched = starts[i] - seeds[:-1]
        seed_shared[1:] = matched + common(text, starts[i], starts[j])

    spool = Spool(queue_bytes)
    try:
        return _induced(text, small, run, seeds.astype(kind), seed_shared.astype(kind), spool)
    finally:
        spool.close()


def _induced(text, small, run, seeds, seed_shared, spool) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    none = np.zeros(0, run.dtype)
    # First scan, rising: falling suffixes from the seeds and from each other.
    queue = SuffixQueue(spool)
    scan = Inducer(text, ~small, queue)
    seed_symbols = text[seeds]
    heads = np.flatnonzero(np.concatenate(([True], seed_symbols[1:] != seed_symbols[:-1])))
    seeded = dict(zip(seed_symbols[heads].tolist(), zip(heads.tolist(), [*heads[1:].tolist(), len(seeds)])))
    waiting = sorted(seeded, reverse=True)
    falling: dict[int, list] = {}
    while waiting or queue.symbols:
        symbol = min(x for x in (waiting[-1] if waiting else None, queue.next_symbol()) if x is not None)
        scan.start(symbol)
        last = None
        while queue.next_symbol() == symbol:
            positions, shared = queue.pop(symbol)
            falling.setdefault(symbol, []).append(spool.put(np.stack([positions, shared])))
            scan.feed(positions, shared)
            last = positions[-1]
        if waiting and waiting[-1] == symbol:
            waiting.pop()
            a, b = seeded[symbol]
            shared = seed_shared[a:b].copy()
            shared[0] = 0 if last is None else min(run[last], run[seeds[a]])
            scan.feed(seeds[a:b], shared)
    # Second scan, falling: rising suffixes from the falling ones and from each other.
    queue = SuffixQueue(spool, -1)
    scan = Inducer(text, small, queue)
    waiting = sorted(falling)
    pieces: list[tuple] = []
    while waiting or queue.symbols:
        symbol = max(x for x in (waiting[-1] if waiting else None, queue.next_symbol()) if x is not None)
        scan.start(symbol)
        rising, last = [], None
        while queue.next_symbol() == symbol:
            positions, shared = queue.pop(symbol)
            rising.append(np.stack([positions, shared]))
            scan.feed(positions, shared)
            last = positions[-1]
        up = np.concatenate(rising, axis=1) if rising else np.stack([none, none])
        down = np.stack([none, none])
        if waiting and waiting[-1] == symbol:
            waiting.pop()
            down = np.concatenate([spool.take(x) for x in falling.pop(symbol)], axis=1)
            shared = down[1, ::-1].copy()
            shared[1:] = shared[:-1]
            shared[0] = 0 if last is None else min(run[last], run[down[0, -1]])
            scan.feed(down[0, ::-1], shared)
        # The bucket in rising order: falling suffixes, then the rising ones, which came from the largest down.
        between = min(run[down[0, -1]], run[up[0, -1]]) if down.shape[1] and up.shape[1] else 0
        shared = np.concatenate((down[1], np.full(min(1, up.shape[1]), between, run.dtype), up[1, :0:-1]))
        pieces.append((np.concatenate((down[0], up[0, ::-1])), shared))
    pieces.append((np.array([n - 1], run.dtype), np.zeros(1, run.dtype)))
    order = np.concatenate([p for p, _ in reversed(pieces)])
    shared = np.concatenate([s for _, s in reversed(pieces)])
    return order, shared
