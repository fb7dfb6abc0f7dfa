"""Suffix sorting with common-prefix values by external induced sorting.

Suffixes travel as tuples (position, preceding bytes, common prefix with the tuple before) through
disk-backed priority queues.  Over bytes a queue's priority is (first byte, arrival): one spooled
first-in-first-out list per byte, filled and drained in bulk with numpy.  Over the names of a
recursion level, whose alphabet is large, it is a heap that spills sorted runs.

Steps of one level: classify suffixes (L: larger than the next, S: smaller); sort the substrings
between leftmost-S positions by inducing from them in any order; name them; sort the string of names
(recursion; in memory once it fits); induce all L, then all S suffixes from the sorted seeds.
Common prefixes are induced along: two neighbours share one byte more than the least value between
the two suffixes that induced them.  Values stop at 255 or a given depth, and at a 0 byte: every 0 ends a string of
its own.

Memory holds a bounded number of tuples and one block of everything else: text, positions, names and
orders are files (:class:`Shelf`) beyond a bound.  Spool files are scratch of one task, as Spark's own
spills are, and vanish with it: a task that runs again on another executor starts from its shuffle
input.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np

TUPLE = np.dtype([("pos", "<i8"), ("prev", "<u8"), ("lcp", "u1")])
MEMORY_TUPLES = 2_000_000
#: Names of a recursion level that are sorted in memory (about 40 bytes each), per tuple held in memory.
NAMES_PER_TUPLE = 2
_AHEAD = 7  # preceding bytes that a tuple carries


def scratch_dir() -> str | None:
    """Spark's scratch folder of this executor, if there is one."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)), None)


class Shelf:
    """Items of one type in order of arrival; beyond ``room`` bytes they move to a scratch file."""

    def __init__(self, kind, room: int):
        self.kind, self.room = np.dtype(kind), room
        self.parts: list[np.ndarray] = []
        self.file, self.held, self.size = None, 0, 0

    def append(self, block: np.ndarray) -> None:
        self.parts.append(np.ascontiguousarray(block, self.kind))
        self.held += self.parts[-1].nbytes
        self.size += len(block)
        if self.held > self.room:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=scratch_dir())
        for part in self.parts:
            self.file.write(part.data)
        self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        """All items, in memory or mapped from the file."""
        if self.file is None:
            if len(self.parts) != 1:
                self.parts = [np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)]
            return self.parts[0]
        self._write()
        self.file.flush()
        return np.memmap(self.file, self.kind, "r+", shape=(self.size,))

    def close(self) -> None:
        self.parts = []
        if self.file is not None:
            self.file.close()


def blank(n: int, kind, room: int) -> np.ndarray:
    """An array of zeros, a mapped scratch file if it is larger than ``room`` bytes."""
    kind = np.dtype(kind)
    if n * kind.itemsize <= room:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile(dir=scratch_dir()) as file:  # the map keeps the file
        file.truncate(n * kind.itemsize)
        return np.memmap(file, kind, "r+", shape=(n,))


def blocks(n: int, step: int) -> Iterator[slice]:
    return (slice(k, min(k + step, n)) for k in range(0, n, step))


class Spool:
    """A scratch file with append-only lists; holds ``limit`` tuples in memory at most."""

    def __init__(self, limit: int):
        self.file = tempfile.TemporaryFile(dir=scratch_dir())
        self.limit, self.held, self.end = limit, 0, 0
        self.queues: list[Queue] = []

    def close(self) -> None:
        self.file.close()

    def spill(self) -> None:
        for q in self.queues:
            q.flush()
        self.held = 0


def _joined(blocks: list[np.ndarray]) -> np.ndarray:
    """One array of tuples; as plain bytes, since joining records field by field is slow."""
    return blocks[0] if len(blocks) == 1 else np.concatenate([b.view(_RAW) for b in blocks]).view(TUPLE)


_RAW = np.dtype((np.void, TUPLE.itemsize))


class Queue:
    """Tuples in order of arrival; can be drained while it is filled, and read again backwards."""

    def __init__(self, spool: Spool):
        self.spool, self.parts, self.fresh, self.size, self.at = spool, [], [], 0, 0
        spool.queues.append(self)

    def append(self, block: np.ndarray) -> None:
        if len(block):
            self.fresh.append(block)
            self.size += len(block)
            self.spool.held += len(block)
            if self.spool.held > self.spool.limit:
                self.spool.spill()

    def flush(self) -> None:
        if self.fresh:
            block = _joined(self.fresh)
            self.fresh = []
            f = self.spool.file
            f.seek(self.spool.end)
            f.write(block.tobytes())
            step = max(1, self.spool.limit // 4)
            for k in range(0, len(block), step):
                self.parts.append((self.spool.end + k * TUPLE.itemsize, min(step, len(block) - k)))
            self.spool.end += block.nbytes

    def _read(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        self.spool.file.seek(part[0])
        return np.frombuffer(self.spool.file.read(part[1] * TUPLE.itemsize), TUPLE)

    def drain(self) -> Iterator[np.ndarray]:
        k = 0
        while True:
            if k == len(self.parts):
                if not self.fresh:
                    return
                self.parts.append(_joined(self.fresh))
                self.fresh = []
            self.at = k
            yield self._read(self.parts[k])
            if isinstance(self.parts[k], np.ndarray) and self.spool.held > self.spool.limit // 2:  # drained tuples go to disk first
                block, self.parts[k] = self.parts[k], None
                self.spool.file.seek(self.spool.end)
                self.spool.file.write(block.tobytes())
                self.parts[k] = (self.spool.end, len(block))
                self.spool.end += block.nbytes
                self.spool.held -= len(block)
            k += 1

    def backwards(self) -> Iterator[np.ndarray]:
        parts = self.parts + self.fresh
        for part in reversed(parts):
            yield self._read(part)[::-1]


class Heap:
    """Priority queue of integer triples that spills sorted runs beyond ``limit`` entries.

    Of every run a small piece is in memory; many runs are merged into one.
    """

    RUNS = 32

    def __init__(self, limit: int):
        self.heap: list[tuple[int, int, int]] = []
        self.runs: list[tuple[tuple[int, int, int], int, Iterator]] = []
        self.limit, self.spilled = max(4, limit), 0
        self.piece = max(4, self.limit // (2 * self.RUNS))

    def push(self, item: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            heap, self.heap = self.heap, []
            self._spill(iter(heap))
            if len(self.runs) >= self.RUNS:
                merged = heapq.merge(*(chain([first], run) for first, _, run in self.runs))
                self.runs = []
                self._spill(merged)

    def _spill(self, items: Iterator[tuple[int, int, int]]) -> None:
        f = tempfile.TemporaryFile(dir=scratch_dir())  # closed with its last reader
        while some := list(islice(items, self.piece)):
            f.write(np.array(some, np.int64).tobytes())
        f.seek(0)
        self.spilled += 1
        self._advance(self.spilled, self._run(f))

    def _run(self, f) -> Iterator[tuple[int, int, int]]:
        while data := f.read(24 * self.piece):
            yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, 3).tolist())
        f.close()

    def _advance(self, k: int, run: Iterator) -> None:
        if (item := next(run, None)) is not None:
            heapq.heappush(self.runs, (item, k, run))

    def peek(self) -> tuple[int, int, int] | None:
        if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
            return self.heap[0]
        return self.runs[0][0] if self.runs else None

    def pop(self) -> tuple[int, int, int]:
        if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        item, k, run = heapq.heappop(self.runs)
        self._advance(k, run)
        return item

    def close(self) -> None:
        self.heap, self.runs = [], []


def _leftmost_s(text: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Blocks of leftmost-S positions, from right to left; the end counts as smaller than all and is none."""
    n, right = len(text), None
    for hi in range(n, 0, -step):  # a block's last type comes from the right
        lo = max(0, hi - step)
        here = text[lo:hi].astype(np.int64)
        after = np.append(here[1:], int(text[hi]) if hi < n else -1)
        change = here != after
        nearest = np.where(change, np.arange(len(here)), len(here))
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        open_end = bool(right[0]) if right is not None else False
        is_s = np.append(here < after, open_end)[nearest]
        before = np.append(int(text[lo - 1]) if lo else -1, here[:-1])
        yield lo + np.flatnonzero(is_s & (before > here))
        right = is_s


def leftmost_s(text: np.ndarray, step: int, room: int) -> np.ndarray:
    """Leftmost-S positions in text order."""
    found = Shelf(np.int64, room)
    for block in _leftmost_s(text, step):
        found.append(block[::-1])
    back, out = found.array(), blank(found.size, np.int64, room)
    for at in blocks(found.size, step):
        out[found.size - at.stop : found.size - at.start] = back[at][::-1]
    found.close()
    return out


def order_in_memory(names: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Suffix order of a string of integers by prefix doubling; of ``enough`` first names only, if that is given."""
    rank = names.astype(np.int64)
    n, span = len(rank), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-span] = rank[span:] + 1 if span < n else 0
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        span *= 2
        if span >= (n if enough is None else min(n, enough)):
            return order


class _Out:
    """Single numbers to a shelf."""

    def __init__(self, room: int):
        self.shelf, self.fresh = Shelf(np.int64, room), []

    def add(self, i: int) -> None:
        self.fresh.append(i)
        if len(self.fresh) == 4096:
            self.close()

    def close(self) -> None:
        if self.fresh:
            self.shelf.append(np.array(self.fresh, np.int64))
            self.fresh = []

    def array(self) -> np.ndarray:
        self.close()
        return self.shelf.array()


def _numbers(values: np.ndarray) -> Iterator[int]:
    for at in blocks(len(values), 4096):
        yield from values[at].tolist()


def order_external(names: np.ndarray, limit: int) -> np.ndarray:
    """Suffix order of a string of integers by induced sorting with spilling heaps."""
    n, room = len(names), 8 * limit
    held = max(4, limit // 8)
    seeds = leftmost_s(names, max(limit, 16), room)
    value = lambda i: int(names[i])

    def induce(sorted_seeds: Iterator[int], keep: Callable[[int], None]) -> np.ndarray:
        """All suffixes in descending order; ``keep`` gets the leftmost-S ones as they come."""
        lows, out, tick = Heap(held), _Out(room), 0
        lows.push((value(n - 1), 0, n - 1))
        seed = next(sorted_seeds, None)
        while seed is not None or lows.peek() is not None:
            if lows.peek() is not None and (seed is None or lows.peek()[0] <= value(seed)):
                c, _, i = lows.pop()
                out.add(i)
                if i and value(i - 1) >= c:
                    tick += 1
                    lows.push((value(i - 1), tick, i - 1))
            else:
                i, seed = seed, next(sorted_seeds, None)
                tick += 1
                lows.push((value(i - 1), tick, i - 1))
        lows.close()
        highs, down = Heap(held), _Out(room)
        rest = _numbers(out.array()[::-1])
        low = next(rest, None)
        while low is not None or highs.peek() is not None:
            if highs.peek() is not None and (low is None or -highs.peek()[0] >= value(low)):
                c, _, i = highs.pop()
                c = -c
                down.add(i)
                if i and value(i - 1) > c:
                    keep(i)
                if i and value(i - 1) <= c:
                    tick += 1
                    highs.push((-value(i - 1), tick, i - 1))
            else:
                i, low = low, next(rest, None)
                down.add(i)
                if i and value(i - 1) < value(i):
                    tick += 1
                    highs.push((-value(i - 1), tick, i - 1))
        highs.close()
        out.shelf.close()
        return down.array()

    nothing = lambda i: None
    if len(seeds):
        first, kept = Heap(held), _Out(room)
        for i in _numbers(seeds):
            first.push((value(i), i, 0))

        def by_letter() -> Iterator[int]:
            while first.peek() is not None:
                yield first.pop()[1]

        induce(by_letter(), kept.add)
        first.close()
        order = kept.array()[::-1]
        reduced, label, last = blank(len(seeds), np.int64, room), -1, None
        for at in blocks(len(order), 4096):
            number = np.searchsorted(seeds, order[at])
            for k, i in zip(number.tolist(), order[at].tolist(), strict=True):
                until = int(seeds[k + 1]) if k + 1 < len(seeds) else n
                if last is None or not _same(names, i, until, *last):
                    label += 1
                reduced[k], last = label, (i, until)
        if label + 1 < len(seeds):
            inner = suffix_order(reduced, limit)
            again = _Out(room)
            for at in blocks(len(inner), 4096):
                again.close()
                again.shelf.append(seeds[inner[at]])
            order = again.array()
        return induce(_numbers(order), nothing)[::-1]
    return induce(iter(()), nothing)[::-1]


def _same(names: np.ndarray, i: int, to_i: int, j: int, to_j: int) -> bool:
    """Whether two leftmost-S substrings, ends included, are equal; one that reaches the end equals none."""
    if to_i - i != to_j - j or len(names) in (to_i, to_j):
        return False
    return all(np.array_equal(names[i + at.start : i + at.stop], names[j + at.start : j + at.stop]) for at in blocks(to_i - i + 1, 4096))


def suffix_order(names: np.ndarray, limit: int, enough: int | None = None) -> np.ndarray:
    return order_in_memory(names, enough) if len(names) <= limit * NAMES_PER_TUPLE else order_external(names, limit)


class Sorter:
    """Sorts all suffixes of a text of bytes whose last byte is 0.

    ``padded`` is the text with 8 more zero bytes behind it (``np.memmap`` will do).  With ``depth`` suffixes that
    agree on so many bytes may come in any order, one after another, and common prefixes stop there.
    """

    def __init__(self, padded: np.ndarray, limit: int = MEMORY_TUPLES, depth: int | None = None):
        self.depth = 255 if depth is None else depth
        # a leftmost-S substring has two bytes of its own at least
        self.enough = None if depth is None else depth // 2 + 1
        text = padded[:-8]
        self.text, self.limit, self.n = text, limit, len(text)
        self.room = limit * TUPLE.itemsize
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.counts = sum(np.bincount(text[at], minlength=256) for at in blocks(self.n, 1 << 18))
        self.letters = np.flatnonzero(self.counts)

    def _ahead(self, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pos), np.uint64)
        for k in range(_AHEAD):
            at = pos - 1 - k
            out |= np.where(at >= 0, self.text[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
        return out | np.uint64(_AHEAD << 56)

    def _tuples(self, pos: np.ndarray, lcp: np.ndarray | int) -> np.ndarray:
        out = np.empty(len(pos), TUPLE)
        out["pos"], out["prev"], out["lcp"] = pos, self._ahead(pos), lcp
        return out

    def _common(self, a: int, b: int) -> int:
        x, y = self.text[a : a + self.depth], self.text[b : b + self.depth]
        m = min(len(x), len(y))
        stop = np.flatnonzero((x[:m] != y[:m]) | (x[:m] == 0))
        return int(stop[0]) if len(stop) else m

    def _equal_bytes(self, a: np.ndarray, b: np.ndarray, through: bool) -> np.ndarray:
        """How many of the next 8 bytes of two places agree, up to the first 0 unless ``through``."""
        x, y = (np.ascontiguousarray(self.words[np.minimum(p, self.n)]).view("<u8")[:, 0] for p in (a, b))
        apart = x ^ y
        if not through:  # marks 0 bytes; a borrow can mark only what lies behind the first
            apart |= (x - np.uint64(0x0101010101010101)) & ~x & np.uint64(0x8080808080808080)
        return np.where(apart == 0, 8, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)

    def _common_many(self, a: np.ndarray, b: np.ndarray, stop: np.ndarray | int, through: bool = False) -> np.ndarray:
        """Common prefixes of suffix pairs, up to ``stop`` and the end of the text."""
        out = np.zeros(len(a), np.int64)
        stop = np.minimum(stop, self.n - np.maximum(a, b))
        live = np.arange(len(a))
        while len(live):
            more = self._equal_bytes(a[live] + out[live], b[live] + out[live], through)
            out[live] += more
            live = live[(more == 8) & (out[live] < stop[live])]
        return np.minimum(out, stop)

    def _spread(self, block: np.ndarray, take: np.ndarray, queues: dict[int, Queue], low: np.ndarray | None) -> None:
        """Appends the predecessors of the taken tuples to the queues of their bytes."""
        at = np.flatnonzero(take)
        prev = block["prev"][at]
        byte = (prev & np.uint64(0xFF)).astype(np.int64)
        pos = block["pos"][at] - 1
        left = (prev >> np.uint64(56)) - np.uint64(1)
        prev = ((prev & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | (left << np.uint64(56))
        if (dry := np.flatnonzero(left == 0)).size:
            prev[dry] = self._ahead(pos[dry])
        order = np.argsort(byte.astype(np.uint8), kind="stable")
        bounds = np.searchsorted(byte[order], np.arange(257))
        least = None
        if low is not None:
            wide = np.append(block["lcp"], np.uint8(255))
            least = block["lcp"].min() if len(block) else np.uint8(255)
        here = np.flatnonzero(np.diff(bounds))
        if least is not None:
            rest = np.ones(256, bool)
            rest[here] = False
            low[rest] = np.minimum(low[rest], least)
        for c in here.tolist():
            lo, hi = bounds[c], bounds[c + 1]
            mine = order[lo:hi]
            out = np.empty(hi - lo, TUPLE)
            out["pos"], out["prev"], out["lcp"] = pos[mine], prev[mine], 0
            if least is not None:
                spans = np.minimum.reduceat(wide, np.append(0, at[mine] + 1))
                spans[0] = min(spans[0], low[c])
                out["lcp"] = np.minimum(spans[:-1], self.depth - 1) + 1
                low[c] = spans[-1]
            queues[c].append(out)

    def _induce(self, seeds: Callable[[int], Iterator[np.ndarray]], with_lcp: bool, visit: Callable[[np.ndarray, np.ndarray], None], low_s: bool = False) -> None:
        """From seeds in order (blocks of tuples per first byte): all suffixes in descending order, handed to
        ``visit`` in blocks with the common prefix of each with the one before it in that order (zeros
        without ``with_lcp``).  ``low_s``: only leftmost-S suffixes are handed out."""
        spool = Spool(self.limit)
        lows = {int(c): Queue(spool) for c in self.letters}
        highs = {int(c): Queue(spool) for c in self.letters}
        low = np.full(256, 255, np.uint8) if with_lcp else None
        lows[int(self.text[-1])].append(self._tuples(np.array([self.n - 1]), 0))
        for c in map(int, self.letters):
            last = None
            for block in lows[c].drain():
                if low is not None and (last is None or c == 0):
                    block = block.copy()
                    block["lcp"][: 1 if c else None] = 0
                    if isinstance(lows[c].parts[lows[c].at], np.ndarray):
                        lows[c].parts[lows[c].at] = block
                last = int(block["pos"][-1])
                self._spread(block, ((block["prev"] & np.uint64(0xFF)) >= c) & (block["pos"] > 0), lows, low)
            fresh = True
            for block in seeds(c):
                if low is not None and (fresh or c == 0):
                    block["lcp"][: 1 if c else None] = 0 if last is None or c == 0 else self._common(last, int(block["pos"][0]))
                fresh = False
                self._spread(block, np.ones(len(block), bool), lows, low)
        if low is not None:
            low[:] = 255
        for c in map(int, self.letters[::-1]):
            last = None

            for block in highs[c].drain():
                block = block.copy()
                if last is None or c == 0:
                    block["lcp"][: 1 if c else None] = 0
                if low_s:
                    leftmost = block[((block["prev"] & np.uint64(0xFF)) > c) & (block["pos"] > 0)]
                    visit(leftmost["pos"], leftmost["lcp"])
                else:
                    visit(block["pos"], block["lcp"])
                last = int(block["pos"][-1])
                self._spread(block, ((block["prev"] & np.uint64(0xFF)) <= c) & (block["pos"] > 0), highs, low)
            carry, fresh = 0, True
            for part in lows[c].backwards():
                block = part.copy()
                after = int(part["lcp"][-1])
                block["lcp"][1:] = part["lcp"][:-1]
                block["lcp"][0] = (0 if last is None or low is None else self._common(last, int(part["pos"][0]))) if fresh else carry
                if c == 0:
                    block["lcp"] = 0
                carry, fresh = after, False
                if not low_s:
                    visit(block["pos"], block["lcp"])
                self._spread(block, ((block["prev"] & np.uint64(0xFF)) < c) & (block["pos"] > 0), highs, low)
        spool.close()

    def _by_letter(self, seeds: np.ndarray) -> tuple[Spool, Callable[[int], Iterator[np.ndarray]]]:
        """Seeds in text order, dealt to one queue per first byte."""
        spool = Spool(self.limit)
        queues = {int(c): Queue(spool) for c in self.letters}
        for at in blocks(len(seeds), self.step):
            pos = seeds[at]
            first = self.text[pos]
            order = np.argsort(first, kind="stable")
            tuples, bounds = self._tuples(pos[order], 0), np.searchsorted(first[order], np.arange(257))
            for c in np.flatnonzero(np.diff(bounds)).tolist():
                queues[c].append(tuples[bounds[c] : bounds[c + 1]])
        return spool, lambda c: queues[c].drain()

    def _in_order(self, order: np.ndarray) -> Callable[[int], Iterator[np.ndarray]]:
        """Seeds in suffix order, with the common prefix of each with the one before it."""
        counts = np.zeros(257, np.int64)
        for at in blocks(len(order), self.step):
            counts[1:] += np.bincount(self.text[order[at]], minlength=256)
        bounds = np.cumsum(counts)

        def of(c: int) -> Iterator[np.ndarray]:
            for at in blocks(int(bounds[c + 1] - bounds[c]), self.step):
                lo, hi = bounds[c] + at.start, bounds[c] + at.stop
                pos = order[lo:hi]
                lcp = np.zeros(hi - lo, np.uint8)
                skip = int(lo == 0)
                lcp[skip:] = self._common_many(order[lo - 1 + skip : hi - 1], pos[skip:], self.depth)
                yield self._tuples(pos, lcp)

        return of

    def _name(self, seeds: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of the leftmost-S substrings in text order, and how many there are."""
        names, label = blank(len(seeds), np.int64, self.room), -1
        last_pos, last_length = np.zeros(1, np.int64), np.full(1, -1)
        for at in blocks(len(order), self.step):
            pos = order[at]
            number = np.searchsorted(seeds, pos)
            after = np.where(number + 1 < len(seeds), seeds[np.minimum(number + 1, len(seeds) - 1)], self.n)
            length = after + 1 - pos
            all_pos, all_length = np.append(last_pos, pos), np.append(last_length, length)
            same = all_length[1:] == all_length[:-1]
            check = np.flatnonzero(same)
            same[check] = self._common_many(all_pos[check], all_pos[check + 1], length[check], True) >= length[check]
            labels = label + np.cumsum(~same)
            names[number] = labels
            label, last_pos, last_length = int(labels[-1]), pos[-1:], length[-1:]
        return names, label + 1

    @property
    def step(self) -> int:
        return max(2, min(self.limit // 4, 1 << 18))

    def run(self, visit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        seeds = leftmost_s(self.text, max(16, min(2 * self.limit, 1 << 22)), self.room)
        order = seeds
        if len(seeds):
            found = Shelf(np.int64, self.room)
            spool, dealt = self._by_letter(seeds)
            self._induce(dealt, False, lambda pos, _: found.append(pos), low_s=True)
            spool.close()
            order = found.array()[::-1]
            names, labels = self._name(seeds, order)
            if labels < len(seeds):
                inner, sorted_seeds = suffix_order(names, self.limit, self.enough), Shelf(np.int64, self.room)
                for at in blocks(len(inner), self.step):
                    sorted_seeds.append(seeds[inner[at]])
                order = sorted_seeds.array()
        self._induce(self._in_order(order), True, visit)
