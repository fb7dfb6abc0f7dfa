"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

1. Every text becomes the set of its distinct word shingles; equal sets form one class.
2. Classes meet by their prefixes: of a set in one fixed global order, linked sets share one of the
   first ``size - T + 1`` shingles.  The order puts shingles that many documents share last, so a
   common line or passage brings nobody together.  Which shingles count as common changes the work
   only, never the result.
   Of sets that meet at a shingle those go at once that come too late in their prefixes: what follows
   it there is not enough for a link (positional bound).
3. Sets that meet by chance part again by their parity bitmaps, whose distance is a lower bound of the
   number of shingles that only one of two sets has.  What stays together forms clusters.
4. In a cluster each set is a query against the inverted lists of the others: short lists are counted,
   the longest are set aside and probed by binary search for candidates with enough occurrences, or
   counted as well where most are candidates (``divide_skip``).  Sets that found a partner are not
   searched for, which is exact for components and spares a group of thousands of linked copies its
   millions of pairs.
5. Links give components; the smallest id of a component names it.

A cluster with more than ``BLOCK_SHINGLES`` shingles is dealt to tasks by blocks, each with a few sets that all
blocks get (pivots), which joins what the blocks have in common.  Sets that are still outside the cluster's
largest component then search in every block, passing over what is joined already.  Two sets inside that
component need no search, so all links that matter are found.

Defined results
---------------
* null or empty text, or no words: 0 shingles, linked with nothing, component is the own id;
* fewer words than a shingle has: the whole sequence is the only shingle;
* very long texts are used whole; shingle hashes have 64 bits;
* ties and repeated rows: rows with equal sets are linked, so they get one component;
* null ids: the row is returned with its size and a null component, and links nothing;
* an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as R
from . import _text as X
from ._graph import components, stored, written

#: Shingles found in this many documents of one Arrow batch are ordered last; at most so many are.
COMMON_IN_BATCH, COMMON_KEPT = 4, 200_000
#: Neighbours of one shingle among which a partner is looked for, and bits of its place as a fraction of its set's size.
NEAR, PLACE_BITS = 16, 8
#: Shingles of a cluster that one task takes, and sets of a larger one that all its tasks take.
BLOCK_SHINGLES, PIVOTS = 300_000, 8
#: Least and most places (bits) of the table that tells which texts a cluster may need, and places per text.
SLOTS, SLOTS_PER_TEXT = (1 << 20, 1 << 28), 16
#: Weight of a step in a short list against a binary probe in the choice of how many lists to set aside.
PROBE_WEIGHT = 0.0085
#: Cost of probing a list: at all, and for each member, in members counted; and of sorting one against a counter.
PROBE_COST, SORT_WEIGHT = (2_000, 20), 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    starts, ends, first = X.word_bounds(X.LOWER[data], offsets, X.space_class())
    words = X.bytes_hash(X.LOWER[data], starts, ends)
    at = np.arange(max(0, len(words) - n + 1))
    full = X.ranges_hash(words, at, at + n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = dict(zip(short.tolist(), X.ranges_hash(words, first[short], first[short + 1]), strict=True))
    for k, (a, c) in enumerate(zip(first[:-1].tolist(), count.tolist(), strict=True)):
        if c >= n:
            s = np.sort(full[a : a + c - n + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        else:
            yield np.array([whole[k]], np.uint64) if c else np.zeros(0, np.uint64)


def _common(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, data, offsets in X.chunks(batch.column(0)) for s in shingle_sets(data, offsets, n)]
            if not sets:
                continue
            every = np.sort(np.concatenate(sets))
            head = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
            size = np.diff(np.append(head, len(every)))
            many = size >= COMMON_IN_BATCH
            yield pa.RecordBatch.from_arrays([pa.array(every[head[many]].view(np.int64)), pa.array(size[many].astype(np.int64))], names=["shingle", "n"])

    return count


def _sketch(n: int, low: int, high: int, common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, tag, size, sig, prefix, bits) of every text; ``common`` is sorted from common to rare."""
    by_hash = np.argsort(common)
    ordered = common[by_hash]
    per_shingle = bits_per_shingle(low, high)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sig, lengths, prefixes, bits = [], [], [], [], []
            for _, _, data, offsets in X.chunks(batch.column(2)):
                sets = list(shingle_sets(data, offsets, n))
                bounds = np.append(0, np.cumsum([len(s) for s in sets]))
                flat = np.concatenate(sets)
                sig.append(X.ranges_hash(flat, bounds[:-1], bounds[1:], 1))
                if len(ordered):
                    found = np.minimum(np.searchsorted(ordered, flat), len(ordered) - 1)
                    # rare ones first by hash, then common ones from rare to common
                    place = np.where(ordered[found] == flat, len(common) - by_hash[found], 0)
                else:
                    place = np.zeros(len(flat), np.int64)
                for s, a, b in zip(sets, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    k = len(s) - -(-low * len(s) // high) + 1 if len(s) else 0
                    p = place[a:b]
                    prefixes.append(s[np.argsort(p, kind="stable")[:k]] if p.any() else s[:k])
                    lengths.append(k)
                    bits.append(parity(s, per_shingle))
                    size.append(len(s))
            if not size:
                continue
            flat = pa.array(np.concatenate(prefixes).view(np.int64))
            column = pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(np.concatenate(sig).view(np.int64)), column, pa.array(bits, pa.binary())], names=["id", "tag", "size", "sig", "prefix", "bits"])

    return sketch


def bits_per_shingle(low: int, high: int) -> int:
    """So many that the bitmaps of sets without a common shingle lie farther apart than a leader reaches.

    With ``b`` bits for sets of size ``s`` they differ in about ``b / 2 * (1 - exp(-4 * s / b))`` bits, and
    a leader reaches ``2 * (high / low - 1) * s``.
    """
    reach = 2 * (high / low - 1)
    return next((m for m in (1, 2, 4) if m / 2 * (1 - math.exp(-4 / m)) > 1.15 * reach), 8)


def parity(s: np.ndarray, per_shingle: int) -> bytes:
    """Bit ``h mod b`` is the parity of the hashes ``h`` that fall on it; ``b`` is a power of two of at
    least so many bits per shingle.  The upper half folded onto the lower gives the bitmap for ``b / 2``."""
    b = 1 << max(6, (max(1, len(s) * per_shingle) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(bool), bitorder="little").tobytes()


def partnered(shingle: np.ndarray, size: np.ndarray, place: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which rows, in order of shingle and size, may have this shingle as the first one common with a linked set.

    Linked sets have ``low * (size + size) / (low + high)`` shingles in common, all of them at or after the first
    one's ``place`` in either.  A row with ``NEAR`` neighbours or more to one side is not judged and stays.
    """
    equal = shingle[1:] == shingle[:-1]
    several = np.flatnonzero(np.append(equal, False) | np.append(False, equal)) if len(shingle) else np.zeros(0, np.int64)
    shingle, size, rest = shingle[several], size[several], (low + high) * (size - place)[several]
    keep = np.zeros(len(several), bool)
    for d in range(1, min(NEAR, len(several) - 1) + 1):
        small, large = size[:-d], size[d:]
        fits = (shingle[:-d] == shingle[d:]) & (high * small >= low * large)
        if not fits.any():
            break
        if d < NEAR:
            fits &= np.minimum(rest[:-d], rest[d:]) >= low * (small + large)
        keep[:-d] |= fits
        keep[d:] |= fits
    out = np.zeros(len(equal) + 1, bool)
    out[several[keep]] = True
    return out


def _postings(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of (shingle, size and place, node) rows in order those that are partnered: shingle, size, node."""
    rows, done = [np.zeros(0, np.int64)] * 3, 0  # rows from ``done`` on are not judged yet
    for batch in chain(batches, [None]):
        if batch is not None:
            rows = [np.append(x, batch.column(k).to_numpy(zero_copy_only=False)) for k, x in enumerate(rows)]
        shingle, packed, node = rows
        size = packed >> PLACE_BITS
        place = -(-(packed & ((1 << PLACE_BITS) - 1)) * size >> PLACE_BITS)  # at most what it was before it was rounded
        keep = partnered(shingle, size, place, low, high)
        until = len(node) if batch is None else max(done, len(node) - NEAR)
        now = done + np.flatnonzero(keep[done:until])
        yield shingle[now], size[now], node[now]
        start = max(0, until - NEAR)
        rows, done = [x[start:] for x in rows], until - start


def _meetings(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (shingle, size and place, node) rows in order: (group, size, node) of groups of several nodes.

    A group has one shingle and sizes without a gap that no linked pair could bridge.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # shingle, size, node, group, already returned
        for shingle, size, node in _postings(batches, low, high):
            if len(node) == 0:
                continue
            if last is not None:
                shingle, size, node = (np.append(x, y) for x, y in zip(last[:3], (shingle, size, node), strict=True))
            apart = np.append(True, (shingle[1:] != shingle[:-1]) | (high * size[:-1] < low * size[1:]))
            head = np.flatnonzero(apart)[np.cumsum(apart) - 1]
            group = X.mix(shingle[head].view(np.uint64) ^ X.mix(node[head].view(np.uint64))).view(np.int64)
            if last is not None:
                group[head == 0] = last[3]
            # groups that lie whole in this batch are named by their members: equal ones become one
            heads = np.flatnonzero(apart)
            size_of = np.diff(np.append(heads, len(node)))
            named = X.mix(np.add.reduceat(X.mix(node.view(np.uint64)), heads) + size_of.astype(np.uint64)).view(np.int64)
            whole = np.ones(len(heads), bool)
            whole[-1] = False
            whole[0] &= last is None
            which = np.cumsum(apart) - 1
            group = np.where(whole[which], named[which], group)
            keep = ~apart | np.append(~apart[1:], False)
            done = bool(keep[-1])
            if last is not None and last[4]:
                keep[0] = False
            last = (shingle[-1], size[-1], node[-1], group[-1], done or (len(node) == 1 and last is not None and last[4]))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (group, size, node)], names=["group", "size", "node"])

    return meet


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


class Leaders:
    """Sets of one group, in ascending size, that stand for the sets around them.

    With ``r = high / low - 1``, a set is *tight* to a leader if its bitmap is within ``r`` times the
    leader's size and its size within ``high / low`` times.  A set that links with a tight one is then
    within ``r`` times both sizes of the leader (triangle inequality), and no more than
    ``(high / low) ** 2`` times as large; older leaders need no comparison.
    """

    def __init__(self, low: int, high: int):
        self.r, self.ratio = (high - low) / low, high / low
        self.nodes: list[int] = []
        self.sizes: list[int] = []
        self.bits: list[np.ndarray] = []
        self.from_, self.matrix = 0, np.zeros((0, 1), np.uint64)

    def _fit(self) -> None:
        """Matrix of the live leaders at the width of the narrowest, with room for more."""
        live = self.bits[self.from_ :]
        self.matrix = np.zeros((2 * len(live) + 4, len(live[0]) if live else 1), np.uint64)
        for k, b in enumerate(live):
            self.matrix[k] = fold(b, self.matrix.shape[1])

    def place(self, size: int, node: int, bits: np.ndarray) -> list[int]:
        """Leaders that the set may be linked with, through whatever sets; the set leads if it is tight to none."""
        if self.from_ < len(self.sizes) and self.sizes[self.from_] * self.ratio**2 < size - 1e-6:
            while self.from_ < len(self.sizes) and self.sizes[self.from_] * self.ratio**2 < size - 1e-6:
                self.from_ += 1
            self._fit()
        live = len(self.sizes) - self.from_
        found, tight = [], False
        if live:
            sizes = np.array(self.sizes[self.from_ :])
            apart = np.bitwise_count(self.matrix[:live] ^ fold(bits, self.matrix.shape[1])).sum(1)
            near = np.flatnonzero(apart <= self.r * (sizes + size) + 1e-6)
            found = [self.nodes[self.from_ + k] for k in near.tolist()]
            tight = bool(((apart[near] <= self.r * sizes[near]) & (size <= self.ratio * sizes[near])).any())
        if not tight:
            self.nodes.append(node)
            self.sizes.append(size)
            self.bits.append(bits)
            if live == 0 or live == len(self.matrix):
                self._fit()
            else:
                self.matrix[live] = fold(bits, self.matrix.shape[1])
        return found


class Connected:
    """Which nodes a task has connected already; forgets everything at ``limit`` nodes, which only costs edges."""

    def __init__(self, limit: int = 300_000):
        self.up: dict[int, int] = {}
        self.limit = limit

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """True if the two were not connected before."""
        if len(self.up) > self.limit:
            self.up.clear()
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _near(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (group, size, node, bits) rows in order: edges that connect all nodes that may be linked or
    linked through others.  A task returns a forest, so fewer edges than it has rows."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders, connected = None, Leaders(low, high), Connected()
        for batch in batches:
            edges = []
            for group, size, node, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if group != key:
                    key, leaders = group, Leaders(low, high)
                edges += [(leader, node) for leader in leaders.place(size, node, np.frombuffer(raw, np.uint64)) if connected.join(leader, node)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return near


def occurrences(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending members of the lists, and in how many lists each occurs."""
    every = np.concatenate(lists)
    if len(every) * SORT_WEIGHT < every.max():  # few of many members
        every.sort()
        head = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        return every[head], np.diff(np.append(head, len(every)))
    n = np.bincount(every)
    members = np.flatnonzero(n)
    return members, n[members]


def divide_skip(lists: Sequence[Sequence[int] | np.ndarray], needed: int, skip: Callable[[int], bool]) -> Iterator[tuple[int, int]]:
    """Members that occur in at least ``needed`` of the sorted lists, with their number of occurrences.

    The longest lists are set aside; the others are counted, and members that occur there often enough are
    probed for in the long ones by binary search, or counted there too where so many are left that this is
    less work.  Members for which ``skip`` holds when their turn comes are passed over.
    """
    lists = sorted((np.asarray(x) for x in lists if len(x)), key=len)
    if len(lists) < needed:
        return
    longest = max(2, len(lists[-1]))
    aside = min(needed - 1, int(needed / (PROBE_WEIGHT * math.log2(longest) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    members, n = occurrences(short)
    left = n + aside >= needed
    members, n = members[left], n[left]
    if aside and len(members) and aside * (PROBE_COST[0] + PROBE_COST[1] * len(members)) > sum(map(len, long)):
        more = np.bincount(np.concatenate(long), minlength=int(members[-1]) + 1)
        n = n + more[members]
    else:
        for rest, one in zip(range(aside, 0, -1), long, strict=True):
            left = n + rest >= needed
            members, n = members[left], n[left]
            if len(members) == 0:
                return
            n = n + (one[np.minimum(np.searchsorted(one, members), len(one) - 1)] == members)
    left = n >= needed
    for member, count in zip(members[left].tolist(), n[left].tolist(), strict=True):
        if not skip(member):
            yield member, count


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_cluster(sets: list[np.ndarray], low: int, high: int) -> list[int]:
    """Component (smallest index) of every set; sets link when high * |both| >= low * |either|.

    First every set searches among the sets that found no partner before it; what it finds settles
    most memberships.  Then the sets of all components but the largest search among the sets of
    larger components, passing over what is joined already.
    """
    n = len(sets)
    forest = Forest(n)
    sizes = [len(s) for s in sets]
    bounds = np.append(0, np.cumsum(sizes))
    _, number, width = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = [number[a:b][width[number[a:b]] > 1] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    # the list of a shingle: places in ``inside``, in a stretch with room for all sets that have it
    start, filled = np.cumsum(width) - width, np.zeros(len(width), np.int64)
    lists = np.zeros(len(number), np.int64)
    inside: list[int] = []

    def insert(i: int) -> None:
        k = shared[i]
        lists[start[k] + filled[k]] = len(inside)
        filled[k] += 1
        inside.append(i)

    def search(i: int) -> bool:
        found = False
        k = shared[i][filled[shared[i]] > 0]
        among = [lists[a:b] for a, b in zip(start[k].tolist(), (start[k] + filled[k]).tolist(), strict=True)]
        for p, both in divide_skip(among, -(-low * sizes[i] // high), lambda p: forest.find(inside[p]) == forest.find(i)):
            if high * both >= low * (sizes[i] + sizes[inside[p]] - both):
                forest.join(i, inside[p])
                found = True
        return found

    for i in sorted(range(n), key=sizes.__getitem__):
        if not search(i):
            insert(i)
    root = [forest.find(i) for i in range(n)]
    if len(inside) == n or len(set(root)) == 1:
        return root
    members = Counter(root)
    filled[:] = 0
    inside.clear()
    settled = sorted(range(n), key=lambda i: (-members[root[i]], root[i], i))
    for r, group in groupby(settled, key=root.__getitem__):
        group = list(group)
        if inside:
            for i in group:
                search(i)
        for i in group:
            insert(i)
    return [forest.find(i) for i in range(n)]


def link_across(inside: list[np.ndarray], queries: list[np.ndarray], labels: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Links (place in ``queries``, place in ``inside``) that join different components.  ``labels`` names the
    component of every set, first of those inside, then of the queries."""
    seen: dict[int, int] = {}
    forest = Forest(len(labels))
    for i, label in enumerate(labels):
        forest.join(i, seen.setdefault(label, i))
    sizes = [len(s) for s in inside]
    shingles, number = np.unique(np.concatenate(inside), return_inverse=True)
    owner = np.repeat(np.arange(len(inside)), sizes)
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(len(shingles) + 1))
    members = owner[order]
    out = []
    for j, q in enumerate(queries):
        at = np.minimum(np.searchsorted(shingles, q), len(shingles) - 1)
        at = at[shingles[at] == q]
        lists = [members[a:b] for a, b in zip(starts[at].tolist(), starts[at + 1].tolist(), strict=True)]
        me = len(inside) + j
        for i, both in divide_skip(lists, -(-low * len(q) // high), lambda i: forest.find(i) == forest.find(me)):
            if high * both >= low * (len(q) + sizes[i] - both):
                forest.join(i, me)
                out.append((j, i))
    return out


Pairs = Callable[[list[int], list[int], list[int], list[np.ndarray]], list[tuple[int, int]]]


def _search(n: int, solve: Pairs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (cluster, task, role, label, node, deflated text) rows with whole tasks in order: links between nodes."""

    def links(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        edges = solve(*(list(x) for x in zip(*rows, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for lo, hi, data, offsets in R.unsqueezed(batch.column(5)):
                cluster, task, role, label, node = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(5))
                for k, *row in zip(zip(cluster, task, strict=True), role, label, node, shingle_sets(data, offsets, n), strict=True):
                    if k != key:
                        if len(rows) > 1:
                            yield links(rows)
                        key, rows = k, []
                    rows.append(tuple(row))
        if len(rows) > 1:
            yield links(rows)

    return search


def _within(low: int, high: int) -> Pairs:
    def solve(roles: list[int], labels: list[int], nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(nodes[r], nodes[i]) for i, r in enumerate(link_cluster(sets, low, high)) if r != i]

    return solve


def _across(low: int, high: int) -> Pairs:
    def solve(roles: list[int], labels: list[int], nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        first, more = ([k for k, r in enumerate(roles) if r == role] for role in (0, 1))
        if not first or not more:
            return []
        found = link_across([sets[k] for k in first], [sets[k] for k in more], [labels[k] for k in first + more], low, high)
        return [(nodes[more[j]], nodes[first[i]]) for j, i in found]

    return solve


def _bits(members: DataFrame) -> np.ndarray:
    """A bit table of the members' ids: bounded, and built by aggregation (4 KB rows)."""
    n = members.count()
    slots = min(max(1 << (n * SLOTS_PER_TEXT).bit_length(), SLOTS[0]), SLOTS[1])
    slot = F.pmod(F.xxhash64("id"), F.lit(slots)) + 1
    parts = members.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    table = np.zeros(slots // 8, np.uint8)
    for row in parts.toLocalIterator():  # slots / 32,768 rows of 4 KB at most
        at = (row["bucket"] - 1) * 4_096
        table[at : at + 4_096] = np.frombuffer(row["bits"], np.uint8)
    return table


def _grouped(search: DataFrame, shingle: int, threshold: tuple[int, int]) -> tuple[DataFrame, Callable, str]:
    """(id, tag, n_shingles, first) of the rows to search, first being the least (id, tag) of the component;
    and the function that made the sets, with its schema."""
    low, high = threshold
    spark = search.sparkSession
    counted = search.select("text").mapInArrow(X.tidy(_common(shingle)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(COMMON_KEPT).select("shingle").toPandas()["shingle"].to_numpy()
    common = spark.sparkContext.broadcast(top.view(np.uint64))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sketch(shingle, low, high, common.value)(batches)

    shape = "id long, tag long, size long, sig long, prefix array<long>, bits binary"
    sketches = stored(search.mapInArrow(X.tidy(sketch), shape))
    filled = sketches.filter("size > 0")
    nodes = filled.groupBy("sig").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    postings = nodes.select("size", F.col("sig").alias("node"), F.posexplode("prefix").alias("place", "shingle"))
    postings = postings.selectExpr("shingle", f"shiftleft(size, {PLACE_BITS}) | shiftleft(cast(place as long), {PLACE_BITS}) div size as packed", "node")
    postings = postings.repartition("shingle").sortWithinPartitions("shingle", "packed", "node")
    met = postings.mapInArrow(X.tidy(_meetings(low, high)), "group long, size long, node long")
    met = met.groupBy("group", "node").agg(F.first("size").alias("size"))
    bitmaps = filled.groupBy("sig").agg(F.first("bits").alias("bits"))
    met = met.join(bitmaps, met.node == bitmaps.sig).select("group", "size", "node", "bits")
    met = met.repartition("group").sortWithinPartitions("group", "size", "node")
    clusters = stored(components(met.mapInArrow(X.tidy(_near(low, high)), "a long, b long")))

    members = filled.groupBy("sig").agg(F.min(F.struct("id", "tag")).alias("rep"), F.first("size").alias("size"))
    members = members.join(clusters, members.sig == clusters.node).select("rep.id", "rep.tag", "sig", "size", "component")
    members = written(members)
    blocks = members.groupBy("component").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    # a bit table lets few other texts pass, so that not all of them are shuffled
    table = spark.sparkContext.broadcast(_bits(members))
    slots = len(table.value) * 8

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(table.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))

    few = search.select("id", "tag", "text", F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot"))
    few = R.squeezed(few.mapInArrow(X.tidy(passing), "id long, tag long, text string, slot long").drop("slot"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(dealt: DataFrame, solve: Pairs) -> DataFrame:
        """Edges of the tasks (component, task, role, label, sig, size)."""
        work = few.join(dealt, ["id", "tag"]).select("component", "task", "role", "label", "sig", "size", "text")
        work = work.repartition(tasks, "component", "task").sortWithinPartitions("component", "task", "role", "size", "sig")
        return work.select("component", "task", "role", "label", "sig", "text").mapInArrow(X.tidy(_search(shingle, solve)), "a long, b long")

    def to_all_blocks(rows: DataFrame) -> DataFrame:
        return rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    columns = ["id", "tag", "component", "task", "role", "label", "sig", "size"]
    own = placed.withColumns({"task": F.col("block"), "role": F.lit(0), "label": F.col("sig")}).select(*columns)
    large = placed.filter("blocks > 1")
    split = large.limit(1).count() > 0
    dealt = own
    if split:
        some = large.groupBy("component", F.pmod(F.xxhash64("sig", F.lit(1)), F.lit(PIVOTS)).alias("p")).agg(F.min("sig").alias("sig")).select("sig")
        pivots = to_all_blocks(large.join(some, "sig", "left_semi")).filter("task <> block").withColumns({"role": F.lit(0), "label": F.col("sig")})
        dealt = own.unionByName(pivots.select(*columns))
    links = written(components(searched(dealt, _within(low, high))))
    if split:
        labelled = large.join(links.select(F.col("node").alias("sig"), F.col("component").alias("label")), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        labelled = written(labelled)
        main = labelled.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        outside = written(labelled.join(main, "component").filter("label <> main"))
        if outside.limit(1).count() > 0:
            here = labelled.join(outside.select("component").distinct(), "component", "left_semi").withColumns({"task": F.col("block"), "role": F.lit(0)})
            asking = to_all_blocks(outside).withColumn("role", F.lit(1))
            more = searched(here.select(*columns).unionByName(asking.select(*columns)), _across(low, high))
            links = written(components(links.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    # the first of a group for every set that shares it with others, as tables: a join of two of them splits large groups
    reps = members.select(F.col("sig").alias("node"), F.struct("id", "tag").alias("rep"))
    least = written(links.join(reps, "node").groupBy("component").agg(F.min("rep").alias("least")))
    leads = links.join(least, "component").select(F.col("node").alias("sig"), "least")
    same = filled.groupBy("sig").agg(F.min(F.struct("id", "tag")).alias("rep"), F.count("*").alias("n"))
    firsts = written(same.join(leads, "sig", "left").filter("n > 1 or least is not null").select("sig", F.coalesce("least", "rep").alias("least")))
    own = F.struct("id", "tag")
    grouped = sketches.select("id", "tag", "size", "sig").join(firsts, "sig", "left")
    grouped = grouped.select("id", "tag", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("least", own)).otherwise(own).alias("first"))
    return grouped, sketch, shape


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Near-duplicate components: doc_id, n_shingles, component_id (smallest id, null for null ids).

    ``threshold`` (a, b) links sets when b * |intersection| >= a * |union|.
    """
    rows, search, _ = R.keyed(docs, id_col, text_col)
    grouped, sketch, shape = _grouped(search, shingle, threshold)
    known = rows.filter("id is not null").select("id", "tag").join(grouped, ["id", "tag"]).select(F.col("id").alias("doc_id"), "n_shingles", F.col("first.id").alias("component_id"))
    unnamed = rows.filter("id is null").mapInArrow(X.tidy(sketch), shape)
    return known.unionByName(unnamed.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs``, with all columns, without the documents of a component but its first.

    The first is the one with the smallest id, of equal ids the one with the smallest text hash.  Rows with a
    null id stay; repeated rows (same id and text) are one document.
    """
    rows, search, _ = R.keyed(docs, id_col, text_col, carry=True)
    grouped, _, _ = _grouped(search, shingle, threshold)
    gone = grouped.filter(F.col("first") != F.struct("id", "tag")).select("id", "tag")
    kept = rows.join(gone, ["id", "tag"], "left_anti")
    text = F.when(~F.col("rest.null"), F.col("text"))
    return kept.select(*[text.alias(c) if c == text_col else F.col("rest.row").getField(c).alias(c) for c in docs.columns])
