"""Vectorised text kernel shared by the operators: words and rolling hashes over packed bytes.

A batch of texts is one ``uint8`` array plus offsets.  Words are byte runs of a class table, so no
Python object is made per word.  Hashes are polynomials modulo 2**64 taken from prefix sums; they
depend on content only, never on the batch that a text happens to be in.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 2_000

_rng = np.random.Generator(np.random.PCG64(20240917))
_TABLE = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, size=4)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def small_batches(spark) -> None:
    """Bounds Arrow batches by ``BATCH_ROWS`` rows, so that a Python worker holds few texts at once.

    A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives free memory back to the system: workers outlive their tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function``, with memory released at the end of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def space_class() -> np.ndarray:
    """Words are runs of anything but space and ``\\x09-\\x0D``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_class() -> np.ndarray:
    """Words are runs of ASCII letters, ASCII digits and all non-ASCII bytes."""
    table = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[lo : hi + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64 constants); the input is not changed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[which] = (out[0], out[1])
        if size > CHUNK_BYTES * 4:  # one outsized text must not pin its tables
            del _powers[which]
    return have


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every range; equal contents give equal hashes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(values) + 1, which)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return ranges_hash(_TABLE[which & 1][data], starts, ends, which)


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word index of every text (one more at the end)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of the column with their bytes and offsets, about ``limit`` bytes at a time."""
    data, offsets = packed(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def window_minimum(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest hash in each window of ``width``; compares the upper 33 bits.

    Entry ``i`` is for ``hashes[i:i+width]``; there are ``len(hashes) - width + 1`` entries.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 31) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    return (best[:n] & low).astype(np.int64)


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``data``; ``ends`` are their running ends."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
