"""Substring dedup by seed and extend, on words.

Seeds are winnowed anchors of 18 words: any window of 50 words contains one, chosen by content
alone.  Occurrences of a seed meet by a shuffle on its hash and are extended both ways together, word
by word: occurrences that read the same words so far form a class, which splits where words differ, and
one that is left alone stops.  A window repeats where its seed's extensions to the left and to the
right, as long as the window needs, share their classes with an occurrence in an earlier document.
Neighbouring repeated windows join into maximal repeats, which are at least one window long by
construction.

Defined results
---------------
* null or empty text: no words, nothing removed; fewer words than a window: nothing removed;
* very long texts are read whole, in Arrow batches; word hashes have 64 bits, identities of runs 128;
* ties: a window is removed only if its words start in a document with a *smaller* id, so
  repetitions inside one document, and documents with equal ids, do not remove each other;
* repeated rows (same id and text) count as one document and get equal results;
* null ids: the row is returned unchanged and covers nothing;
* an empty table gives an empty table; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from . import _text as X

SEED_WORDS = 18
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"


def _words_of(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a shard's texts, and the first word of each (one more at the end)."""
    table = X.space_class()
    table[0xFF] = False  # what ends a text, one down
    values, first, lo = [], [np.zeros(1, np.int64)], 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + X.CHUNK_BYTES, "right")) - 1)
        data = text[bounds[lo] : bounds[hi]] - np.uint8(1)
        starts, ends, at = X.word_bounds(data, bounds[lo : hi + 1] - bounds[lo], table)
        values.append(X.bytes_hash(data, starts, ends))
        first.append(first[-1][-1] + at[1:])
        lo = hi
    return np.concatenate(values), np.concatenate(first)


def _refined(classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of the classes of (class, word)."""
    order = np.lexsort((words, classes))
    c, w = classes[order], words[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(False, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))[: len(order)])
    return out


def _extended(values: np.ndarray, seed: np.ndarray, room: np.ndarray, group: np.ndarray, kept: np.ndarray, step: int, most: int) -> list[np.ndarray]:
    """Class of every occurrence after 0, 1, ... ``most`` words of extension in one direction, -1 where it
    has ended: its text is over, or it is alone in its class and no copy hangs on it (``kept``)."""
    out = [group]
    live, classes = np.arange(len(seed)), group
    for k in range(1, most + 1):
        further = room[live] >= k
        live, classes = live[further], classes[further]
        classes = _refined(classes, values[seed[live] + step * k])
        stays = (np.bincount(classes, minlength=1)[classes] > 1) | kept[live]
        live, classes = live[stays], classes[stays]
        now = np.full(len(seed), -1)
        now[live] = classes
        out.append(now)
    return out


def _judge(window: int) -> R.Judge:
    """Extends all occurrences of every seed together, word by word to the left and to the right.

    A window with ``k`` words on the left of its seed repeats if another occurrence, in a document with a
    smaller id, shares the class after ``k`` words to the left and that after the rest to the right.
    """
    rest = window - SEED_WORDS

    def judge(shard: R.Shard) -> tuple[np.ndarray, np.ndarray]:
        text, keys = shard.text.array(), np.array(shard.keys.array())
        values, first = _words_of(text, np.append(keys["base"], len(text)))
        at = np.arange(max(0, len(values) - SEED_WORDS + 1))
        grams = X.ranges_hash(values, at, at + SEED_WORDS)
        seed = X.window_minimum(grams, rest + 1)[first[:-1]]
        n, many = keys["n"].astype(np.int64), keys["many"] > 0
        before = seed - first[:-1]
        left = _extended(values, seed, before, keys["group"], many, -1, rest)
        right = _extended(values, seed + SEED_WORDS - 1, first[1:] - seed - SEED_WORDS, keys["group"], many, 1, rest)
        base = np.cumsum(n) - n
        verdict = np.zeros(int(n.sum()), np.uint8)
        for k in range(rest + 1):
            who = np.flatnonzero((left[k] >= 0) & (right[rest - k] >= 0) & (before >= k) & (before - k < n))
            a, b, ids = left[k][who], right[rest - k][who], keys["id"][who]
            order = np.lexsort((ids, b, a))
            a, b, ids, who = a[order], b[order], ids[order], who[order]
            head = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            own = ids > ids[head][np.cumsum(head) - 1] if len(a) else head
            verdict[base[who] + before[who] - k] = own + 2 * many[who]
        return base, verdict

    return judge


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        row, start, end = R.batch_spans(batch)
        for lo, hi, data, offsets in R.unsqueezed(batch.column(2)):
            a, b, first = X.word_bounds(data, offsets, X.space_class())
            mine = (row >= lo) & (row < hi)
            r, s, e = row[mine] - lo, start[mine], end[mine]
            mark = np.zeros(len(a) + 1, np.int64)
            np.add.at(mark, first[r] + s, 1)
            np.add.at(mark, first[r] + e, -1)
            kept = np.cumsum(mark)[:-1] == 0
            total = np.append(0, np.cumsum(kept))
            words, left = np.diff(first), total[first[1:]] - total[first[:-1]]
            # kept words, one space after each, but none after a document's last
            a, b = a[kept], b[kept]
            size = b - a + 1
            ends = np.cumsum(size)
            out = np.full(int(size.sum()), 0x20, np.uint8)
            out[X.gather_ranges(ends - size, size - 1)] = data[X.gather_ranges(a, size - 1)]
            bound = np.append(0, ends)[total[first]]
            texts = pa.array([out[x : y - 1 if y > x else y].tobytes() for x, y in zip(bound[:-1], bound[1:], strict=True)], pa.binary()).cast(pa.string())
            spans = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(r, minlength=hi - lo))).astype(np.int32), pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["start", "end"])).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words, pa.int64()), pa.array(words - left, pa.int64()), spans, texts], names=["doc_id", "n_words", "n_removed", "spans", "text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Removes words of windows that also start in a document with a smaller id.

    Returns doc_id, n_words, n_removed, spans (removed word ranges, end exclusive, sorted and
    disjoint) and text (kept words joined by one space).
    """
    if window < SEED_WORDS:
        raise ValueError(f"window must be at least {SEED_WORDS} words")
    rows, search, texts = R.tables(docs, id_col, text_col)
    spans = R.repeated_spans(search, texts, R.Unit(window, SEED_WORDS, R.word_values, False, R.FOLLOWERS, R.MEMBERS), _judge(window))
    return R.with_spans(rows, spans).mapInArrow(X.tidy(_apply), RESULT)
