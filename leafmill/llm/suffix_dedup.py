"""Suffix-array dedup by external induced sorting, on bytes.

Every shard gets stretches of text around byte anchors that occur more than once, so shards are
independent and unique text never reaches one; a stretch that occurs several times stands there once,
with its count, and neighbouring stretches that have no others to compare with are one.  A shard's suffixes are sorted with their common-prefix values by
:class:`leafmill.llm._induced.Sorter`, and neighbours that share ``window`` bytes form groups.  Every
removed byte lies in a string of such a group: of its places all but the earliest are repeats, and all
copies but the first of a counted stretch.

A shard ends at the first anchor beyond 4 MB of text.  One anchor's stretches can make a larger one: text,
tuples, positions, names and verdicts of a shard are scratch files beyond ``memory_tuples`` tuples.

Defined results
---------------
* null or empty text: 0 bytes, nothing removed; texts shorter than a window: nothing removed;
* very long texts are read whole; a removed run may cut a multi-byte character, so what is kept is
  binary;
* ties: of equal strings the one in the smaller id, then at the smaller start, stays; of documents with
  equal ids and different texts the one with the smaller text hash counts as earlier;
* repeated rows (same id and text) count as one document and get equal results;
* null ids: the row is returned unchanged and covers nothing;
* an empty table gives an empty table; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import _induced as I
from . import _repeats as R
from . import _text as X

GRAM_BYTES = 32
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
#: Bits of a verdict: the window repeats an earlier one, its copies repeat it, its stretch has copies.
OWN, AGAIN, COPIED = 1, 2, 4


class Groups:
    """Verdicts on windows from suffixes in order: all places but the first in text order of every group of
    equal windows repeat, and so do the copies of every place that the order holds."""

    def __init__(self, verdict: np.ndarray, window: int):
        self.verdict, self.window = verdict, window
        self.first = -1  # earliest place of the group that may go on

    def visit(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos) == 0:
            return
        new = lcp < self.window
        heads = np.flatnonzero(np.append(True, new[1:]))
        least = np.minimum.reduceat(pos, heads)
        bits = self.verdict[pos]
        bits |= bits >> 1 & AGAIN
        if self.first >= 0 and not new[0]:
            least[0], later = min(least[0], self.first), max(least[0], self.first)
            if later == self.first:
                self.verdict[later] |= OWN
        bits[pos != least[np.cumsum(np.append(False, new[1:]))]] |= OWN
        self.verdict[pos] = bits
        self.first = int(least[-1])


def _judge(window: int, limit: int) -> R.Judge:
    def judge(shard: R.Shard) -> tuple[np.ndarray, np.ndarray]:
        shard.text.append(np.zeros(8, np.uint8))
        text, keys = shard.text.array(), shard.keys.array()
        verdict = I.blank(len(text), np.uint8, limit * I.TUPLE.itemsize)
        for at in I.blocks(len(keys), 4_000):
            k = np.array(keys[at])
            k = k[k["many"] > 0]
            verdict[X.gather_ranges(k["base"], k["n"].astype(np.int64))] = COPIED
        I.Sorter(text, limit, window).run(Groups(verdict, window).visit)
        return keys["base"], verdict

    return judge


def _covered(offsets: np.ndarray, size: int, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, offsets[row] + start, 1)
    np.add.at(mark, offsets[row] + end, -1)
    return np.cumsum(mark)[:-1] > 0


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        row, start, end = R.batch_spans(batch)
        for lo, hi, data, offsets in R.unsqueezed(batch.column(2)):
            mine = (row >= lo) & (row < hi)
            r, s, e = row[mine] - lo, start[mine], end[mine]
            kept = ~_covered(offsets, len(data), r, s, e)
            total = np.append(0, np.cumsum(kept))[offsets]
            size = np.diff(offsets)
            removed = size - np.diff(total)
            body = X.binary_column(data[kept], total[1:])
            spans = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(r, minlength=hi - lo))).astype(np.int32), pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["start", "end"])).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), spans, body], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, removed, rest): texts without their spans; a character that a span cuts goes whole."""
    for batch in batches:
        row, start, end = R.batch_spans(batch)
        rest = batch.column(4)
        null = rest.field("null").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in R.unsqueezed(batch.column(2)):
            mine = (row >= lo) & (row < hi)
            gone = _covered(offsets, len(data), row[mine] - lo, start[mine], end[mine])
            character = np.cumsum((data & 0xC0) != 0x80)
            cut = np.zeros(len(data) + 1, bool)
            cut[character[gone]] = True
            kept = ~cut[character]
            total = np.append(0, np.cumsum(kept))[offsets]
            body = pa.Array.from_buffers(pa.string(), hi - lo, X.binary_column(data[kept], total[1:]).buffers())
            text = pc.if_else(pa.array(null[lo:hi]), pa.scalar(None, pa.string()), body)
            yield pa.RecordBatch.from_arrays([text, pa.array(np.diff(offsets) - np.diff(total), pa.int64()), rest.slice(lo, hi - lo).field("row")], names=["text", "removed", "row"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = 100) -> DataFrame:
    """The rows of ``docs``, with all columns, without the bytes that :func:`suffix_dedup` removes.

    What is left of a character that a removed run cuts goes with it.  ``length_col`` gets the number of
    characters left in texts that lose some.  A text that a repeat covers whole becomes empty and stays.
    """
    rows, search, texts = R.tables(docs, id_col, text_col, carry=True)
    spans = _spans(search, texts, window, I.MEMORY_TUPLES, R.SHARD_BYTES)
    others = StructType([f for f in docs.schema.fields if f.name != text_col])
    out = R.with_spans(rows, spans).mapInArrow(X.tidy(_trim), StructType([StructField("text", StringType()), StructField("removed", LongType()), StructField("row", others)]))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("text").alias(c)
        old = F.col("row").getField(c)
        return (F.when(F.col("removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(old) if c == length_col else old).alias(c)

    return out.select(*[column(c) for c in docs.columns])


def _spans(search: DataFrame, texts: DataFrame, window: int, memory_tuples: int, shard_bytes: int) -> DataFrame:
    unit = R.Unit(window, GRAM_BYTES, R.byte_values, True, R.FOLLOWERS, R.MEMBERS, chains=True)
    return R.repeated_spans(search, texts, unit, _judge(window, memory_tuples), shard_bytes, memory_tuples * I.TUPLE.itemsize)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, memory_tuples: int = I.MEMORY_TUPLES, shard_bytes: int = R.SHARD_BYTES) -> DataFrame:
    """Removes every byte covered by a ``window``-byte string that also starts earlier.

    Returns doc_id, n_bytes, n_removed, spans (removed byte ranges, end exclusive, sorted and
    disjoint) and kept (the remaining bytes).  ``window`` may be 40 to 250; ``memory_tuples`` bounds what
    a shard's queues hold before they spill, ``shard_bytes`` the text of a shard up to its last anchor.
    """
    if not GRAM_BYTES + 8 <= window <= 250:
        raise ValueError("window must be 40 to 250 bytes")
    rows, search, texts = R.tables(docs, id_col, text_col)
    return R.with_spans(rows, _spans(search, texts, window, memory_tuples, shard_bytes)).mapInArrow(X.tidy(_apply), RESULT)
