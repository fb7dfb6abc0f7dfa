"""Benchmark decontamination by size-partitioned MinHash containment search.

The indexed side, the test items, is partitioned by the size of its shingle sets (powers of two).  All
sets are sketched in one MinHash order.  An item of ``n`` shingles of which a document must contain a
share ``t`` keeps its ``n - ceil(t * n) + 1`` smallest hashes: a document that contains enough of the
item contains one of these, so, unlike with banded signatures, no match of a short item in a long
document can be missed.  A document keeps all hashes up to the largest that a partition's items keep.
Meeting pairs are verified by exact containment of the item's whole shingle set.

Items come in blocks of a bounded number of shingles; each block is broadcast and the documents are
scanned once for it.  Documents are never shuffled.

Defined results
---------------
* words are runs of letters, digits and non-ASCII characters, A-Z lower-cased;
* null or empty texts, and texts without words, contain nothing and are contained nowhere;
* items of fewer words than a shingle count as one shingle of that many words;
* very long documents are read whole; shingle hashes have 64 bits;
* ties and repeated rows: every row of documents is matched with every row of items by itself;
* null ids are kept in the result; empty tables give an empty result;
* further columns are ignored (``drop_contaminated`` keeps them), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

#: Shingles of items in one broadcast block (8 bytes each).
BLOCK_SHINGLES = 1_000_000
RESULT = "doc_id long, item_id long, n_shared long, n_item long, containment double"


@dataclass
class Part:
    """Items of one shingle length and size class, with the union of their sketches."""

    words: int
    values: np.ndarray  # sorted sketch values
    items: np.ndarray  # the item of each
    table: np.ndarray  # which upper 20 bits occur


@dataclass
class Block:
    ids: list[int | None]
    sets: list[np.ndarray]
    parts: list[Part]
    share: float


def grams(data: np.ndarray, offsets: np.ndarray, words: int, cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words, and the bounds of every text in them."""
    if cache is None or "words" not in cache:
        data = X.LOWER[data]
        starts, ends, first = X.word_bounds(data, offsets, X.alnum_class())
        found = X.bytes_hash(data, starts, ends), first
        if cache is not None:
            cache["words"] = found
    else:
        found = cache["words"]
    values, first = found
    count = np.maximum(np.diff(first) - words + 1, 0)
    at = X.gather_ranges(first[:-1], count)
    return X.ranges_hash(values, at, at + words), np.append(0, np.cumsum(count))


def build(ids: list[int | None], sets: list[np.ndarray], lengths: list[int], share: float) -> Block:
    kept: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
    for k, (s, words) in enumerate(zip(sets, lengths, strict=True)):
        need = int(np.ceil(share * len(s) - 1e-9))
        kept.setdefault((words, len(s).bit_length()), []).append((s[: len(s) - max(need, 1) + 1], k))
    parts = []
    for (words, _), sketches in kept.items():
        values = np.concatenate([s for s, _ in sketches])
        items = np.repeat([k for _, k in sketches], [len(s) for s, _ in sketches])
        order = np.argsort(values, kind="stable")
        table = np.zeros(1 << 20, bool)
        table[(values >> np.uint64(44)).astype(np.int64)] = True
        parts.append(Part(words, values[order], items[order], table))
    return Block(ids, sets, parts, share)


def item_blocks(items: DataFrame, item_id: str, text_col: str, shingle: int, share: float) -> Iterator[Block]:
    """Streams the items through the driver, a bounded block at a time."""
    ids, sets, lengths, held = [], [], [], 0
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    for row in rows.toLocalIterator():
        data = np.frombuffer((row.t or "").encode("utf-8", "replace"), np.uint8)
        offsets = np.array([0, len(data)])
        n = len(X.word_bounds(data, offsets, X.alnum_class())[0])
        if n == 0:
            continue
        words = min(shingle, n)
        found = np.unique(grams(data, offsets, words)[0])
        ids.append(row.i)
        sets.append(found)
        lengths.append(words)
        held += len(found)
        if held >= BLOCK_SHINGLES:
            yield build(ids, sets, lengths, share)
            ids, sets, lengths, held = [], [], [], 0
    if ids:
        yield build(ids, sets, lengths, share)


def matches(block: Block, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of all texts that contain enough of an item."""
    out: list[tuple[int, int, int]] = []
    cache: dict = {}
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for part in block.parts:
        if part.words not in by_length:
            by_length[part.words] = grams(data, offsets, part.words, cache)
        hashes, bounds = by_length[part.words]
        at = np.flatnonzero(part.table[(hashes >> np.uint64(44)).astype(np.int64)])
        at = at[hashes[at] <= part.values[-1]]
        lo = np.searchsorted(part.values, hashes[at], "left")
        n = np.searchsorted(part.values, hashes[at], "right") - lo
        doc = np.repeat(np.searchsorted(bounds, at, "right") - 1, n)
        item = part.items[X.gather_ranges(lo, n)]
        for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
            s = block.sets[i]
            both = int(np.isin(s, hashes[bounds[d] : bounds[d + 1]]).sum())
            if both >= block.share * len(s) - 1e-9:
                out.append((d, i, both))
    return out


def _broadcast(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, shingle: int, share: float) -> list:
    X.small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    return [context.broadcast(b) for b in item_blocks(items, item_id, item_text, shingle, share)]


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of all documents that contain at least ``share`` of
    an item's distinct word shingles."""

    def scan(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = block.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for lo, _, data, offsets in X.chunks(batch.column(1)):
                    if found := matches(b, data, offsets):
                        rows = [(ids[lo + d], b.ids[i], both, len(b.sets[i]), both / len(b.sets[i])) for d, i, both in found]
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        return run

    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = [plain.mapInArrow(X.tidy(scan(b)), RESULT) for b in _broadcast(docs, items, item_id, item_text, shingle, share)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], RESULT)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all columns, that contain no item."""
    column = docs.columns.index(text_col)

    def scan(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in X.chunks(batch.column(column)):
                    keep[[lo + d for d, _, _ in matches(block.value, data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for b in _broadcast(docs, items, item_id, item_text, shingle, share):
        docs = docs.mapInArrow(X.tidy(scan(b)), docs.schema)
    return docs
