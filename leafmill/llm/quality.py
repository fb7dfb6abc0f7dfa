"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a batch of texts come from a few numpy passes over its bytes.  Trees are grown on
quantile bins with logistic loss, level by level, from histograms of gradients; they are complete
binary trees flattened into arrays, so a batch is scored by stepping all rows down all trees at once.

The forest is fitted on at most ``max_rows`` labelled rows (a documented bound, 20,000 by default)
outside fold 0; every document is scored whole.

Defined results
---------------
* null or empty text: all statistics 0, scored as such;
* very long texts are read whole;
* ties and repeated rows get equal scores; an id labelled twice counts with its larger label;
* null ids are scored and count as not held out;
* no labels, or labels of one kind: the score is that label, or 0.5 without any;
* an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _learn as L
from . import _text as X

_CLASSES = 11


def _byte_classes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 symbol, 7 bar, 8 other mark, 9 non-ASCII, 10 control."""
    table = np.full(256, 8, np.uint8)
    table[:0x20] = table[0x7F] = 10
    table[0x80:] = 9
    for text, k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r", 4), (".,;:!?", 5), ("#$%&*@^~+=<>\\", 6), ("|", 7)):
        table[np.frombuffer(text.encode(), np.uint8)] = k
    return table


_CLASS = _byte_classes()
NAMES = [
    "log_bytes", "lower", "upper", "digit", "blank", "line_end", "sentence_mark", "symbol", "bar", "other_mark", "non_ascii", "control",
    "log_words", "word_mean", "word_deviation", "word_longest", "one_letter", "odd_ends", "distinct_words", "commonest_word", "word_repeats",
    "log_lines", "line_mean", "distinct_lines", "sentence_words",
]


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every range: number of distinct values, and how often the commonest occurs."""
    n = np.zeros((2, len(first) - 1))
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(values[a:b])
            head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            n[:, k] = len(head), np.diff(np.append(head, b - a)).max()
    return n[0], n[1]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = _CLASS[data]
    counts = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES)
    some = np.maximum(size, 1)
    starts, ends, first = X.word_bounds(data, offsets, X.space_class())
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    per = np.maximum(words, 1)
    mean = np.bincount(doc, length, n) / per
    deviation = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    hashes = X.bytes_hash(data, starts, ends)
    distinct, commonest = _distinct(hashes, first)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    odd = np.isin(kinds[ends - 1], (6, 7, 8)) if len(ends) else again
    line = np.ones(256, bool)
    line[0x0A] = False
    a, b, lines_first = X.word_bounds(data, offsets, line)
    lines = np.diff(lines_first)
    distinct_lines, _ = _distinct(X.bytes_hash(data, a, b), lines_first)
    lines_some = np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(size), counts / some[:, None], np.log1p(words), mean, deviation, longest,
        np.bincount(doc, length == 1, n) / per, np.bincount(doc, odd, n) / per, distinct / per, commonest / per, np.bincount(doc, again, n) / per,
        np.log1p(lines), size / lines_some, distinct_lines / lines_some, words / (counts[:, 5] + 1),
    ])


@dataclass
class Forest:
    """Trees of one depth in level order: ``feature`` and ``threshold`` of inner nodes, ``value`` of leaves."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        inner = self.feature.shape[1]
        at = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            out += value[node - inner] if len(node) else 0
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -50, 50)))


def boost(rows: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Fits a forest by logistic loss."""
    n, width = rows.shape
    rate_of_ones = np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner = (1 << depth) - 1
    if n == 0 or y.min() == y.max():
        constant = 0.0 if n == 0 else (50.0 if y[0] else -50.0)
        return Forest(constant, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)])
    features, thresholds, values = [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(wide)
            total_g, total_h = np.bincount(local, grad, wide), np.bincount(local, hess, wide)
            before = total_g**2 / (total_h + ridge)
            for f in range(width):
                k = local * bins + binned[:, f]
                g = np.cumsum(np.bincount(k, grad, wide * bins).reshape(wide, bins), 1)
                h = np.cumsum(np.bincount(k, hess, wide * bins).reshape(wide, bins), 1)
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - before[:, None]
                gain[(h < least) | (rest_h < least)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                for j in np.flatnonzero(top > best + 1e-9):
                    best[j], feature[first + j], threshold[first + j] = top[j], f, edges[f][at[j]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in X.chunks(batch.column(1)):
            found = statistics(data, offsets)
            column = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(NAMES), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column], names=["y", "stats"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Forest:
    """A forest from at most ``max_rows`` labelled documents outside fold 0."""
    sample = L.bounded(L.labelled(labels, id_col, label_col), max_rows)  # so many rows are the bound of the broadcast
    rows = L.texts(docs, id_col, text_col).join(F.broadcast(sample), "id").select("y", "text").mapInArrow(X.tidy(_measure), "y int, stats array<double>")
    found = rows.toPandas()
    stats = np.array(found["stats"].tolist(), float).reshape(-1, len(NAMES))
    order = np.lexsort(np.column_stack([stats, found["y"].to_numpy()]).T)  # whatever order the rows come in
    return boost(stats[order], found["y"].to_numpy().astype(float)[order])


def quality_scores(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; predicted is 1 from ``threshold`` on."""
    X.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in X.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.value.score(statistics(data, offsets)))], names=["id", "score"])

    rows = L.texts(docs, id_col, text_col).mapInArrow(X.tidy(score), "id long, score double")
    return rows.select(F.col("id").alias("doc_id"), (L.fold("id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score reaches ``threshold``."""
    X.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest)
    column = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(statistics(data, offsets)) for _, _, data, offsets in X.chunks(batch.column(column))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(X.tidy(keep), docs.schema)
