"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled ones train a linear classifier in numpy.  With class prior
``p``, positive risk ``P`` and unlabelled risk ``U`` the loss is ``p * P(+) + max(0, U(-) - p * P(-))``;
where the corrected negative part falls below zero, the step climbs it back instead.

A text's features are the presence of words and of word beginnings of 4, 5 and 6 bytes, lower-cased,
as hashes.  The ``max_features`` ones with the most excess among toxic texts over all texts are used.

Fitting takes at most ``max_positive`` toxic and ``max_unlabelled`` unlabelled texts outside fold 0
(documented bounds); every document is scored whole.  Without a given prior it is the share of toxic
labels outside fold 0.

Defined results
---------------
* null or empty text: no features, scored by the intercept alone;
* very long texts are read whole; a feature counts once however often it occurs;
* ties and repeated rows get equal scores; an id labelled twice counts with its larger label;
* null ids are scored and count as not held out;
* no toxic labels: every score is 0;
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
from ._graph import written

_BEGINNINGS = (4, 5, 6)


@dataclass
class Linear:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if np.isneginf(self.intercept):
            return np.zeros(len(offsets) - 1)
        doc, which = present(data, offsets, self.features)
        margin = self.intercept + np.bincount(doc, self.weights[which], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature hash of every word and word beginning, with repetitions."""
    data = X.LOWER[data]
    starts, ends, first = X.word_bounds(data, offsets, X.alnum_class())
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    docs, hashes = [doc], [X.bytes_hash(data, starts, ends)]
    for k in _BEGINNINGS:
        longer = np.flatnonzero(ends - starts > k)
        docs.append(doc[longer])
        hashes.append(X.mix(X.bytes_hash(data, starts[longer], starts[longer] + k) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(hashes)


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place in ``wanted`` (sorted) of every wanted feature of every text, once each."""
    if len(wanted) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.zeros(1 << 18, bool)
    table[(wanted >> np.uint64(46)).astype(np.int64)] = True
    doc, hashes = features(data, offsets)
    maybe = table[(hashes >> np.uint64(46)).astype(np.int64)]
    doc, hashes = doc[maybe], hashes[maybe]
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    hit = wanted[at] == hashes
    pairs = np.unique(doc[hit] * len(wanted) + at[hit])
    return pairs // len(wanted), pairs % len(wanted)


def train(rows: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by the non-negative risk estimator with logistic loss (Adam, full batches).

    The ridge penalty defaults to 0.35 over the number of positive rows: less data, more caution.
    """
    rows = np.column_stack([rows, np.ones(len(rows), rows.dtype)])
    p, u = rows[positive], rows[~positive]
    ridge = 0.35 / len(p) if ridge is None else ridge
    w = np.zeros(rows.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def slope(z: np.ndarray) -> np.ndarray:  # of log(1 + exp(z))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    for k in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = u.T @ slope(zu) / len(u) - prior * (p.T @ slope(zp)) / len(p)
        if negative >= 0:
            grad = -prior * (p.T @ slope(-zp)) / len(p) + of_negative
        else:
            grad = -of_negative
        grad = grad + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, max_positive: int = 5_000, max_unlabelled: int = 15_000, max_features: int = 512) -> Linear:
    """Learns from toxic labels outside fold 0 and unlabelled documents outside fold 0."""
    known = L.labelled(labels, id_col, label_col)
    toxic = known.filter("y = 1")
    if prior is None:
        prior = known.agg(F.avg("y")).first()[0] or 0.0
        prior = min(max(prior, 1e-4), 0.5)
    plain = L.texts(docs, id_col, text_col)
    rest = plain.select("id").filter("id is not null").filter(L.fold("id") != 0).distinct().join(toxic, "id", "left_anti")
    sample = L.bounded(toxic, max_positive).select("id", F.lit(1).alias("y")).unionByName(L.bounded(rest, max_unlabelled).select("id", F.lit(0).alias("y")))
    rows = written(plain.join(F.broadcast(sample), "id").select("y", "text"))  # max_positive + max_unlabelled rows bound both

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for lo, hi, data, offsets in X.chunks(batch.column(1)):
                doc, hashes = features(data, offsets)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                once = np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))[: len(doc)]
                parts.append((hashes[once], y[lo:hi][doc[once]]))
            if parts:
                hashes, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
                found, which = np.unique(hashes, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(which, toxic, len(found)).astype(np.int64)), pa.array(np.bincount(which, minlength=len(found)))], names=["feature", "p", "n"])

    sizes = rows.groupBy("y").count().collect()
    size = {r["y"]: r["count"] for r in sizes}
    if not size.get(1) or not size.get(0):
        return Linear(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    counts = rows.mapInArrow(X.tidy(count), "feature long, p long, n long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    share_p, share_u = F.col("p") / size[1], (F.col("n") - F.col("p")) / size[0]
    excess = (share_p - share_u) / F.sqrt((share_u + 1.0 / size[0]) / size[1] + (share_u + 1.0 / size[0]) / size[0])
    best = counts.filter("p >= 3").withColumn("excess", excess).filter("excess > 5").orderBy(F.desc("excess"), "feature").limit(max_features)
    wanted = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in X.chunks(batch.column(1)):
                doc, which = present(data, offsets, wanted)
                column = pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32), pa.array(which.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column], names=["y", "which"])

    marks = rows.mapInArrow(X.tidy(mark), "y int, which array<int>").toPandas()
    order = sorted(range(len(marks)), key=lambda k: (marks["y"][k], list(marks["which"][k])))  # whatever order the rows come in
    table = np.zeros((len(marks), len(wanted)), np.float32)
    for k, j in enumerate(order):
        table[k, marks["which"][j]] = 1
    positive = marks["y"].to_numpy()[order] == 1
    if len(table) == 0 or not positive.any() or positive.all():
        return Linear(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    weights, intercept = train(table, positive, prior)
    return Linear(wanted, weights, intercept)


def toxicity_scores(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; predicted is 1 from a score of 0.5 on."""
    X.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in X.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(data, offsets))], names=["id", "score"])

    rows = L.texts(docs, id_col, text_col).mapInArrow(X.tidy(score), "id long, score double")
    return rows.select(F.col("id").alias("doc_id"), (L.fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
