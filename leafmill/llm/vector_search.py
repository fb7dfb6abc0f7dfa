"""Exact top-k inner products by vector-approximation files.

Components become integers, ``floor(scale * x)``.  Every dimension is cut into 64 equal cells between
its least and greatest value over all rows; a vector's approximation is one cell number per dimension.
The approximation file is a Parquet table with the cells and the exact vectors in columns of their own.

1. A scan that reads the cells alone bounds every score from both sides, for blocks of queries, and gives
   each query's k-th largest lower bound.
2. A second scan of the cells takes the candidates whose upper bound reaches it.
3. Of each query's candidates in descending order of the upper bound the first are fetched, and scored
   exactly; then those whose upper bound reaches the k-th exact score.  No other vector can matter.

Scans keep at most k lower bounds per query and task.  Queries and cells meet in blocks; the work is queries
times rows, as the question demands, but never a join of the two.  Neither passes through the driver: query
blocks of up to ``BROADCAST_BLOCKS`` blocks are broadcast, more meet cell blocks by a shuffle.  Of equal
vectors of a task only the smallest ids are candidates, as many as can be among the best.

Defined results
---------------
* vectors that are null or hold null or non-finite components take no part, nor do null ids;
* vectors of different length are not compared; empty vectors score 0 with each other;
* rows that share the query's id are its own and no candidates; of a query id's repeated rows the
  smallest vector asks; repeated candidate rows count each;
* ties go to the smaller vec_id; fewer candidates than k: all of them;
* an empty table gives an empty table; further columns are ignored, whatever their names;
* scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._graph import written

CELLS = 64
#: Queries and cells of a block, blocks of queries that are broadcast (about 1 MB each at 64 dimensions), and
#: parts that a block of queries is copied for where they are not.
QUERY_BLOCK, CELL_BLOCK, BROADCAST_BLOCKS, SALTS = 2_048, 16_384, 64, 16
_ROWS = 1_024
#: Vectors that a task remembers; more of equal ones stay candidates after that.
SEEN = 100_000


def integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(id, dim, v) of usable vectors; v holds 64-bit integers."""
    for batch in batches:
        column = batch.column(1)
        ids, values = [], []
        size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        usable = (size >= 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        flat = column.flatten()
        bounds = np.append(0, np.cumsum(np.maximum(size, 0)))
        null = np.append(0, np.cumsum(~flat.is_valid().to_numpy(zero_copy_only=False)))
        x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        bad = np.append(0, np.cumsum(~np.isfinite(x)))
        usable &= (null[bounds[1:]] == null[bounds[:-1]]) & (bad[bounds[1:]] == bad[bounds[:-1]])
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.floor(scale * np.where(np.isfinite(x), x, 0)).astype(np.int64)
        names = batch.column(0).to_pylist()
        for k in np.flatnonzero(usable).tolist():
            ids.append(names[k])
            values.append(whole[bounds[k] : bounds[k + 1]].tobytes())
        kept = size[usable].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept), pa.array(values, pa.binary())], names=["id", "dim", "v"])


def _matrix(column: pa.Array, dim: int, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim)


@dataclass
class Marks:
    """Cells of one dimension count: ``low + cell * step`` starts a cell, which holds ``step`` integers."""

    low: np.ndarray
    step: np.ndarray

    def cells(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.low) // self.step).astype(np.uint8)

    def middle(self, cells: np.ndarray) -> np.ndarray:
        return self.low + cells * self.step.astype(np.float64) + (self.step - 1) / 2


@dataclass
class Queries:
    ids: np.ndarray
    vectors: np.ndarray


def _bounds(q: Queries, marks: Marks, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of the scores' bounds; the width has room for rounding."""
    x = q.vectors.astype(np.float64)
    middle = x @ marks.middle(cells).T
    half = np.abs(x) @ ((marks.step - 1) / 2)
    return middle, (half + 1e-9 * (half + np.abs(x) @ (np.abs(marks.low) + CELLS * marks.step)))[:, None]


def _own(q: Queries, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(q.ids, ids), len(q.ids) - 1)
    hit = np.flatnonzero(q.ids[at] == ids)
    return at[hit], hit


def thin(ids: np.ndarray, values: list[bytes], k: int, seen: dict[bytes, list[int]]) -> np.ndarray:
    """Which rows can be among the k best of a query that is not their own, after the rows ``seen``: of equal
    vectors the k + 1 smallest ids, each up to k times.  Ids come in any order, so this keeps a superset."""
    out = np.ones(len(ids), bool)
    if len(seen) > SEEN:
        seen.clear()
    for j, (i, v) in enumerate(zip(ids.tolist(), values, strict=True)):
        mine = seen.setdefault(v, [])
        if (len(mine) >= k * (k + 1) and i >= mine[-1]) or mine.count(i) >= k:
            out[j] = False
        else:
            insort(mine, i)
            del mine[k * (k + 1) :]
    return out


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, ids, cells): blocks of rows as two binary values."""
    for batch in batches:
        dims = batch.column(1).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            for at in range(0, len(rows), CELL_BLOCK):
                some = batch.take(pa.array(rows[at : at + CELL_BLOCK]))
                ids = some.column(0).to_numpy(zero_copy_only=False).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.binary()), pa.array([b"".join(some.column(2).to_pylist())], pa.binary())], names=["dim", "ids", "cells"])


def _meetings(batches: Iterator[pa.RecordBatch], marks: dict[int, Marks]) -> Iterator[tuple[tuple[int, int], Queries, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (dim, qb, ids, cells, queries): the block, its queries and floors, and a few candidates with their cells."""
    last, q, floor = None, None, None
    for batch in batches:
        for dim, qb, ids, cells, block in zip(*batch.columns, strict=True):
            dim, qb = dim.as_py(), qb.as_py()
            if dim not in marks:
                continue
            if last != (dim, qb):
                last, (asked, vectors, floors) = (dim, qb), block.values.flatten()
                asked = asked.to_numpy(zero_copy_only=False)
                order = np.argsort(asked)
                q = Queries(asked[order], _matrix(vectors, dim)[order])
                floor = floors.fill_null(-np.inf).to_numpy(zero_copy_only=False)[order]
            names = np.frombuffer(ids.as_py(), np.int64)
            matrix = np.frombuffer(cells.as_py(), np.uint8).reshape(len(names), dim)
            for at in range(0, len(names), _ROWS):
                yield last, q, floor, names[at : at + _ROWS], matrix[at : at + _ROWS]


def scan_bounds(batches: Iterator[pa.RecordBatch], marks: dict[int, Marks], k: int) -> Iterator[pa.RecordBatch]:
    """The k largest lower bounds of every query over the task's rows."""
    best: dict[tuple[int, int], tuple[Queries, np.ndarray]] = {}
    for key, q, _, ids, cells in _meetings(batches, marks):
        middle, half = _bounds(q, marks[key[0]], cells)
        lower = middle - half
        lower[_own(q, ids)] = -np.inf
        old = best[key][1] if key in best else np.full((len(q.ids), k), -np.inf)
        every = np.concatenate([old, lower], 1)
        best[key] = q, np.partition(every, every.shape[1] - k, 1)[:, -k:]
    for q, bounds in best.values():
        found = np.isfinite(bounds)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, found.sum(1))), pa.array(bounds[found])], names=["query_id", "bound"])


def scan_candidates(batches: Iterator[pa.RecordBatch], marks: dict[int, Marks]) -> Iterator[pa.RecordBatch]:
    """Pairs whose upper bound reaches the query's floor."""
    for key, q, floor, ids, cells in _meetings(batches, marks):
        middle, half = _bounds(q, marks[key[0]], cells)
        upper = middle + half
        upper[_own(q, ids)] = -np.inf
        who, what = np.nonzero((upper >= floor[:, None]) & np.isfinite(upper))
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[who]), pa.array(ids[what]), pa.array(upper[who, what])], names=["query_id", "vec_id", "upper"])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, exact within 64 bits."""
    return np.einsum("ij,ij->i", a, b)


def score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of rows (query_id, vec_id, dim, q, v)."""
    for batch in batches:
        dims = batch.column(2).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
            score = _scores(_matrix(rows.column(3), dim), _matrix(rows.column(4), dim))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest inner product of every query.

    ``is_query`` is a condition on the column ``id``.
    """
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    whole = plain.mapInArrow(lambda b: integers(b, scale), "id long, dim int, v binary")

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                v = _matrix(batch.column(2).take(pa.array(np.flatnonzero(dims == dim))), dim)
                low, high = v.min(0), v.max(0)
                if dim in seen:
                    low, high = np.minimum(low, seen[dim][0]), np.maximum(high, seen[dim][1])
                seen[dim] = low, high
        for dim, (low, high) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)], names=["dim", "at", "low", "high"])

    spans = whole.mapInArrow(extent, "dim int, at int, low long, high long").groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    marks: dict[int, Marks] = {0: Marks(np.zeros(0, np.int64), np.zeros(0, np.int64))}
    spans = spans.toPandas().sort_values(["dim", "at"])  # two numbers per dimension
    for dim, group in spans.groupby("dim"):
        low, high = group["low"].to_numpy(), group["high"].to_numpy()
        marks[int(dim)] = Marks(low, np.maximum(1, -(-(high - low + 1) // CELLS)))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            ids, dims, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cells = [marks[d].cells(np.frombuffer(v, np.int64)).tobytes() for d, v in zip(dims, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary()), pa.array(thin(ids, values, k, seen))], names=["id", "dim", "v", "cells", "candidate"])

    file = written(whole.mapInArrow(approximate, "id long, dim int, v binary, cells binary, candidate boolean"))
    queries = written(file.filter(is_query).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select(F.col("id").alias("query_id"), "q.dim", F.col("q.v").alias("q")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    cells = file.filter("candidate").select("id", "dim", "cells").mapInArrow(pack, "dim int, ids binary, cells binary")

    def met(bounds: DataFrame | None) -> DataFrame:
        """(dim, qb, ids, cells, queries): blocks of cells beside blocks of queries with their floors."""
        rows = queries.withColumn("bound", F.lit(None).cast("double")) if bounds is None else queries.join(bounds, "query_id", "left")
        of = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb")
        packed = rows.groupBy("dim", of).agg(F.collect_list(F.struct("query_id", "q", "bound")).alias("queries"))
        spread = cells.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        if blocks <= BROADCAST_BLOCKS:
            joined = spread.join(F.broadcast(packed), ["dim", "qb"])
        else:
            salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = spread.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")).join(salted, ["dim", "qb", "salt"])
        return joined.select("dim", "qb", "ids", "cells", "queries")

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    bounds = met(None).mapInArrow(lambda b: scan_bounds(b, marks, k), "query_id long, bound double")
    kth = bounds.withColumn("n", F.row_number().over(by_bound)).filter(F.col("n") == k).select("query_id", "bound")
    pairs = met(kth).mapInArrow(lambda b: scan_candidates(b, marks), "query_id long, vec_id long, upper double")
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    pairs = written(pairs.groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper")).withColumn("turn", F.row_number().over(order)))

    def scored(some: DataFrame) -> DataFrame:
        """Exact scores; only the vectors of these pairs are looked up."""
        exact = file.filter("candidate").select(F.col("id").alias("vec_id"), "dim", "v")
        found = some.select("query_id", "vec_id").join(queries, "query_id").join(exact, ["vec_id", "dim"])
        return found.select("query_id", "vec_id", "dim", "q", "v").mapInArrow(score_pairs, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = written(scored(pairs.filter(F.col("turn") <= 2 * k)))
    least = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", F.col("score").alias("least"))
    more = pairs.filter(F.col("turn") > 2 * k).join(least, "query_id", "left").filter("least is null or upper >= least")
    out = first.unionByName(scored(more))
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
