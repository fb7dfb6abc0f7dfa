import math

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import vector_search as V


def brute(rows, k, every):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v]))
    out = []
    asked = {}
    for i, v in usable:
        if i % every == 0 and (i not in asked or (len(v), np.array(v).tobytes()) < (len(asked[i]), np.array(asked[i]).tobytes())):
            asked[i] = v
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as score").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in V.top_inner_products(df, F.col("id") % every == 0, k).collect())
    # float32 input: the rule starts from the stored value
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(exact, k, every)


def test_matches_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, r.normal(0, 0.2, 16).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[20][1]) for k in range(150)]  # one very common vector, all ties
    check(spark, rows)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "_ROWS", 50)
    check(spark, rows, k=3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0])]
    rows += [(10, [0.0, 0.0]), (10, [0.0, 0.0]), (11, [0.1]), (20, [0.3]), (30, []), (31, []), (12, [1.0, 2.0]), (12, [1.0, 2.0]), (40, [3000.0, -5000.0])]
    check(spark, rows)
    check(spark, rows[:1])
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.top_inner_products(df, F.col("id") % 10 == 0).count() == 0
