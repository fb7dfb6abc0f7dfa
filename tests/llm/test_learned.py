import zlib

import numpy as np
import pytest

from leafmill.llm import quality as Q
from leafmill.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").repartition(4)
    return read("documents"), read("labels"), {r.doc_id: r for r in read("labels").collect()}


def figures(rows, truth, name):
    pairs = [(getattr(truth[r.doc_id], name), r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    y, s, p = (np.array(x) for x in zip(*pairs))
    return auc(y, s), (y == p).mean(), (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()


def test_quality_on_held_out_rows(tables):
    docs, labels, truth = tables
    rows = Q.quality_scores(docs, Q.fit_quality(docs, labels)).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    area, right, kept, rejected = figures(rows, truth, "quality")
    print("quality", area, right, kept, rejected)
    assert area > 0.97 and kept > 0.98 and rejected > 0.8


def test_toxicity_on_held_out_rows(tables):
    docs, labels, truth = tables
    rows = T.toxicity_scores(docs, T.fit_toxicity(docs, labels)).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    area, right, caught, clean = figures(rows, truth, "toxic")
    print("toxicity", area, right, caught, clean)
    assert area > 0.95 and caught > 0.85 and clean > 0.95


def test_edge_rows_and_missing_labels(spark, tables):
    _, labels, _ = tables
    rows = [(1, None), (2, ""), (None, "some words here"), (4, "x" * 300_000), (4, "x" * 300_000), (5, "| # | # " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as score", "3 as y")
    none = labels.limit(0)
    assert {r.score for r in Q.quality_scores(df, Q.fit_quality(df, none)).collect()} == {0.5}
    assert {r.score for r in T.toxicity_scores(df, T.fit_toxicity(df, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in Q.quality_scores(df, Q.fit_quality(df, ones)).collect()} == {1.0}
    got = Q.quality_scores(df, Q.fit_quality(df, labels)).collect()
    assert len(got) == 6 and all(r.score is not None and r.held_out is not None for r in got)
    assert Q.quality_scores(df.limit(0), Q.fit_quality(df, labels)).count() == 0
    assert T.toxicity_scores(df.limit(0), T.Linear(np.zeros(0, np.uint64), np.zeros(0), 0.0)).count() == 0


def test_forest_fits_a_rule():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    f = Q.boost(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    one = np.array([f.margin(x[k : k + 1])[0] for k in range(50)])
    assert np.allclose(one, f.margin(x[:50]))


def test_non_negative_risk_separates_with_unlabelled_positives():
    r = np.random.default_rng(2)
    toxic = r.random(4000) < 0.2
    x = (r.random((4000, 20)) < np.where(toxic[:, None] & (np.arange(20) < 6), 0.7, 0.05)).astype(np.float32)
    positive = np.zeros(4000, bool)
    positive[np.flatnonzero(toxic)[:300]] = True
    w, b = T.train(x, positive, 0.2)
    assert (((x @ w + b) > 0) == toxic).mean() > 0.95


def test_statistics_do_not_depend_on_the_batch():
    texts = [b"", b"One two, two.\nthree | |", "É à | 12 ***".encode(), b"a a a a"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    together = Q.statistics(data, offsets)
    for k, t in enumerate(texts):
        assert np.allclose(Q.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], together[k])
    assert together.shape[1] == len(Q.NAMES)


def test_training_follows_the_risk_estimator():
    """Against a plain implementation: the risk of the definition, its slope by differences, Adam by the book."""
    r = np.random.default_rng(5)
    rows = (r.random((40, 4)) < 0.4).astype(np.float32)
    positive = np.arange(40) < 8
    rows[:8, 0] = 1
    prior, ridge = 0.2, 0.35 / 8

    def parts(w):
        z = rows @ w[:-1] + w[-1]
        loss = lambda margin: np.log1p(np.exp(-margin))
        plus, minus = loss(z[positive]).mean(), loss(-z[positive]).mean()
        return prior * plus, loss(-z[~positive]).mean() - prior * minus

    def slope(f, w):
        return np.array([(f(w + e) - f(w - e)) / 2e-6 for e in np.eye(5) * 1e-6])

    w = np.append(np.zeros(4), np.log(prior / (1 - prior)))
    m, v, steps, climbed = np.zeros(5), np.zeros(5), 120, 0
    for k in range(1, steps + 1):
        if parts(w)[1] >= 0:
            g = slope(lambda x: sum(parts(x)), w)
        else:
            g, climbed = -slope(lambda x: parts(x)[1], w), climbed + 1
        g = g + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    weights, intercept = T.train(rows, positive, prior, steps=steps)
    assert np.allclose(np.append(weights, intercept), w, atol=1e-3)


def test_negative_risk_is_climbed_back():
    rows = np.eye(6, dtype=np.float32)[[0, 0, 0, 0, 0, 1]]
    positive = np.array([True, True, True, True, False, False])
    weights, intercept = T.train(rows, positive, 0.9, steps=200)
    z = rows @ weights + intercept
    risk = np.logaddexp(0, z[~positive]).mean() - 0.9 * np.logaddexp(0, z[positive]).mean()
    assert risk > -0.2  # without the correction it falls without bound


def plain_boost(rows, y, trees, depth, rate, bins, ridge, least):
    """Trees by trying every split of every node."""
    margin = [np.log(y.mean() / (1 - y.mean()))] * len(y)
    edges = [sorted(set(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1]))) for f in range(rows.shape[1])]

    def grow(members, level):
        g = sum(1 / (1 + np.exp(-margin[i])) - y[i] for i in members)
        h = sum((p := 1 / (1 + np.exp(-margin[i]))) * (1 - p) for i in members)
        found, best = None, 1e-9
        if level < depth:
            for f, cuts in enumerate(edges):
                for c in cuts:
                    left = [i for i in members if rows[i, f] <= c]
                    gl = sum(1 / (1 + np.exp(-margin[i])) - y[i] for i in left)
                    hl = sum((p := 1 / (1 + np.exp(-margin[i]))) * (1 - p) for i in left)
                    if hl < least or h - hl < least:
                        continue
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    if gain > best + 1e-9:
                        found, best = (f, c), gain
        if found is None:
            return {i: -rate * g / (h + ridge) for i in members}
        f, c = found
        return grow([i for i in members if rows[i, f] <= c], level + 1) | grow([i for i in members if rows[i, f] > c], level + 1)

    for _ in range(trees):
        step = grow(list(range(len(y))), 0)
        margin = [z + step[i] for i, z in enumerate(margin)]
    return np.array(margin)


def test_trees_match_exhaustive_search():
    r = np.random.default_rng(9)
    rows = np.round(r.normal(size=(120, 3)), 1)
    y = (rows[:, 0] + 0.5 * rows[:, 1] ** 2 + 0.3 * r.normal(size=120) > 0.4).astype(float)
    forest = Q.boost(rows, y, trees=4, depth=3, rate=0.3, bins=8, ridge=1.0, least=2.0)
    assert np.allclose(forest.margin(rows), plain_boost(rows, y, 4, 3, 0.3, 8, 1.0, 2.0), atol=1e-9)
