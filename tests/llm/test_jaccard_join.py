import random
import re
import time

import numpy as np
import pyarrow as pa

from leafmill.llm import jaccard_join as J
from leafmill.llm._graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(rows, n, low, high):
    """All pairs."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if high * len(sets[a] & sets[b]) >= low * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{k}É" if k % 7 == 0 else f"W{k}" for k in range(300)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 5, 30, 80, 200]))]
        if i % 3 == 0:
            w += passage
        if i % 4 == 1 and rows:  # chains of near copies, some near the threshold
            w = WORD.findall(rows[r.randrange(len(rows))][1])
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i * 37 % 1009, r.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (None, None), rows[5], rows[5], (2003, rows[5][1].upper())]


def test_matches_all_pairs(spark):
    for seed, n, low in ((1, 4, 85), (2, 5, 80), (3, 2, 60)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as node", "3 as component").repartition(3)
        got = sorted((tuple(r) for r in J.jaccard_components(df, shingle=n, threshold=(low, 100)).collect()), key=str)
        assert got == brute(rows, n, low, 100)


def test_blocks_and_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(J, "COMMON_IN_BATCH", 2)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((tuple(r) for r in J.jaccard_components(df, shingle=4, threshold=(85, 100)).collect()), key=str) == brute(rows, 4, 85, 100)
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_divide_skip_counts():
    r = random.Random(1)
    for _ in range(200):
        lists = [sorted(r.sample(range(30), r.randint(0, 30))) for _ in range(r.randint(1, 12))]
        needed = r.randint(1, 8)
        want = {m: sum(m in x for x in lists) for m in range(30)}
        assert dict(J.divide_skip(lists, needed, lambda m: False)) == {m: c for m, c in want.items() if c >= needed}


def test_divide_skip_probes_and_counts_alike(monkeypatch):
    r = random.Random(2)
    for _ in range(30):
        lists = [sorted(r.sample(range(20_000), r.choice([0, 3, 40, 900, 9_000]))) for _ in range(r.randint(2, 9))] + [sorted(r.sample(range(50), 20))]
        needed = r.randint(1, 6)
        n = np.bincount(np.concatenate([np.array(x, np.int64) for x in lists]))
        want = {m: c for m, c in enumerate(n.tolist()) if c >= needed and m % 3}
        for cost, weight in (((0, 0), 8), ((1 << 40, 0), 8), (J.PROBE_COST, 0), (J.PROBE_COST, 1 << 20)):
            monkeypatch.setattr(J, "PROBE_COST", cost)
            monkeypatch.setattr(J, "SORT_WEIGHT", weight)
            assert dict(J.divide_skip(lists, needed, lambda m: m % 3 == 0)) == want
        monkeypatch.undo()


def test_many_copies_below_the_threshold_take_no_long():
    """1,500 copies of one text, most of them too far from each other to link: one task's cluster."""
    r = np.random.default_rng(3)
    base, sets = r.integers(1_000, 1 << 30, 150), []
    for _ in range(1_500):
        x = base.copy()
        edits = r.integers(0, 41)
        x[r.choice(150, edits, replace=False)] = r.integers(0, 300, edits)
        sets.append(np.unique(x.astype(np.uint64)))
    assert sum(map(len, sets)) < J.BLOCK_SHINGLES
    began = time.thread_time()
    got = J.link_cluster(sets, 85, 100)
    took = time.thread_time() - began

    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    has = np.zeros((len(sets), number.max() + 1), np.float32)
    has[np.repeat(np.arange(len(sets)), sizes), number] = 1
    both = np.rint(has @ has.T).astype(np.int64)
    forest = J.Forest(len(sets))
    for a, b in np.argwhere(100 * both >= 85 * (sizes[:, None] + sizes - both)).tolist():
        forest.join(a, b)
    assert got == [forest.find(i) for i in range(len(sets))] and 500 < len(set(got)) < 1_400
    assert took < 6, took  # 19 s with lists merged by a heap, 0.5 s as it is


def test_meetings_keep_linked_pairs_and_drop_late_ones(monkeypatch):
    r = random.Random(5)
    for near in (2, 16):
        monkeypatch.setattr(J, "NEAR", near)
        for _ in range(25):
            base = r.sample(range(400), 60)
            sets = [sorted({x if r.random() > 0.1 else r.randrange(400) for x in base[: r.randint(40, 60)]}) for _ in range(30)]
            sets += [sorted(r.sample(range(400), r.randint(20, 60))) for _ in range(60)]
            rows = sorted((x, len(s) << J.PLACE_BITS | (k << J.PLACE_BITS) // len(s), i) for i, s in enumerate(sets) for k, x in enumerate(s[: len(s) - -(-85 * len(s) // 100) + 1]))
            cuts = sorted(r.sample(range(len(rows)), 9))
            batches = [pa.RecordBatch.from_arrays([pa.array([row[k] for row in part], pa.int64()) for k in range(3)], names=["a", "b", "c"]) for part in (rows[x:y] for x, y in zip([0, *cuts], [*cuts, len(rows)], strict=True))]
            groups = {}
            for out in J._meetings(85, 100)(iter(batches)):
                for group, size, node in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    assert size == len(sets[node])
                    groups.setdefault(group, set()).add(node)
            for a in range(len(sets)):
                for b in range(a):
                    both = len(set(sets[a]) & set(sets[b]))
                    if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                        assert any({a, b} <= g for g in groups.values())
    late = [(x, 100 << J.PLACE_BITS | (k << J.PLACE_BITS) // 100, i) for x, k, i in ((7, 3, 1), (7, 12, 2), (9, 3, 1), (9, 7, 3))]
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in late], pa.int64()) for k in range(3)], names=["a", "b", "c"])
    assert [x for out in J._meetings(85, 100)(iter([batch])) for x in out.column(2).to_pylist()] == [1, 3]


def test_cluster_links_match_all_pairs():
    r = random.Random(7)
    for _ in range(150):
        base = [r.randint(0, 60) for _ in range(30)]
        sets = [np.unique(np.array([x if r.random() > 0.12 else r.randint(0, 99) for x in base], np.uint64)) for _ in range(r.randint(2, 14))]
        got = J.link_cluster(sets, 80, 100)
        rows = [(i, " ".join(f"{x}" for x in s.tolist())) for i, s in enumerate(sets)]
        want = [c for _, _, c in sorted(brute(rows, 1, 80, 100), key=lambda x: x[0])]
        assert got == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 400), (400, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, **{k: 300 for k in (300, 400, 500)}}


def test_sets_outside_search_across_blocks():
    r = random.Random(11)
    for _ in range(100):
        base = [r.randint(0, 60) for _ in range(30)]
        sets = [np.unique(np.array([x if r.random() > 0.1 else r.randint(0, 99) for x in base], np.uint64)) for _ in range(12)]
        labels = [r.randint(0, 5) for _ in sets]
        links = J.link_across(sets[:8], sets[8:], labels, 80, 100)
        up = J.Forest(12)
        for i, x in enumerate(labels):
            up.join(i, labels.index(x))
        for j, i in links:
            both = len(np.intersect1d(sets[8 + j], sets[i]))
            assert 100 * both >= 80 * (len(sets[8 + j]) + len(sets[i]) - both)
            up.join(i, 8 + j)
        for j in range(8, 12):  # every link ends inside one component
            for i in range(8):
                both = len(np.intersect1d(sets[j], sets[i]))
                if 100 * both >= 80 * (len(sets[j]) + len(sets[i]) - both):
                    assert up.find(i) == up.find(j)


def test_one_large_cluster_in_many_blocks(spark, monkeypatch):
    """Near copies of one text, of which some link only by chains: components match all pairs."""
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(J, "PIVOTS", 2)
    r = random.Random(8)
    rows, w = [], [f"w{r.randint(0, 500)}" for _ in range(120)]
    for i in range(90):
        if i % 9 == 8:
            w = list(w)
            w[r.randrange(len(w))] = f"drift{i}"
            w[r.randrange(len(w))] = f"drift{i}"
        x = list(w)
        for _ in range(r.choice([0, 1, 2, 4])):
            x[r.randrange(len(x))] = f"edit{i}"
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(x) for x in J.jaccard_components(df, shingle=4, threshold=(85, 100)).collect()), key=str)
    assert got == brute(rows, 4, 85, 100) and len({c for *_, c in got}) > 1
