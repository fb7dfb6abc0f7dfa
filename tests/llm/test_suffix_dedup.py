import random

from leafmill.llm.suffix_dedup import suffix_dedup


def brute(rows, window):
    """Straight from the rule, over the distinct (id, text) rows."""
    seen, gone = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        b = t.encode()
        cover = bytearray(len(b))
        for k in range(len(b) - window + 1):
            s = b[k : k + window]
            if s in seen:
                cover[k : k + window] = b"\1" * window
            seen.add(s)
        gone[i, t] = cover
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = gone.get((i, t or ""), bytes(len(b)))
        runs = len([x for x in bytes(cover).split(b"\0") if x])
        out.append((i, len(b), sum(cover), runs, bytes(x for x, c in zip(b, cover) if not c)))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    line = "".join(r.choice("abcdé ñ\n") for _ in range(130))
    passage = "".join(r.choice("the aon é") for _ in range(400))
    rows = []
    for i in range(n):
        t = "".join(r.choice("abcdefgh é") for _ in range(r.randint(0, 500)))
        if i % 3 == 0:
            k = r.randint(0, len(t))
            t = t[:k] + line + t[k:]
        if i % 5 == 1:
            a = r.randint(0, 250)
            t = t + passage[a : a + r.randint(90, 300)] + t
        if i % 7 == 2 and rows:
            t = rows[r.randrange(len(rows))][1] or ""
            k = r.randint(0, len(t))
            t = t[:k] + "EDIT" + t[k:]
        rows.append((i * 7 % 61, t))
    rows += [(100, None), (101, ""), (102, "a" * 700), (103, "x" + "a" * 150 + "y"), (104, "ab" * 120), (None, rows[0][1]), rows[3], rows[3], (105, rows[1][1])]
    rows += [(106, "\x00" * 130 + "z"), (107, "q" + "\x00" * 130)]
    return rows


def got(df, **kw):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(df, **kw).collect()), key=str)


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "2 as n", "'z' as id", "3 as body").repartition(3)
        assert got(df) == brute(rows, 100)


def test_spilling_and_other_windows(spark):
    rows = corpus(3, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(df, window=60, memory_tuples=500) == brute(rows, 60)
    assert suffix_dedup(df.limit(0)).count() == 0


def test_every_removal_comes_from_the_sorted_order(spark, monkeypatch):
    """With a sorter that orders nothing, nothing is removed.  Workers are forked anew, so the setting travels in the plan."""
    from leafmill.llm import _repeats as R

    def nothing(shard):
        import numpy as np

        return shard.keys.array()["base"], np.zeros(shard.text.size, np.uint8)

    monkeypatch.setattr("leafmill.llm.suffix_dedup._judge", lambda window, limit: nothing)
    rows = corpus(5, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sum(r.n_removed for r in suffix_dedup(df).collect()) == 0
    assert R.FOLLOWERS > 1


def test_many_copies_and_small_shards(spark, monkeypatch):
    from leafmill.llm import _repeats as R

    monkeypatch.setattr(R, "FOLLOWERS", 3)
    monkeypatch.setattr(R, "MEMBERS", 2)
    r = random.Random(9)
    passage = "".join(r.choice("the aon é") for _ in range(260))
    rows = [(k, "".join(r.choice("abcdef") for _ in range(r.randint(0, 60))) + passage[: r.choice([150, 260])] + str(k)) for k in range(90)]
    rows += [(200 + k, rows[4][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, shard_bytes=2_000) == brute(rows, 100)


def test_periodic_texts_in_any_order(spark):
    for seed in (14, 15):
        r = random.Random(seed)
        lines = ["".join(r.choice("abcdé ") for _ in range(k)) for k in (1, 2, 5, 33, 101, 140, 260)]
        rows = []
        for i in range(60):
            line = r.choice(lines)
            a = r.randrange(len(line))
            t = (line * (600 // len(line) + 3))[a:]
            if i % 3 == 0:
                t = line * 2
            if i % 3 == 1:
                k = r.randrange(len(t))
                t = t[:k] + f"E{i}" + t[k:]
            rows.append((i * 37 % 61, f"{r.randint(0, 3)}" * r.randint(0, 60) + t))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        assert got(df) == brute(rows, 100)
