import random
import re

from leafmill.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Straight from the rule: windows by doc, removed where a smaller id has the same one."""
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}é" if k % 5 == 0 else f"w{k}" for k in range(400)]
    passage = [r.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 150))]
        if i % 3 == 0:  # a hot passage
            k = r.randint(0, len(w))
            a = r.randint(0, 10)
            w[k:k] = passage[a : a + r.randint(45, 60)]
        if i % 7 == 1 and rows:  # near copies
            w = WORD.findall(rows[r.randrange(len(rows))][1] or "")
            if w:
                w[r.randrange(len(w))] = "edit"
        rows.append((i * 3 % 61, (" \n" if i % 2 else " ").join(w)))
    rows += [(200, None), (201, ""), (202, " ".join(["x"] * 130)), (203, " ".join(["x"] * 80)), (204, "a b c"), (None, rows[0][1]), rows[9], rows[9]]
    rows.append((205, " ".join(passage + passage)))
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "2 as n", "'z' as id", "3 as spans").repartition(3)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(df).collect()), key=str)
        assert got == brute(rows, 50)


def test_small_window_and_empty_table(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(df, window=20).collect()), key=str)
    assert got == brute(rows, 20)
    assert substring_dedup(df.limit(0)).count() == 0


def test_spans_are_disjoint_and_long(spark):
    df = spark.createDataFrame(corpus(4), "doc_id long, text string")
    for r in substring_dedup(df).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(s.end - s.start >= 50 for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_every_removal_comes_from_the_extension(spark, monkeypatch):
    def nothing(shard):
        import numpy as np

        n = shard.keys.array()["n"].astype(np.int64)
        return np.cumsum(n) - n, np.zeros(int(n.sum()), np.uint8)

    monkeypatch.setattr("leafmill.llm.substring_dedup._judge", lambda window: nothing)
    df = spark.createDataFrame(corpus(5), "doc_id long, text string").repartition(3)
    assert sum(r.n_removed for r in substring_dedup(df).collect()) == 0


def test_many_copies_with_few_followers_and_members(spark, monkeypatch):
    from leafmill.llm import _repeats as R

    monkeypatch.setattr(R, "FOLLOWERS", 3)
    monkeypatch.setattr(R, "MEMBERS", 2)
    r = random.Random(2)
    passage = " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(80))
    rows = [(k // 2, f"{k} " * r.randint(0, 9) + passage + f" {k}") for k in range(90)] + [(300 + k, passage) for k in range(30)]
    rows += [(700, " ".join([passage] * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.text) for x in substring_dedup(df).collect()), key=str)
    assert got == brute(rows, 50)


def periodic(seed):
    """Texts that repeat a few words for long, alone, behind and before others, and with equal ids."""
    r = random.Random(seed)
    lines = [[f"p{k}_{j}" for j in range(k)] for k in (1, 2, 3, 7, 20, 61, 90)]
    rows = []
    for i in range(70):
        line = r.choice(lines)
        a = r.randrange(len(line))
        w = (line * (r.randint(60, 300) // len(line) + 2))[a:]
        if i % 2:
            w[r.randrange(len(w))] = f"edit{i}"
        head = [f"h{r.randint(0, 3)}_{k}" for k in range(r.randint(0, 40))]
        rows.append((i // 3 if i % 4 else 100 - i, " ".join(head + w + r.choice(lines) * 3 + head)))
    return rows + [(200, rows[0][1]), (201, rows[0][1])]


def test_periodic_texts_match_brute_force(spark, monkeypatch):
    from leafmill.llm import _repeats as R

    for seed, followers in ((1, 64), (2, 64), (3, 3)):
        monkeypatch.setattr(R, "FOLLOWERS", followers)
        rows = periodic(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(df).collect()), key=str)
        assert got == brute(rows, 50)


def test_spans_of_a_periodic_stretch_do_not_grow_with_it(spark):
    from leafmill.llm import _repeats as R
    from leafmill.llm import substring_dedup as S

    rows = [(i, f"start{i} " + "very common " * 300 + f"end{i}") for i in range(60)]
    _, search, texts = R.tables(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "doc_id", "text")
    unit = R.Unit(50, S.SEED_WORDS, R.word_values, False)
    assert search.mapInArrow(R._emit_runs(unit), R.RUNS).count() < 10 * len(rows)
    spans = R.repeated_spans(search, texts, unit, S._judge(50))
    assert spans.count() < 10 * len(rows)


def test_rows_out_of_order_follow_earlier_ones(spark):
    """Of equal runs of a batch the earliest leads, whatever the order of its rows."""
    import numpy as np

    from leafmill.llm import _repeats as R

    r = random.Random(6)
    passage = " ".join(f"v{r.randint(0, 99)}" for _ in range(90))
    rows = [(i * 7 % 40, f"{i} " + (passage if i % 2 else "very common " * 200) + f" {i}") for i in range(40)]
    _, search, _ = R.tables(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text")
    runs = search.mapInArrow(R._emit_runs(R.Unit(50, 18, R.word_values, False)), R.RUNS).collect()
    lists = [(x.id, np.frombuffer(x.extra, R.FOLLOW)) for x in runs if x.extra]
    assert lists
    assert all((i, at) < (j, start) for i, f in lists for j, start, at in zip(f["id"], f["start"], f["at"], strict=True))
    whole = [x for x in runs if not x.extra]
    assert len({(x.anchor, x.ctx) for x in whole}) == len(whole)
