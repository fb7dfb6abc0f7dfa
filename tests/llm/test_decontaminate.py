import random
import re

from leafmill.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(w, n):
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(docs, items, n, share):
    out = []
    for d, t in docs:
        dw = words(t)
        for i, x in items:
            iw = words(x)
            if not iw:
                continue
            m = min(n, len(iw))
            s = shingles(iw, m)
            both = len(s & shingles(dw, m))
            if both and both >= share * len(s) - 1e-9:
                out.append((d, i, both, len(s), round(both / len(s), 9)))
    return sorted(out, key=str)


def tables(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(200)] + ["été", "straße"]
    item = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, item(r.choice([1, 2, 3, 4, 5, 8, 30, 60]))) for k in range(40)] + [(100, None), (101, " . "), (None, item(12)), (5, item(9)), (5, item(9))]
    docs = []
    for k in range(80):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 50, 900]))]
        if k % 2:
            x = r.choice(items)[1] or ""
            x = words(x)
            for _ in range(r.choice([0, 0, 1, 2])):
                if x:
                    x[r.randrange(len(x))] = "edit"
            at = r.randint(0, len(w))
            w[at:at] = [t.upper() if t.isascii() else t for t in x]
        docs.append((k, ", ".join(w) if k % 3 else "\n".join(w)))
    return docs + [(200, None), (None, items[6][1]), docs[1], docs[1]], items


def test_matches_brute_force(spark, monkeypatch):
    for seed, block in ((1, 10**6), (2, 150)):
        monkeypatch.setattr(D, "BLOCK_SHINGLES", block)
        docs, items = tables(seed)
        a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as item_id", "8 as n_item").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 as doc_id")
        got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item, round(r.containment, 9)) for r in D.contained_items(a, b).collect()), key=str)
        assert got == brute(docs, items, 5, 0.8)
        left = sorted((r.doc_id for r in D.drop_contaminated(a, b).collect()), key=str)
        hit = {d for d, *_ in got}
        assert left == sorted((d for d, _ in docs if d not in hit), key=str)
        assert D.drop_contaminated(a, b).columns == a.columns


def test_empty_tables(spark):
    docs, items = tables(3)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert D.contained_items(a.limit(0), b).count() == 0
    assert D.contained_items(a, b.limit(0)).count() == 0
    assert D.drop_contaminated(a, b.limit(0)).count() == len(docs)
