import math
import random

from pyspark.sql import functions as F

from leafmill.llm import url_filter as U

SF = "/root/testdata/sf0.1"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule(host, path):
    fits = []
    for text, verdict in U.RULES:
        name, tail = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append((text, verdict))
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


CASES = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.Org/es/x", "http://example.org", "http://example.org/", "https://a.example.org/en/12?q=1#f", "http://org/x", "http://borg/x", "http://x.com/de/1", "http://x.com/fr/2", "http://x.com/dex", "http://x.com/en/#/de/", "http://x.com?u=http://y.org/a", "http://é.org/ß://x", "a://b://c/d", "http://x.net/\n/y", "http://user@h.com:80/fr/", "http://x.org/" + "a/" * 60_000]


def test_rules_match_brute_force(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(CASES)] + [(None, CASES[5]), (5, CASES[5])], "page_id long, url string").selectExpr("*", "'h' as host", "1 as y", "2 as n", "'s' as suffix").repartition(2)
    for r in U.filter_urls(df).collect():
        host, path = split(CASES[r.page_id] if r.page_id is not None else CASES[5])
        text, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert U.filter_urls(df.limit(0)).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    got = U.filter_urls(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(urls[r.page_id])
        text, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text) and (verdict is None or r.verdict == verdict)


def test_trees_learn_from_labelled_urls(spark):
    r = random.Random(3)
    rows = []
    for k in range(4000):
        bad = r.random() < 0.4
        host = "".join(r.choice("abcdefgh") for _ in range(r.randint(5, 10))) + r.choice([".com", ".net"] if bad else [".org", ".net"])
        query = "?" + "&".join(f"p{n}={r.randint(0, 10**9)}" for n in range(r.randint(3, 6))) if bad and r.random() < 0.9 else ""
        rows.append((k, f"http://{host}/{'x/' * r.randint(0, 4)}{query}", int(bad) if k % 4 else None, int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label int, truth int")
    truth = {k: t for k, _, label, t in rows if label is None}
    got = [x for x in U.filter_urls(df, rules=[], label_col="label").collect() if x.page_id in truth]
    assert sum((x.verdict == "block") == (truth[x.page_id] == 1) for x in got) / len(got) > 0.9
    again = {x.page_id: x.score for x in U.filter_urls(df.repartition(7), rules=[], label_col="label").collect()}
    assert all(again[x.page_id] == x.score for x in got)


def test_features(spark):
    df = spark.createDataFrame([("http://ab.org/a/b?x=1&y=2",)], "url string")
    host, path = U.parts(F.col("url"))
    r = U.lexical(df.withColumns({"host": host, "path": path})).first()
    u = "http://ab.org/a/b?x=1&y=2"
    assert (r.url_length, r.host_length, r.path_length, r.path_depth, r.host_depth, r.parameters) == (len(u), 6, 4, 2, 1, 2)
    assert math.isclose(r.entropy, -sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u)), abs_tol=1e-6)
    assert math.isclose(r.digit_share, 2 / len(u)) and r.suffix == "org"
