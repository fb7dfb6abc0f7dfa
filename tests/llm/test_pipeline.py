import hashlib

import public_tokenizers
import pytest
from test_decontaminate import brute as contained
from test_jaccard_join import brute as linked
from tokenizers import Tokenizer

import corpus_pipeline as C
from leafmill.llm import quality as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, written and reread as the contract says."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        seen.append(docs.collect())
    return seen


def test_stages_are_as_listed():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "repeats", "contamination", "tokens"] and C.ORACLE_SQL is None


def test_quality_stage_follows_the_classifier(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = Q.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in Q.quality_scores(docs, forest).collect() if r.predicted == 1}
    assert {r.doc_id for r in stages[1]} == kept and 0 < len(kept) < len(stages[0])


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    assert {r.doc_id for r in stages[2]} == {i for i, _, c in linked(rows, 5, 80, 100) if i == c}


def test_repeat_stage_cuts_bytes(stages):
    want = trimmed([(r.doc_id, r.text) for r in stages[2]])
    assert sorted((r.doc_id, r.text) for r in stages[3]) == sorted(want)
    before = {r.doc_id: r for r in stages[2]}
    assert all(r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars) for r in stages[3])


def trimmed(rows, window=100):
    """Straight from the rule: characters that a repeated byte string touches go."""
    seen, out = set(), []
    for i, t in sorted(rows):
        b = t.encode()
        cover = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if b[k : k + window] in seen:
                cover[k : k + window] = b"\1" * window
            seen.add(b[k : k + window])
        at, kept = 0, ""
        for c in t:
            size = len(c.encode())
            kept += "" if any(cover[at : at + size]) else c
            at += size
        out.append((i, kept))
    return out


def odd(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cut_id long, cut_text string, tag string, id string, rest int, removed int")


def test_stages_lose_no_text(spark):
    a, b, c = (f"{w} " + " ".join(f"{w}{k * 7919 % 101}" for k in range(60)) for w in ("first", "second", "third"))
    shared = "".join(chr(0x100 + k) for k in range(70))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, "a wholly different text " + b[::-1]), (4, "genuine \ufffd mark " + "x" * 20 + " tail \ufffd."), (None, a), (5, None), (6, "A" + shared), (7, "\ufffdBB" + shared + "\ufffd"), (8, b[:50])]
    rows = [(i, t, 7, 1, "z", "t", "i", 5, 6) for i, t in rows]
    docs = odd(spark, rows)
    kept = C.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd(spark, [r for r in rows if r[1] != a + " more"]).collect()))
    cut = C.repeats(spark, docs, SF)
    got = {(r.doc_id, r.text): r.n_chars for r in cut.collect()}
    assert cut.columns == docs.columns and len(got) == len(rows)
    texts = {t for _, t in got}
    assert {a, b, c, None, "a wholly different text " + b[::-1], "genuine \ufffd mark " + "x" * 20 + " tail \ufffd."} <= texts
    assert (2, " more") in got or (2, a[-1:] + " more") in got
    assert got[7, "\ufffdBB\ufffd"] == 4 and got[6, "A" + shared] == 7
    assert all(tuple(r)[3:] == (1, "z", "t", "i", 5, 6) for r in cut.collect())


def test_contamination_stage_drops_documents_with_items(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, *_ in contained([(r.doc_id, r.text) for r in stages[3]], items, 5, 0.8)}
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]} - hit


def test_token_stage_matches_the_library(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in stages[4]}
    assert {r.doc_id for r in stages[5]} == set(text)
    for r in stages[5]:
        assert r.ids == t.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_columns_stay(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(s[0].asDict()) == columns for s in stages[:5])


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "a b c d e f g", "en", "s", 13), (3, "x " * 60_000, "en", "s", 120_000), (3, "x " * 60_000, "en", "s", 120_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[1:]:
        out = stage(spark, docs, SF)
        assert out.count() >= 3 and stage(spark, docs.limit(0), SF).count() == 0
