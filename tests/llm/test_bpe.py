import random

import public_tokenizers
from tokenizers import Tokenizer

from leafmill.llm.bpe import Codec, bpe_round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(3)
    yield from [None, "", " ", "\n\n  \t x", "a", "Hello world's isn't I'LL we've", "été naïve ÀÉ 北京 🙂🙂 １２３ ٣٤ x²", "   trailing   ", "\r\n\x0b\x0c\x1c\x1f\x85\xa0 ​﻿ x　y"]
    yield from ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "\0added <|endoftext|>", "\0added x", "x" * 3000, "ab" * 700, "=" * 999 + "-" * 1000, " " * 500 + "q"]
    letters = "abcdefghijklmnopqrstuvwxyzABC  ,.;'\n\t0123456789éüñß#$%&*|—漢字"
    for _ in range(300):
        yield "".join(r.choice(letters) for _ in range(r.randint(1, 400)))
    syllables = ["th", "er", "on", "an", "re", "tion", "ing", "heit", "ment"]
    for _ in range(200):
        yield " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 30)))
    for _ in range(100):
        yield "".join(chr(r.choice([r.randint(1, 0x250), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(50))


def test_ids_and_decoding_match_the_library(spark):
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded").repartition(3)
    t = Tokenizer.from_file(PATH)
    want = sorted(((i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows), key=str)
    got = bpe_round_trip(df, PATH).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    plain = sorted(((i, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, x in rows), key=str)
    assert sorted(((r.doc_id, r.decoded) for r in got), key=str) == plain
    assert bpe_round_trip(df.limit(0), PATH).count() == 0


def test_long_pieces_and_forgetting():
    with open(PATH, encoding="utf-8") as f:
        codec = Codec(f.read())
    t = Tokenizer.from_file(PATH)
    r = random.Random(9)
    for _ in range(30):
        x = "".join(r.choice("etaonih") for _ in range(r.randint(60, 400)))
        flat, size = codec.encode_many([x])
        assert flat.tolist() == t.encode(x, add_special_tokens=False).ids and size.tolist() == [len(flat)]
    codec.forget()
    flat, size = codec.encode_many(["one two", "", "three"])
    assert size.tolist() == [2, 0, 1]
    assert [x.decode() for x in codec.decode_many(flat, size)] == ["one two", "", "three"]


def test_decoding_broken_sequences():
    with open(PATH, encoding="utf-8") as f:
        codec = Codec(f.read())
    flat, size = codec.encode_many(["é"])
    assert codec.decode_many(flat[:1], [1])[0].decode() in ("é", "�")


def test_descriptions_that_ask_for_more_are_refused():
    import json

    import pytest

    from leafmill.llm.bpe import Codec

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    for change in ({"model": {"dropout": 0.1}}, {"model": {"ignore_merges": True}}, {"added_tokens": [{"id": 0, "content": "x", "lstrip": True}]}):
        new = spec | {k: (spec["model"] | v if k == "model" else v) for k, v in change.items()}
        with pytest.raises(ValueError):
            Codec(json.dumps(new))
