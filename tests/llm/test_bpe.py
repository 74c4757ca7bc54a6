"""Ids against the public library, decoding, and the verification step."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hebbspark.llm import bpe as T

PATH = os.path.join(T.TOKENIZERS, "byte_bpe_50k.json")
ENCODER = T.Encoder.read(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


SAMPLES = [
    "",
    " ",
    "\n\n\t x",
    "<|endoftext|>",
    "Hello world, it's 3.14 o'clock!!",
    "Ünïcödé naïve façade — ¿Dónde quedó?",
    "日本語テキスト и русский",
    "a\x1cb\x1d c\x85d ​e﻿",
    "\U0001f600\U0001f468‍\U0001f469",
    "Â¿DÃ³nde quedÃ³",
    " " * 300 + "x",
    "a" * 5000,
    "=" * 300,
    "Thekneebraceandthebloodpressurecameupagainwhen" * 20,
    "x = {'a': [1, 2, 3]}\r\n\treturn x",
]


def test_samples(library):
    got = ENCODER.encode(SAMPLES)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in SAMPLES]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    from tokenizers import Tokenizer

    t = test_any_text.__dict__.setdefault("library", None) or Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    test_any_text.__dict__["library"] = t
    assert ENCODER.encode([text])[0] == t.encode(text, add_special_tokens=False).ids


def test_verified_words_equal_exact_merges():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdehilnorstu -'0123") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words = list(dict.fromkeys(words))
    tokens, of = T.propose(ENCODER.v, words)
    side = [i for i in range(len(of) - 1) if of[i] == of[i + 1]]
    good = T.compatible(ENCODER.v, tokens[side], tokens[[i + 1 for i in side]])
    failing = {int(of[i]) for i, ok in zip(side, good) if not ok}
    listed = [[] for _ in words]
    for t, o in zip(tokens.tolist(), of.tolist()):
        listed[o].append(t)
    for i, w in enumerate(words):
        assert (listed[i] == T.merge_exactly(ENCODER.v, w)) == (i not in failing)


def test_table(spark, library):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", "x"), (1, "one two", "x"), (None, "three", "x"), (9, "y " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    out = T.encoded(df).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in out) == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    sizes = T.encoded(df, only_size=True)
    assert sorted((r.doc_id or 0, r.n) for r in sizes.collect()) == sorted((r.doc_id or 0, len(r.ids)) for r in out)
    assert T.encoded(df.limit(0)).count() == 0


def test_long_words_are_speculated_too(library):
    word = "the quick".replace(" ", "") * 30 + "zq" * 40 + "information" * 12
    e = T.Encoder.read(PATH)
    e.learn([word, "short", "x" * 64, "x" * 65, "abc" * 2000])
    assert all(e.known[w] == library.encode(w, add_special_tokens=False).ids for w in e.known)
    tokens, of = T.propose(e.v, [word.encode(), b"short"])
    assert of.tolist() == sorted(of.tolist()) and T.spelled(e.v, tokens).tobytes() == word.encode() + b"short"
    clean = "information" * 12
    f = T.Encoder.read(PATH)
    f.learn([clean])
    assert f.merged == 0 and f.known[clean] == library.encode(clean, add_special_tokens=False).ids


def test_a_vocabulary_without_some_byte_is_an_error():
    import json

    model = {"vocab": {chr(c): i for i, c in enumerate(range(0x21, 0x7F))}, "merges": []}
    with pytest.raises(ValueError, match="lacks a token"):
        T.Vocabulary(json.dumps({"model": model}))
