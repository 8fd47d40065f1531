import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldloom.llm import bpe
from fieldloom.llm.registry import tokenizer_path

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary.load(PATH)
MERGER = bpe.Merger(VOCABULARY)
TEXTS = [None, "", " \n ", "Hello, it's the WORLD's 42nd  test!", "ΟΔΟΣ Σ İstanbul é", "a" * 3000 + " " + "lorem" * 2000, "x<|endoftext|>y <|startoftext|>", "\x1c a\x1db \x85\xa0c", "中文 😀 ॐ Ꟈ Ա"] * 3


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_matches_the_library(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode_decode(df, PATH, lexicon_words=7).collect()}
    for i, t in enumerate(TEXTS):
        assert (np.frombuffer(bytes(got[i].ids), "<u4").tolist(), got[i].decoded) == library(t)
    assert got[None].decoded == library("null id")[1] and len(got) == len(TEXTS) + 1


def test_empty(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    ids = [i for c in bpe.chunks_of(text) for w in MERGER.split(c) for i in MERGER.ids(w)]
    assert ids == library(text)[0]


def test_transducer_is_minimal_and_exact():
    words = {w: MERGER.ids(w) for w in ["thing", "things", "ring", "rings", "ringing", "été", "a", "<|endoftext|>"]}
    data = bpe.compile_lexicon(words)
    lexicon = bpe.Lexicon(data)
    for w, ids in words.items():
        assert np.frombuffer(lexicon.get(w), "<u4").tolist() == ids
    assert [lexicon.get(w) for w in ("", "thin", "thingss", "zebra", "ét")] == [None] * 5
    assert len(lexicon.final) < sum(map(len, words)) / 2 + 10  # suffixes are shared
    assert lexicon.get("a") is not None and bpe.Lexicon(bpe.compile_lexicon({})).get("a") is None
