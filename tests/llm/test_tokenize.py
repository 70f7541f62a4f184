import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlspike.llm import tokenize as tk


@pytest.fixture(scope="module")
def codec():
    return tk.PieceCodec(tk.serialise_model(tk.read_ranks(tk.VOCABULARY)))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tk.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_public_encoder_and_round_trips(text):
    codec, ref = _pair()
    assert codec.encode(text) == ref.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text


_memo = []


def _pair():
    if not _memo:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tk.VOCABULARY, "rb"))}
        _memo.append((tk.PieceCodec(tk.serialise_model(tk.read_ranks(tk.VOCABULARY))), tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})))
    return _memo[0]


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|> and \x00\x1c\x85", "a" * 50_000, "Ünïcode 漢字 🙂\r\n\t  x", "​﻿|　", "don't we'll I'M"])
def test_edges(codec, reference, text):
    assert codec.encode(text) == reference.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 1), (3, "", 2), (None, "x", 3), (1, "hello world", 0)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in tk.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (None, [87])], key=str)
    assert tk.encode_corpus(df.limit(0)).count() == 0
