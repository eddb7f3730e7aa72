import hashlib

import numpy as np
import pytest

from tests.llm.conftest import make_docs
from textloom.llm import bpe


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


TEXTS = [
    "", None, "   \n\t", "Hello, WORLD! it's we'll 123 4.5", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>c", "é ́x ÅÅ ﬁ İ ΣΣ", "a\x1cb\x1dc \x1f d\x85e f　g​h﻿",
    "\U0001f600 \U0001f468‍\U0001f469 你好 สวัสดี ال", "word " * 3000, "x" * 5000, "'s 't 're'S", "\x00\x01 nul", "tab\tseparated\r\nlines",
]


def test_round_trip(spark, tokenizer, prose):
    pairs = [*enumerate(TEXTS + [prose(200, k) for k in range(20)]), (None, "no id"), (3, "twice"), (3, "twice")]
    for size in (64 << 20, 300):
        got = sorted((tuple(r) for r in bpe.encode_decode(make_docs(spark, pairs).repartition(3), block_bytes=size).collect()), key=str)
        assert got == sorted(((i, *expected(tokenizer, x)) for i, x in pairs), key=str)


def test_empty_tables(spark):
    assert bpe.encode_decode(make_docs(spark, [])).count() == 0
    assert [tuple(r)[:2] for r in bpe.encode_decode(make_docs(spark, [(1, None)])).collect()] == [(1, 0)]


def test_split_words_joins_to_the_whole(tokenizer):
    for x in TEXTS:
        whole = tokenizer.encode(x or "", add_special_tokens=False).ids
        assert [i for w in bpe.split_words(x or "") for i in tokenizer.encode(w, add_special_tokens=False).ids] == whole


def test_packed_integers():
    for x in ([], [0], [1, 70_000, 4_294_967_295]):
        assert bpe.unpack_ints(bpe.pack_ints(np.array(x, "<u4"))).tolist() == x
