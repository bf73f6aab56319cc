"""Rank-synchronous merging against the tokenizer libraries themselves."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from matchlake.llm import bpe
from matchlake.llm.token_counts import count_texts, op9_token_counts, token_counts

SF0001 = "/root/testdata/sf0.001"
ODD = ["", " ", "   a  b ", "\t\n x\n\n  y", "<s> </s> <unk> <0x41>", "日本語のテキスト 😀😀 é ﬁ", "▁a ▁ b▁ ", "a▁ b  ▁▁▁",
       "a" * 9000, "ab" * 5000 + " " + "xyz" * 100, "0123456789" * 30, "...!!!???", "\x00\x01 ​﻿", "naïve café Ünïcödé",
       "thereththethe " * 50, "aaaaaaa aaaaaaaa aaaaaaaaa abababab"]


def noise(seed, n, chars):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_equals_the_library(sp):
    vocab = bpe.load("pieces", P.path("piece_bpe_32k.model"))
    texts = ODD + noise(1, 2000, "abcdefthe  rnioqz.,\n") + noise(2, 500, "aé日😀▁ ́xX0") + noise(3, 300, "aab")
    got = count_texts(vocab, texts, {})
    want = [len(sp.encode(t)) for t in texts]
    assert got == want


def test_long_and_short_merges_agree(monkeypatch):
    vocab = bpe.load("bytes", P.path("byte_bpe_50k.tiktoken"))
    words = noise(4, 300, "abcdethe") + ["", "x"]
    a = vocab.encode(words)
    monkeypatch.setattr(bpe, "LONG", 3)
    b = vocab.encode(words)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_rows(spark, sp):
    df = spark.createDataFrame([(1, "hello there", 5, "x"), (1, "hello there", 5, "x"), (None, None, None, None)],
                               "doc_id bigint, text string, N_TOKENS int, lang string")
    got = token_counts(df, P.path("piece_bpe_32k.model"), limit=1).collect()
    n = len(sp.encode("hello there"))
    assert [tuple(r) for r in got] == [(1, "hello there", "x", 11, n, n > 1)] * 2 + [(None, None, None, 0, 0, False)]
    assert token_counts(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_query(spark, sp):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op9_token_counts(spark, SF0001).collect()}
    for d in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect():
        n = len(sp.encode(d.text))
        assert got[d.doc_id] == (len(d.text.encode()), n, n > 4096)
