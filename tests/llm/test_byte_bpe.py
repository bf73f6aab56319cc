"""Byte-level BPE against the tiktoken library, and the exact round trip."""

import base64
import hashlib
import random
import uuid

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from matchlake.llm.byte_bpe import decode, encode, op4_byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sample():
    rnd = random.Random(3)
    chars = "abc the'sre   \n\t12é日😀.,!‐²\x1c\xa0"
    out = ["", None, "   ", "a  b", "x\n\n y ", "<|endoftext|>", "ab" * 6000, "It's we'LL ½ Ⅷ", " " * 3000 + "z", "Ω" * 70000]
    return out + ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 200))) for _ in range(300)]


def test_equals_the_library_and_round_trips(spark, library):
    data = [(i % 250, t, "keep", 1.5) for i, t in enumerate(sample())] + [(None, "same", "s", 0.0)] * 2
    df = spark.createDataFrame(data, "doc_id bigint, text string, src string, BYTES double").coalesce(2)
    enc = encode(df, RANKS, P.PATTERN)
    assert enc.columns == ["doc_id", "src", "BYTES", "ids"]
    got = decode(enc.withColumnRenamed("BYTES", "bytes"), RANKS)
    assert got.columns == ["doc_id", "src", "ids", "bytes"]
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, bytes(r.bytes), np.frombuffer(r.ids, "<u4").tolist())
                   for r in got.collect()), key=str)
    want = sorted(((i if i is not None else -1, (t or "").encode(), library.encode_ordinary(t or "")) for i, t, _, _ in data), key=str)
    assert rows == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert decode(encode(df, RANKS, P.PATTERN), RANKS).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in op4_byte_bpe(spark, SF0001).collect()}
    src = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(src)
    for d in src:
        ids = library.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_cutting_twice_gives_the_same_and_notices_other_rows(spark, library, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t) for i, t in enumerate(sample())], "doc_id bigint, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = [sorted(((r.doc_id, bytes(r.ids)) for r in encode(docs, RANKS, P.PATTERN, again=a).collect())) for a in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) == len(sample())
    from pyspark.sql import functions as F
    moving = docs.withColumn("text", F.udf(lambda t: f"{t} {uuid.uuid4()}").asNondeterministic()("text"))
    with pytest.raises(Exception, match="changed between two passes"):
        encode(moving, RANKS, P.PATTERN, again=True).collect()
    assert encode(moving, RANKS, P.PATTERN).count() == len(rows[0])


def test_short_words_merge_as_long_ones_do():
    import pyarrow as pa

    from matchlake.llm import bpe
    vocabulary, rnd = bpe.load("bytes", RANKS), random.Random(9)
    words = ["", "a", "aaaa", "é", " the", "a" * 16, "a" * 17, *("".join(rnd.choice("aehinort sé東") for _ in range(rnd.randint(0, 24))) for _ in range(3000))]
    raw = [w.encode() for w in words]
    flat, n = bpe.merge(vocabulary.table, vocabulary.start[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(r) for r in raw]))
    got = vocabulary.encode(words)
    assert got[0].tolist() == flat.tolist() and got[1].tolist() == n.tolist()
    part = vocabulary.encode_array(pa.array(words).slice(5))
    assert part[0].tolist() == flat[int(n[:5].sum()):].tolist() and part[1].tolist() == n[5:].tolist()
