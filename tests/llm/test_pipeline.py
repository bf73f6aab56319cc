"""Pipeline: each stage keeps the columns, its decisions take effect, and the last packs what is left."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from test_pii import brute as brute_pii
from test_simhash import brute_components, brute_fp

import corpus_pipeline
from matchlake.llm.common import AZ
from matchlake.llm.pii import sanitise

SF0001 = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, None, "src0", None), (10_001, "12 ..!", "en", "src0", 6),
                                   (10_002, "12 ..!", "en", None, 6)], docs.schema)
    docs = docs.unionByName(extra).coalesce(3)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash", "pii", "packing"]
    left = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF0001).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "packing":
            break
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert set(left) - set(got) == {10_000, 10_001, 10_002}
        elif name == "exact_dedup":
            best = {}
            for i, r in left.items():
                t = (r.text or "").translate(AZ)
                best[t] = max(i, best.get(t, i))
            assert set(got) == set(best.values())
        elif name == "simhash":
            fp = {i: brute_fp(r.text) for i, r in left.items()}
            comp, best = brute_components(list(fp.values())), {}
            for i, f in fp.items():
                best[comp[f]] = min(i, best.get(comp[f], i))
            assert set(got) == set(best.values())
        else:
            assert set(got) == set(left)
            clean = {r.doc_id: r.sanitised for r in sanitise(docs).collect()}
            for i, r in got.items():
                found = brute_pii(left[i].text)
                assert not found or not any(left[i].text[s:e] in r.text for _, s, e in found)
                assert r.n_chars == len(r.text) and r.text == clean[i]
        docs, left = out, got
    from tokenizers import Tokenizer
    library, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(left)
    for i, parts in pieces.items():
        ids = library.encode(left[i].text, add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF0001)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(got.columns)
    assert got.select("doc_id").distinct().count() > 100


def test_empty(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF0001).count() == 0
