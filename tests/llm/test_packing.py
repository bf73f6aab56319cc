"""Packing: every id exactly once, full windows, mixture kept; ids against the library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from matchlake.llm.packing import Mixture, WordTokenizer, _serve, pack, packed_pieces

VOCAB = P.path("word_bpe_49k.json")
ODD = ["", "It's  we'll 12 a", "Ünï ÀÉ ß ÿ Ÿ", "<|endoftext|> x", "日本 ² ½ µ ª", "é x", "a\x1cb\x85c\xa0d", "İ Σας", "...'s!!'ve “q” – …"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCAB)


def test_ids_equal_the_library(library):
    texts = ODD + [f"{a} {b}!" for a in ODD for b in ODD] + [" ".join(["thereof", "ab" * 40, "x" * 5000])]
    flat, n = WordTokenizer(VOCAB).encode(texts, 1)
    got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def check(library, rows, data, window):
    """rows: pieces; data: (doc_id, text)."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    sizes = []
    for s in sorted(by_seq):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(x == window for x in sizes[:-1]) and 0 < sizes[-1] <= window
    return by_seq


def test_whole_and_mixed(spark, library):
    data = [(i, "word " * (5 + 13 * (i % 9)) + ODD[i % len(ODD)], ["hot", "hot", "a", None, "b"][i % 5], 1) for i in range(120)]
    data += [(500, None, "a", 1), (501, "", "tiny", 1), (502, "x " * 9000, "hot", 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, pieces int").repartition(5)
    for weights in (None, {"hot": 1.0, "a": 3.0}):
        seq = pack(df, VOCAB, weights=weights, window=64, lane_windows=4)
        by_seq = check(library, packed_pieces(seq).collect(), [(d[0], d[1]) for d in data], 64)
        if weights is None:   # each window holds the hot source's share of all tokens, to a token or two
            source = {d[0]: d[2] or "" for d in data}
            total = sum(r.length for s in by_seq.values() for r in s)
            share = sum(r.length for s in by_seq.values() for r in s if source[r.doc_id] == "hot") / total
            for s in list(by_seq)[:-1]:
                got = sum(r.length for r in by_seq[s] if source[r.doc_id] == "hot")
                if sum(r.length for r in by_seq[s]) == 64:
                    assert abs(got - 64 * share) <= 3
        for r in seq.collect():
            assert len(r.input_ids) == 4 * r.n_tokens
            assert r.padded == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 64)


def test_many_sources_and_repeats(spark, library):
    df = spark.createDataFrame([(7, "same text here", "s", 0)] * 3, "doc_id bigint, text string, source string, x int")
    got = packed_pieces(pack(df, VOCAB, window=8, lane_windows=2)).collect()
    n = len(library.encode("same text here", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got) == 3 * n
    df = spark.createDataFrame([(i, f"text {i}", f"s{i}") for i in range(60)], "doc_id bigint, text string, source string")
    check(library, packed_pieces(pack(df, VOCAB, window=16, lane_windows=2)).collect(), [(i, f"text {i}") for i in range(60)], 16)
    assert pack(df.limit(0), VOCAB).count() == 0


def test_deficits_carry():
    mix = Mixture([700, 200, 99, 1], [700, 200, 99, 1])
    cuts = mix.cuts(np.arange(0, 1001, 40))
    assert (np.diff(cuts, axis=0) >= 0).all() and (cuts.sum(1) == np.arange(0, 1001, 40)).all()
    for lane in range(25):
        served = _serve(mix, lane, 4, 10, cuts[lane + 1] - cuts[lane])
        assert (served.sum(1) == 10).all()
        run = cuts[lane] + np.cumsum(served, 0)
        assert np.abs(run - mix.fluid(40 * lane + 10 * np.arange(1, 5))).max() < 2


def test_target_proportions_must_be_positive(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id bigint, text string, source string")
    for w in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="positive"):
            pack(df, VOCAB, weights={"s": w})
