"""Token files: exact round trips, damage, and the query against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchlake.llm import token_files as T
from matchlake.llm.token_files import Frame, decode_blocks, decode_frames, encode_blocks, make_frame, op13_token_files, read_tokens, write_tokens

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, ids string, source string"


def blocks(symbols):
    rng = np.random.default_rng(symbols)
    return [rng.integers(0, symbols, n) for n in (1, 2, 31, 32, 33, 700, 2048)] + [
        np.minimum(rng.zipf(1.3, 2000) - 1, symbols - 1), np.zeros(2048, int), np.full(500, symbols - 1), np.tile([symbols - 1, 0, 0], 300)]


@pytest.mark.parametrize("symbols", [1, 2, 300, 50257, 900_000])
def test_round_trip(symbols, monkeypatch):
    for lanes in (1024, 3):
        monkeypatch.setattr(T, "LANES", lanes)
        given = blocks(symbols)
        words = encode_blocks(given, symbols)
        back = decode_blocks([np.frombuffer(w, "<u4") for w in words], [len(b) for b in given], symbols)
        assert all((a == b).all() for a, b in zip(given, back, strict=True))


def test_blocks_do_not_depend_on_their_neighbours():
    given = blocks(300)
    assert encode_blocks(given, 300) == [encode_blocks([b], 300)[0] for b in given]


def test_repetition_is_predicted():
    phrase = np.tile(np.random.default_rng(0).integers(0, 50257, 20), 100)
    assert len(encode_blocks([phrase], 50257)[0]) * 8 / len(phrase) < 1.5


def test_frames_show_damage():
    ids = np.random.default_rng(1).integers(0, 256, 9000)
    made = make_frame(3, 7, 11, [5, None], np.array([4000, 5000]), ids, 256)
    f = Frame(made)
    assert (f.part, f.number, f.before, f.n_ids) == (3, 7, 11, 9000) and f.ids.to_pylist() == [5, None] and f.lengths.tolist() == [4000, 5000]
    assert (decode_frames([f, Frame(made)], 256)[1] == ids).all()
    for at in (T.HEAD.size + 2, len(made) // 2, len(made) - 1):
        broken = bytearray(made)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            Frame(bytes(broken))


def test_mark_is_avoided(monkeypatch):
    ids = np.arange(500) % 7
    plain = make_frame(0, 0, 0, [1], np.array([500]), ids, 7)
    at = next(i for i in range(T.HEAD.size, len(plain) - 3) if all(c < 128 for c in plain[i:i + 3]))
    monkeypatch.setattr(T, "MARK", plain[at:at + 3].decode())
    other = make_frame(0, 0, 0, [1], np.array([500]), ids, 7)
    assert T.MARK.encode() not in other and (decode_frames([Frame(other)], 7)[0] == ids).all()


def rows():
    r = [(i * 7 % 50, f"Text {i}, it's {'word ' * (i % 40)}Größe 東京 \n\n x", "clash", "s") for i in range(50)]
    r += [(7, "same", None, "s")] * 30 + [(None, "no id", None, None), (60, None, None, None), (61, "", None, "x"), (-5, "<|endoftext|> inside <|", "y", "z")]
    return r + [(62, "long Text number 12 " * 4000, None, None)]


def expected(data):
    tk = Tokenizer.from_file(VOCABULARY)
    ids = [tk.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in data]
    made = sorted(((i is not None, i, x) for (i, *_), x in zip(data, ids, strict=True)), key=lambda r: r[:2])
    return [(i, np.array(x, "<u4").tobytes()) for _, i, x in made]


def test_files_hold_all_texts_in_order(spark, tmp_path):
    data = rows()
    path = str(tmp_path / "tokens")
    write_tokens(spark.createDataFrame(data, SCHEMA).repartition(5), path, VOCABULARY, RANKS)
    got = read_tokens(spark, path, 50257).orderBy("start").collect()
    want = expected(data)
    assert [r.doc_id for r in got] == [i for i, _ in want]                        # ascending; ties by a hash of the text
    assert sorted([(r.doc_id, bytes(r.ids)) for r in got], key=str) == sorted(want, key=str)
    sizes = [len(r.ids) // 4 for r in got]
    assert [r.n_tokens for r in got] == sizes and [r.start for r in got] == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    write_tokens(spark.createDataFrame([], SCHEMA), path, VOCABULARY, RANKS)
    assert read_tokens(spark, path, 50257).count() == 0


def test_query_equals_the_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    start, want = 0, []
    for i, ids in expected(docs):
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = op13_token_files(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_counts_equal_a_plain_loop():
    from matchlake.llm.token_files import STEP, Counts
    rnd, symbols = np.random.default_rng(6), 11
    for t in (0, 1, 31, 32, 33, 64):
        seen = rnd.integers(0, symbols, (5, t)) * (rnd.random((5, t)) < 0.6)
        counts, total = Counts(seen, symbols), symbols + STEP * t
        for lane in range(5):
            n = 1 + STEP * np.bincount(seen[lane].astype(int), minlength=symbols)
            low = np.cumsum(n) - n
            rows = np.full(symbols, lane)
            assert [a.tolist() for a in counts.share(rows, np.arange(symbols))] == [low.tolist(), n.tolist()]
            assert counts.low is None                       # coding looks no value up and builds nothing for it
        for lane in range(5):
            n = 1 + STEP * np.bincount(seen[lane].astype(int), minlength=symbols)
            want = np.repeat(np.arange(symbols), n)
            x, low, f = counts.find(np.full(total, lane), np.arange(total))
            assert x.tolist() == want.tolist() and low.tolist() == (np.cumsum(n) - n)[want].tolist() and f.tolist() == n[want].tolist()
            counts.low = None


def test_frames_coded_together_are_the_frames_coded_alone():
    rng = np.random.default_rng(8)
    given = [(k, 10 * k, [k, None], np.array([n, 5]), np.minimum(rng.zipf(1.4, n + 5), 999)) for k, n in enumerate((1, 3000, 2043, 9000))]
    together = list(T.make_frames(4, given, 1000))
    assert together == [make_frame(4, *g, 1000) for g in given]
    assert [d.tolist() for d in decode_frames([Frame(x) for x in together], 1000)] == [g[-1].tolist() for g in given]


def test_files_are_as_before():
    """Words of the first version of the coder: files written then can be read."""
    rng = np.random.default_rng(3)
    given = [np.minimum(rng.zipf(1.2, n) - 1, 50256) for n in (2048, 2048, 1500, 40, 1)]
    assert [zlib.crc32(w) for w in encode_blocks(given, 50257)] == [3260315841, 498319973, 3373144439, 3811608177, 75568507]


def test_shares_equal_counts():
    rng = np.random.default_rng(5)
    for lanes, longest, rows in ((3, 1, 1), (20, 500, 2000), (9, 2048, 4096)):
        T_at_once, T.AT_ONCE = T.AT_ONCE, rows
        ids, epochs = np.minimum(rng.zipf(1.3, (lanes, longest)), 2999), T._epochs(longest)
        share = T._shares(ids.astype(np.int32), epochs)
        T.AT_ONCE = T_at_once
        for begin, end in zip(epochs, [*epochs[1:], longest], strict=True):
            lane = np.repeat(np.arange(lanes), end - begin)
            low, f = T.Counts(ids[:, :begin], 3000).share(lane, ids[:, begin:end].ravel())
            got = share[begin:end].T.ravel()
            assert (ids[:, begin:end].ravel() + T.STEP * (got >> 12) == low).all() and (1 + T.STEP * (got & 4095) == f).all()
