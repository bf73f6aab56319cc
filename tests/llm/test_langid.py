"""Language ID: gradients against differences, held-out accuracy, odd rows."""

import zlib

import numpy as np

from matchlake.llm.langid import BiGRU, identify, op10_language_id, stretches, train

SF001 = "/root/testdata/sf0.01"


def test_gradients():
    net = BiGRU(["a", "b", "c"], hidden=5, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw, label, weight = [b"abcde", b"x", b"hello wor"], np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])
    _, grad = net.gradients(raw, label, weight)
    rnd = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(6):
            at = tuple(rnd.integers(0, s) for s in v.shape)
            if k[0] == "x":
                at = (b"abcdehlowrx"[rnd.integers(0, 11)], at[1])
            old = v[at]
            v[at] = old + 1e-3
            up = net.gradients(raw, label, weight)[0]
            v[at] = old - 1e-3
            down = net.gradients(raw, label, weight)[0]
            v[at] = old
            assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-4 + 1e-2 * abs(grad[k][at]), (k, at)


def test_batches_do_not_matter():
    net = BiGRU(["a", "b"], hidden=4)
    raw = [s for w in ["a", "bb", "ccc" * 20, "été"] for s in stretches(w)]
    whole = net.log_probs(raw)[0]
    for i, r in enumerate(raw):
        assert np.allclose(net.log_probs([r])[0][0], whole[i], atol=1e-4)


def test_query_held_out_accuracy(spark):
    src = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = op10_language_id(spark, SF001).collect()
    assert len(got) == len(src)
    right = n = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and src[r.doc_id].lang:
            n += 1
            right += r.lang_pred == src[r.doc_id].lang
    assert right / n > 0.97, (right, n)


def test_rows(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (2, "le chat et le chien", "fr", 2)] * 6,
                               "doc_id bigint, text string, lang string, SCORE int")
    model = train(df, train_words=50)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "", "x", 1), (3, "123 ... ²½", None, 1), (4, "the dog", None, 1),
                                 (4, "the dog", None, 1), (5, "chat " * 30000, None, 1)], df.schema)
    got = identify(odd, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert [r.lang_pred for r in got.collect()] == ["und", "und", "und", "en", "en", "fr"]
    assert train(df.limit(0)) is None and {r.lang_pred for r in identify(odd, None).collect()} == {"und"}
    assert identify(odd.limit(0), model).count() == 0


def test_a_rare_language_is_not_crowded_out(spark):
    common = [(i, " ".join(f"the{c}ing" for c in "abcdefghijklmnop"), "en") for i in range(200)]
    rare = [(1000, "日本語 東京 京都", "ja"), (1001, "Привет мир как дела", "ru")]
    df = spark.createDataFrame(common + rare, "doc_id bigint, text string, lang string")
    model = train(df, train_words=60)
    assert set(model.langs) == {"en", "ja", "ru"}
    got = {r.doc_id: r.lang_pred for r in identify(df, model).collect()}
    assert got[1000] == "ja" and got[1001] == "ru" and got[0] == "en"


def test_forward_pass_equals_a_plain_loop():
    from matchlake.llm.langid import BiGRU, layout, stretches
    net = BiGRU(["a", "b", "c"], 4)
    rnd = np.random.default_rng(3)
    net.p = {k: rnd.normal(0, 0.5, v.shape).astype(np.float32) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    H = net.hidden
    for word in ("ab", "été", "x", "longer"):
        raw = stretches(word)[0]
        x, size = layout([raw])
        codes = x[0][:size[0]].tolist()

        def run(seq, d):
            h, out = np.zeros(H), []
            for c in seq:
                a = net.p[f"x{d}"][c] + np.concatenate([h @ net.p[f"h{d}"][:, :2 * H], np.zeros(H)])
                z, r = sig(a[:H]), sig(a[H:2 * H])
                n = np.tanh(a[2 * H:] + (r * h) @ net.p[f"h{d}"][:, 2 * H:])
                h = (1 - z) * h + z * n
                out.append(h)
            return out
        f, b = run(codes, "f"), run(codes[::-1], "b")[::-1]
        total = np.zeros(3)
        for t in range(1, len(codes) - 1):          # the edges are no bytes of the word
            o = np.concatenate([f[t], b[t]]) @ net.p["out"] + net.p["bias"]
            total += o - np.log(np.exp(o).sum())
        got, n = net.log_probs([raw])
        assert n[0] == len(codes) - 2 and np.allclose(got[0], total, atol=1e-4), word
