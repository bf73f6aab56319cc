"""SimHash: hashes against the xxhash library, links and components against all pairs."""

import random
import re

import numpy as np
import xxhash

from matchlake.llm import simhash
from matchlake.llm.simhash import Plan, fingerprints, forest, masks, near_dedup, op5_simhash

SF0001 = "/root/testdata/sf0.001"


def brute_fp(t, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
    if not words:
        return 0
    sh = [b" ".join(words)] if len(words) < k else [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    u = sorted(set(fps))
    arr, root = np.array(u, np.uint64), list(range(len(u)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= bits).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {x: find(i) for i, x in enumerate(u)}


def expect(rows):
    """rows: (id, text) -> sorted (id, hex, component)."""
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps)
    best = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            best[comp[f]] = min(i, best.get(comp[f], i))
    return sorted([(i, f"{f:016x}", best.get(comp[f])) for (i, _), f in zip(rows, fps, strict=True)], key=str)


def sample():
    rnd = random.Random(9)
    vocab = ["alpha", "Beta", "gämma", "d", "extraordinarily", "zeta\x01", "Éta", "x" * 40]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    base = [rnd.choice(vocab) + str(rnd.randint(0, 99)) for _ in range(300)]
    for i in range(260):      # a dense group of near copies
        w = list(base)
        w[rnd.randrange(300)] = f"w{rnd.randint(0, 9)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, rows[5][1]) for i in range(50)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n\x0b"), (None, "null id"), (None, "null id"), (3003, "long " * 20000), (3003, "long " * 20000)]
    return rows


def test_fingerprints():
    texts = [t or "" for _, t in sample()] + ["a b c", "a b c d", "one", "A B \x1c c", "w " * 3 + "y" * 1000]
    assert fingerprints(texts, 4).tolist() == [brute_fp(t) for t in texts]


def test_pigeonhole_finds_all():
    rnd = np.random.default_rng(2)
    fp = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = fp.copy()
    for k in range(4):
        near ^= np.uint64(1) << rnd.integers(0, 64, 400).astype(np.uint64)
    plan = Plan(rnd.permutation(64).tolist(), 4)
    v = plan.groups(np.concatenate([fp, near]))
    plan.learn(np.stack([np.bincount(v[:, g], minlength=256) for g in range(8)]).astype(float), 800)
    for layout in simhash.LAYOUTS:
        plan.layout = layout
        units, _ = plan.allocate(v[:400], layout)
        assert (units.sum(1) == 5).all()
        found = np.zeros(400, bool)
        for (i, size, a), (_, _, b) in zip(plan.keys(v[:400]), plan.keys(v[400:]), strict=True):
            found |= np.bitwise_count((a ^ b).astype(np.uint64)) < units[:, i]
        assert found.all()


def test_masks_and_forest():
    assert len(masks(16, 2)) == 137 and len(set(masks(8, 8).tolist())) == 256
    x = np.array([0, 1, 3, 1 << 40, (1 << 40) | 15, (1 << 50) - 1], np.uint64)
    a, b = forest(x, x, 4)
    assert len(a) == 4        # two components of 3 and 2 and one alone: joined by (0, 1<<40) too
    assert all(int(p ^ q).bit_count() <= 4 for p, q in zip(a.tolist(), b.tolist(), strict=True))


def test_components_equal_all_pairs(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, KEPT int, fp string").repartition(5)
    want = expect(rows)
    for hot, block in ((128, 2048), (8, 32)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = near_dedup(df)
        assert got.columns == ["doc_id", "text", "fp", "fingerprint", "component_id", "kept"]
        res = got.collect()
        assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in res], key=str) == want
        kept = [r.component_id for r in res if r.kept]
        groups = {r.component_id if r.component_id is not None else "none" for r in res}
        assert len(kept) == len(groups) and all(r.doc_id == r.component_id for r in res if r.kept)


def test_empty(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark):
    src = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op5_simhash(spark, SF0001).collect()], key=str) == expect(src)


def test_rows_without_near_copies(spark, tmp_path):
    from matchlake.llm.simhash import near_dedup, without_near_copies
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(1, None, "x", "y", 3), (1, None, "x", "y", 3)], src.schema)
    both = src.unionByName(extra)
    path = str(tmp_path / "docs")
    both.repartition(3).write.parquet(path)
    for docs in (spark.read.parquet(path), both, both.limit(0)):
        got, want = without_near_copies(docs), near_dedup(docs).filter("kept")
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
