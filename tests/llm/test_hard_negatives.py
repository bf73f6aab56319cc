"""Hard negatives against a plain loop; residue products against Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import hard_negatives as H
from matchlake.llm.hard_negatives import Residues, mine, primes_for

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string"


@pytest.mark.parametrize("depth,most", [(64, 300), (3, 10 ** 6), (3000, 2000), (1, 2 ** 29), (0, 1), (64, 2 ** 27)])
def test_residue_products_are_exact(depth, most):
    rng = np.random.default_rng(depth)
    a, b = rng.integers(-most, most + 1, (7, depth)), rng.integers(-most, most + 1, (9, depth))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a], dtype=object)
    primes = primes_for(max([sum(int(x) ** 2 for x in r) for r in [*a, *b]]) + 1, depth)
    assert math.prod(primes) > 2 * max(map(abs, want.ravel()), default=0)
    assert all((p // 2) ** 2 * min(max(depth, 1), H.DEPTH) <= H.EXACT for p in primes)
    assert (Residues(a, primes).scores(Residues(b, primes)) == want).all()


def test_share_rounds_exactly():
    for s in (0, 1, -1, 7, 99, 101, 12345, -12345, 2 ** 61 + 3):
        x = np.array([s])
        assert H.share(x, 50, True)[0] == -((-50 * s) // 100) and H.share(x, 95, False)[0] == 95 * s // 100


def brute(data, scale=256, positives=5, negatives=3, low=50, high=95):
    rows = []
    for u, (i, v, label, *_) in enumerate(data):
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((u, i, label, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for u, i, label, q in rows:
        if i % 5:
            continue
        scored = sorted([(-sum(a * b for a, b in zip(q, r, strict=False)), j, k == label) for w, j, k, r in rows if w != u])
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            window = [(-n, m) for n, m, same in scored if not same and low * -s <= 100 * -n <= high * -s]
            out += [(i, j, k + 1, m, -s, n) for k, (n, m) in enumerate(window[:negatives])]
    return sorted(out)


def rows():
    rng = np.random.default_rng(3)
    r = [(i, [float(x) for x in rng.normal(0.4, 1, 6)], int(min(i % 7, 3)), "clash") for i in range(120)]   # one label holds over half
    r += [(200 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 1.0], i % 2, "tie") for i in range(12)]
    r += [(200, [0.5, 0.5, 0.0, 0.0, 0.0, 1.0], 0, "again"), (300, [1.0, 2.0], 1, "short"), (305, [], 1, "none"), (310, [0.0] * 6, 9, "alone")]
    r += [(315, None, 1, "x"), (320, [1.0, None], 1, "x"), (325, [float("nan")], 1, "x"), (330, [float("inf")], 1, "x"), (None, [1.0], 1, "x"), (335, [1.0], None, "x")]
    return r


def test_equals_plain_loop_over_any_cells(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    want = brute(data)
    assert len({x[0] for x in want}) > 20
    assert sorted(map(tuple, mine(df, F.col("vec_id") % 5 == 0).collect())) == want
    monkeypatch.setattr(H, "GROUP", 9)      # many groups of rows and of anchors
    monkeypatch.setattr(H, "TILE", (4, 5))
    assert sorted(map(tuple, mine(df, F.col("vec_id") % 5 == 0).collect())) == want


def test_empty_and_without_anchors(spark):
    assert mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
    some = spark.createDataFrame(rows()[:4], SCHEMA)
    assert mine(some, F.lit(False)).count() == 0
    assert mine(some.limit(1), F.lit(True)).count() == 0
