"""Multi-index hashing against all distances."""

import numpy as np

from matchlake.llm.hamming_topk import search, segments, steps, widths

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int"


def brute(rows, queries, k):
    code = lambda v: sum(1 << i for i, x in enumerate(v) if x is not None and x > 0)
    data = sorted({(code(v), i) for i, v, *_ in rows if v is not None and i is not None})
    out = set()
    for i, v, *_ in queries:
        if v is None or i is None:
            continue
        for r, (d, j) in enumerate(sorted(((code(v) ^ x).bit_count(), j) for x, j in data)[:k]):
            out.add((i, r + 1, j, d))
    return out


def test_schedule():
    for m in (1, 3, 6, 16):
        assert sum(widths(m)) == 64 and len(set(steps(m))) == sum(x + 1 for x in widths(m))
    assert segments(50_000, 10) >= segments(10 ** 9, 10) >= 2


def check(spark, rows, queries, k):
    data = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = search(data, spark.createDataFrame(queries, SCHEMA), k=k)
    res = [tuple(r) for r in got.collect()]
    assert got.columns == ["query_id", "rank", "neighbor_id", "distance"]
    assert set(res) == brute(rows, queries, k) and len(res) == len(set(res))


def test_equals_all_distances(spark):
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(6, 64))
    vec = [(centre[i % 6] + rnd.normal(size=64) * rnd.choice([0.1, 0.6, 2.0])).tolist() for i in range(300)]
    rows = [(i, v, 0, 1) for i, v in enumerate(vec)] + [(1000 + i, vec[0], 0, 1) for i in range(40)]     # a very common vector
    rows += [(7, vec[7], 0, 1), (None, vec[3], 0, 1), (2000, None, 0, 1), (2001, [], 0, 1), (2002, [None, 1.0], 0, 1)]
    check(spark, rows, rows[::9] + rows[-6:], 5)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(i, [1.0, -1.0, float(i)], 0, 1) for i in range(4)]
    check(spark, rows, rows[:2], 10)
    empty = spark.createDataFrame([], SCHEMA)
    assert search(empty, spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert search(spark.createDataFrame(rows, SCHEMA), empty).count() == 0
