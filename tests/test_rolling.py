import datetime as dt
import random

from pyspark.sql import functions as F

from matchlake.operators.rolling import cut, trailing_mean, trailing_mean_plain


def _rows(seed, n=400, entities=3, days=15, null_dates=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(days))
        out.append((rnd.randrange(entities), d, i, rnd.randrange(5), rnd.randrange(4)))
    for j in range(null_dates):
        out.append((0, None, n + j, 1, 2))
    return out


def _cmp(spark, rows, k, chunk_rows=1):
    df = spark.createDataFrame(rows, "e int, d date, id int, a int, b int")
    vals = {"ma": "a", "mb": "b"}
    got = trailing_mean(df, "e", ["d", "id"], vals, k=k, chunk_rows=chunk_rows)
    exp = trailing_mean_plain(df, "e", ["d", "id"], vals, k=k)
    cols = ["e", "d", "id", "a", "b", "ma", "mb"]
    return sorted(map(tuple, got.select(*cols).collect()), key=str), sorted(map(tuple, exp.select(*cols).collect()), key=str)


def test_chunked_equals_plain_window(spark):
    for seed in (1, 2):
        got, exp = _cmp(spark, _rows(seed), 5)
        assert got == exp


def test_sparse_chunks_need_halo_from_several_chunks(spark):
    # one event per day: every halo spans five earlier chunks
    rows = [(7, dt.date(2024, 1, 1) + dt.timedelta(days=i), i, i, 10 - i) for i in range(12)]
    got, exp = _cmp(spark, rows, 5)
    assert got == exp
    first = [r for r in got if r[2] == 0][0]
    assert first[5] is None  # no preceding row -> NULL


def test_other_k_and_chunk_size(spark):
    got, exp = _cmp(spark, _rows(3, n=200, days=40), 3, chunk_rows=20)
    assert got == exp


def test_hot_entity(spark):
    # one entity owns most rows (the skew case the chunking is for)
    rows = _rows(4, n=500, entities=1) + _rows(5, n=20, entities=4)
    rows = [(e, d, i if j < 503 else 10_000 + i, a, b) for j, (e, d, i, a, b) in enumerate(rows)]
    got, exp = _cmp(spark, rows, 5)
    assert got == exp


def test_property_random_inputs(spark):
    """Random entities, dates (with NULLs), values (with NULLs), k and chunking."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    row = st.tuples(st.integers(0, 2) | st.none(), st.one_of(st.none(), st.dates(dt.date(2024, 1, 1), dt.date(2024, 1, 20))),
                    st.integers(0, 10_000), st.integers(0, 6) | st.none(), st.integers(0, 6))

    @settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(row, min_size=1, max_size=60, unique_by=lambda r: r[2]), st.integers(1, 6), st.integers(1, 9))
    def check(rows, k, chunk_rows):
        got, exp = _cmp(spark, rows, k, chunk_rows)
        assert got == exp

    check()


def _largest(df, chunk_rows):
    cut_ = cut(df, "e", ["d", "id"], chunk_rows)
    return cut_.groupBy("_range").count().agg(F.max("count")).first()[0]


def test_ranges_stay_small_beside_one_hot_entity(spark):
    # a third of the rows belong to one entity, the others have one row each
    one = spark.range(60_000).selectExpr("CAST(id + 1 AS INT) e", "DATE'2024-01-01' d", "CAST(id AS INT) id", "1 a", "2 b")
    hot = spark.range(30_000).selectExpr("0 e", "DATE'2015-01-01' + CAST(id % 3000 AS INT) d", "CAST(100000 + id AS INT) id", "1 a", "2 b")
    assert _largest(one.unionByName(hot), 3000) <= 6000
    assert _largest(one.unionByName(hot), 1000) <= 2000


def test_ranges_split_one_day_with_consecutive_ids(spark):
    far = spark.range(30).selectExpr("0 e", "DATE'2024-01-02' d", "CAST(id * 1000000 AS INT) id", "1 a", "2 b")
    hot = spark.range(30_000).selectExpr("0 e", "DATE'2024-01-01' d", "CAST(id AS INT) id", "CAST(id % 7 AS INT) a", "2 b")
    df = far.unionByName(hot)
    assert _largest(df, 1000) <= 2000
    got = trailing_mean(df, "e", ["d", "id"], {"ma": "a", "mb": "b"}, chunk_rows=1000)
    exp = trailing_mean_plain(df, "e", ["d", "id"], {"ma": "a", "mb": "b"}).select(got.columns)
    assert got.exceptAll(exp).isEmpty() and got.count() == 30_030


def test_same_bits_whichever_plan_runs(spark):
    rows = [(0, dt.date(2024, 1, 1), i, 0.1 * i, 1 / (i + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "e int, d date, id int, a double, b double")
    a = trailing_mean(df, "e", ["d", "id"], {"ma": "a", "mb": "b"})
    b = trailing_mean(df, "e", ["d", "id"], {"ma": "a", "mb": "b"}, chunk_rows=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert cut(df, "e", ["d", "id"], 100) is None


def test_many_short_ranges_in_few_tasks(spark):
    """Ranges are counted out inside tasks: the sample of their borders and the tasks do not grow with their number."""
    df = spark.range(20_000).selectExpr("CAST(id % 3 AS INT) e", "DATE'2024-01-01' + CAST(id % 700 AS INT) d", "CAST(id AS INT) id", "CAST(id % 7 AS INT) a", "2 b")
    ranges = cut(df, "e", ["d", "id"], 20)
    assert ranges.select(F.input_file_name()).distinct().count() == 1
    assert ranges.select("_range").distinct().count() == 1000 and _largest(df, 20) == 20
    borders = ranges.groupBy("_range").agg(F.min(F.struct("e", "d", "id")).alias("lo"), F.max(F.struct("e", "d", "id")).alias("hi")).orderBy("_range").collect()
    assert all(tuple(x.hi) < tuple(y.lo) for x, y in zip(borders, borders[1:], strict=False))
    got = trailing_mean(df, "e", ["d", "id"], {"ma": "a", "mb": "b"}, chunk_rows=20)
    exp = trailing_mean_plain(df, "e", ["d", "id"], {"ma": "a", "mb": "b"}).select(got.columns)
    assert got.exceptAll(exp).isEmpty() and got.count() == 20_000
