import tempfile

from conftest import SF0001
from pyspark.sql import functions as F

from matchlake.plans import marts
from matchlake.sources import events as ev
from matchlake.sources.tables import Tables
from matchlake.streaming import incremental as inc


def test_stream_incremental_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="matchlake-stream-")
    e = ev.event_rows(Tables(spark, SF0001))
    e.filter(F.col("dateEvent") <= "1998-12-31").write.parquet(f"{d}/src/a")
    inc.start(spark, f"{d}/src", f"{d}/tgt", f"{d}/ck").awaitTermination()
    first = inc.current(spark, f"{d}/tgt").count()
    e.filter(F.col("dateEvent") > "1998-12-31").write.parquet(f"{d}/src/b")
    inc.start(spark, f"{d}/src", f"{d}/tgt", f"{d}/ck").awaitTermination()
    got = inc.current(spark, f"{d}/tgt")
    full = marts.fct_matches(ev.staged(e))
    assert 0 < first < got.count()
    assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0


def test_incremental_watermark_and_upsert(spark):
    import datetime as dt
    schema = "match_id bigint, match_date date, v int"
    target = spark.createDataFrame([(1, dt.date(2024, 1, 1), 0), (2, dt.date(2024, 1, 5), 0)], schema)
    new = spark.createDataFrame([(2, dt.date(2024, 1, 5), 9), (3, dt.date(2024, 1, 6), 1),
                                 (3, dt.date(2024, 1, 6), 2)], schema)
    b = marts.incremental_batch(new, target)                  # same-day late row (id 2) is dropped
    assert sorted(r.match_id for r in b.collect()) == [3, 3]
    out = {r.match_id: r.v for r in marts.upsert(target, b, "match_id", prefer=["v"]).collect()}
    assert out == {1: 0, 2: 0, 3: 2}                          # batch de-duplicated by key first
    inc_ = marts.incremental_batch(new, target, inclusive=True)
    assert sorted(r.match_id for r in inc_.collect()) == [2, 3, 3]
    empty = spark.createDataFrame([], schema)
    assert marts.incremental_batch(new, empty).count() == 3   # NULL watermark -> full load
    assert marts.incremental_batch(new, target, full_refresh=True).count() == 3


def test_classifier_shapes(spark):
    from matchlake.operators import ml
    from matchlake.plans import predict
    feat = predict.features(spark, "/root/testdata/sf0.01").cache()
    model, metrics = ml.train_evaluate(feat, num_trees=20)
    m = metrics.first()
    assert 0 <= m.accuracy <= 1 and m.n_test > 0 and m.n_train > m.n_test
    scores = ml.class_probabilities(model, predict.pair_features(feat)).collect()
    assert scores and all(abs(r.p_home_win + r.p_away_win + r.p_draw - 1) < 1e-6 for r in scores)
    assert all(r.home_team_id != r.away_team_id for r in scores)
