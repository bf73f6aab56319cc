"""Mutation testing of the suites on the hand-made frame: golden failure counts and detection."""

from conftest import hand_made

from matchlake.operators import inject, quality, scoring
from matchlake.plans import experiment, suites


def _failures(spark, batch):
    clean = hand_made(spark)
    corrupted, manifest = inject.apply(spark, clean, inject.BATCHES[batch], batch)
    models = experiment.with_features(corrupted)
    res = quality.evaluate(spark, suites.suite_rules("manual_expanded"), models)
    return {(r.test, r.model, r.column): r.failures for r in res.collect()}, manifest


def test_batch_a_goldens(spark):
    f, m = _failures(spark, "batch_A_key_integrity")
    assert f[("not_null", "dim_teams", "team_id")] == 1
    assert f[("not_null", "fct_matches", "match_id")] == 1
    assert f[("unique", "dim_teams", "team_id")] == 1
    assert f[("unique", "fct_matches", "match_id")] == 1
    assert f[("relationships", "fct_matches", "home_team_id")] == 3
    assert f[("relationships", "fct_matches", "away_team_id")] == 4
    targets = {r.anomaly_id: r.target for r in m.collect()}
    assert targets["null_dim_teams_team_id"] == "dim_teams.team_id=101"
    assert targets["duplicate_fct_matches_match_id"] == "fct_matches.match_id=1000"


def test_batch_b_goldens(spark):
    f, _ = _failures(spark, "batch_B_semantic_domain")
    for col in ("home_team_id", "away_team_id", "match_date", "match_status"):
        assert f[("not_null", "fct_matches", col)] == 1
    assert f[("not_null", "dim_teams", "team_name")] == 1
    assert f[("accepted_values", "fct_matches", "match_status")] == 1
    assert f[("relationships", "fct_matches", "home_team_id")] == 0   # NULL child keys are ignored
    assert f[("relationships", "fct_matches", "away_team_id")] == 0


def test_batch_c_sequential_update_hits_inserted_row(spark):
    f, _ = _failures(spark, "batch_C_mixed_full_stack")
    assert f[("not_null", "dim_teams", "team_name")] == 2           # original and duplicate
    assert f[("not_null", "dim_teams", "team_id")] == 1
    assert f[("unique", "dim_teams", "team_id")] == 1
    assert f[("unique", "fct_matches", "match_id")] == 1
    assert f[("not_null", "fct_matches", "home_team_id")] == 1
    assert f[("not_null", "fct_matches", "match_date")] == 1
    assert f[("relationships", "fct_matches", "home_team_id")] == 2
    assert f[("relationships", "fct_matches", "away_team_id")] == 3


def test_detection_matrix_and_gain(spark):
    out = experiment.run(spark, hand_made(spark))
    mx = {(r.batch_id[:7], r.condition): r.detected_count for r in out["matrix"].collect()}
    assert [mx[("batch_A", c)] for c in ("manual_only", "manual_expanded", "manual_plus_llm")] == [4, 4, 4]
    assert [mx[("batch_B", c)] for c in ("manual_only", "manual_expanded", "manual_plus_llm")] == [0, 6, 6]
    assert [mx[("batch_C", c)] for c in ("manual_only", "manual_expanded", "manual_plus_llm")] == [3, 6, 6]
    cov = {r.condition: (r.total_detected, r.total_anomalies) for r in out["coverage"].collect()}
    assert cov == {"manual_only": (7, 16), "manual_expanded": (16, 16), "manual_plus_llm": (16, 16)}
    g = {r.condition: r for r in out["gain"].collect()}["manual_expanded"]
    assert (g.absolute_additional_detections, g.absolute_detection_rate_gain,
            g.relative_detection_count_improvement) == (9, 0.5625, 128.57)


def test_verify_injections_present(spark):
    clean = hand_made(spark)
    specs = inject.BATCHES["batch_C_mixed_full_stack"]
    corrupted, _ = inject.apply(spark, clean, specs, "C")
    assert all(r.present for r in inject.verify(corrupted, specs).collect())
    assert not all(r.present for r in inject.verify(clean, specs).collect())


def test_detection_counts_errors_only_when_asked(spark):
    res = spark.createDataFrame([("b", "x", "not_null", "dim_teams", "team_id", "error")],
                                "batch_id string, condition string, test string, model string, column string, status string")
    man = spark.createDataFrame([("b", "null_dim_teams_team_id")], "batch_id string, anomaly_id string")
    conds = spark.createDataFrame([("b", "x")], "batch_id string, condition string")
    det = scoring.detectors_frame(spark, suites.DETECTORS)
    assert scoring.detections(res, man, det, conds).first().detected
    assert not scoring.detections(res, man, det, conds, count_errors=False).first().detected
