import datetime as dt

from pyspark.sql import functions as F

from matchlake.operators import rules as RS
from matchlake.operators import runlog


def test_trial_stats_reproduce_published_numbers(spark):
    # Durations of the five published frozen-schema trials.
    trials = spark.createDataFrame([("frozen_schema", d) for d in (74.398, 51.86, 50.954, 50.153, 52.171)] +
                                   [("single", 3.0)], "mode string, duration_seconds double")
    s = {r.mode: r for r in runlog.metric_stats(trials, "mode", ["duration_seconds"]).collect()}
    f = s["frozen_schema"]
    assert (f.n, f.mean, f.std, f.min, f.max) == (5, 55.9072, 9.2725, 50.153, 74.398)
    assert s["single"].std == 0.0


def test_latest_successful_stage_overwrites(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("r", "build", t, t + dt.timedelta(seconds=2), "success", 1),
            ("r", "build", t, t + dt.timedelta(seconds=5), "success", 2),
            ("r", "build", t, t + dt.timedelta(seconds=9), "failed", 3),
            ("r", "test", t, t + dt.timedelta(milliseconds=1500), "success", 4)]
    df = spark.createDataFrame(rows, "run string, stage string, s timestamp, e timestamp, status string, seq int")
    st = runlog.stage_records(df, "run", "stage", "s", "e", "status", "seq")
    latest = {r.stage_name: r.duration_seconds for r in runlog.latest_successful(st).collect()}
    assert latest == {"build": 5.0, "test": 1.5}
    tot = runlog.run_totals(runlog.latest_successful(st)).first()
    assert (tot.stages, tot.total_duration_seconds) == (2, 6.5)


def test_log_parsing(spark):
    lines = spark.createDataFrame([
        ("1 of 3 FAIL 1 not_null_dim_teams_team_id [FAIL 1]",), ("2 of 3 PASS unique_dim_teams_team_id [PASS]",),
        ("3 of 3 FAIL unique_fct_matches_match_id [FAIL]",),
        ("Done. PASS=1 WARN=0 ERROR=2 SKIP=0 NO-OP=0 TOTAL=3",)], "value string")
    assert sorted(r.test_name for r in runlog.failed_tests(lines).collect()) == [
        "not_null_dim_teams_team_id", "unique_fct_matches_match_id"]
    c = {r.counter: r.value for r in runlog.parse_summary(lines).collect()}
    assert c == {"PASS": 1, "WARN": 0, "ERROR": 2, "SKIP": 0, "NO-OP": 0, "TOTAL": 3}


def test_runner_lines_with_clock_times_and_several_logs(spark, tmp_path):
    from matchlake.sources.files import text_lines
    # The shape of a runner's log lines.
    (tmp_path / "a.log").write_text("""00:09:22  Found 4 models, 29 data tests, 1 source, 475 macros
00:09:22  2 of 29 START test not_null_dim_teams_team_name ................ [RUN]
00:09:22  3 of 29 FAIL 1 not_null_dim_teams_team_id ...................... [FAIL 1 in 0.10s]
00:09:22  2 of 29 ERROR unique_fct_training_dataset_match_id ............. [ERROR in 0.14s]
00:09:23  21 of 29 FAIL 6 relationships_fct_matches_away_team_id__team_id__ref_dim_teams_  [FAIL 6 in 0.09s]
00:09:23  8 of 29 PASS not_null_fct_matches_home_team_id ................. [PASS in 0.06s]
00:09:23  Done. PASS=13 WARN=0 ERROR=16 SKIP=0 NO-OP=0 TOTAL=29
""")
    (tmp_path / "b.log").write_text("00:00:01  Found 2 models, 1 data test, 3 sources\n1 of 1 FAIL 2 other_test [FAIL 2]\n")
    lines = text_lines(spark, str(tmp_path))
    name = lambda f: f.rsplit("/", 1)[1]
    assert sorted((name(r.file), r.test_name) for r in runlog.failed_tests(lines).collect()) == [
        ("a.log", "not_null_dim_teams_team_id"), ("a.log", "relationships_fct_matches_away_team_id__team_id__ref_dim_teams_"),
        ("b.log", "other_test")]
    assert {(r.status, r.failures, r.test_name[:8]) for r in runlog.test_lines(lines).collect() if name(r.file) == "a.log"} == {
        ("fail", 1, "not_null"), ("error", None, "unique_f"), ("fail", 6, "relation"), ("pass", None, "not_null")}
    stats = {name(r.file): (r.models, r.data_tests, r.sources) for r in runlog.parse_run_stats(lines).collect()}
    assert stats == {"a.log": (4, 29, 1), "b.log": (2, 1, 3)}
    assert {(name(r.file), r.counter): r.value for r in runlog.parse_summary(lines).collect()}[("a.log", "ERROR")] == 16


def test_latest_by_carries_map_columns(spark, tmp_path):
    from matchlake.operators.latest import latest_by
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", t, t, 1.0, "success", {"n": "1"}), ("s", t, t + dt.timedelta(1), 2.0, "success", {"n": "2"})],
                               runlog.STAGE_SCHEMA)
    assert [r.metadata for r in latest_by(df, ["stage_name"], ["end_ts"]).collect()] == [{"n": "2"}]


def _rules(spark, rows, origin):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "position int, model string, column string, test string, args string") \
        .withColumn("origin", F.lit(origin))


def test_merge_keeps_base_order_and_appends_unseen(spark):
    base = _rules(spark, [("m", "a", "unique", "{}"), ("m", "a", "not_null", "{}")], "baseline")
    new = _rules(spark, [("m", "a", "not_null", "{}"), ("m", "b", "not_null", "{}")], "generated")
    got = sorted((r.priority, r.position, r.column, r.test, r.origin) for r in RS.merge(base, new).collect())
    assert got == [(0, 0, "a", "unique", "baseline"), (0, 1, "a", "not_null", "baseline"),
                   (1, 1, "b", "not_null", "generated")]
    assert [r.column for r in RS.not_in(new, base).collect()] == ["b"]


def test_classification_first_match_wins(spark):
    gen = _rules(spark, [("m", "a", "unique", "{}"), ("m", "b", "not_null", "{}"), ("m", "c", "not_null", "{}"),
                         ("m", "d", "not_null", "{}"), ("m", "e", "not_null", "{}")], "generated")
    merged = gen.filter(F.col("column") != "e")
    base = _rules(spark, [("m", "a", "unique", "{}")], "baseline")
    useful = spark.createDataFrame([("not_null", "m", "b")], "test string, model string, column string")
    fired = spark.createDataFrame([("not_null", "m", "c")], "test string, model string, column string")
    c = {r.column: r.classification_detail for r in RS.classify(gen, merged, base, useful, fired).collect()}
    assert c == {"a": "redundant", "b": "useful", "c": "low_value_fired_no_gain", "d": "low_value_no_evidence",
                 "e": "invalid"}
    s = RS.audit_summary(RS.classify(gen, merged, base, useful, fired)).first()
    assert (s.total, s.useful_count, s.redundant_count, s.low_value_count, s.invalid_count) == (5, 1, 1, 2, 1)
    assert s.useful_pct_of_non_redundant == round(1 / 3, 4)


def test_text_log_stats_and_stage_append(spark, tmp_path):
    from matchlake.sources.files import text_lines
    p = tmp_path / "run.log"
    p.write_text("12:00:01  Found 4 models, 25 data tests, 1 source\n"
                 "12:00:05  1 of 1 PASS unique_dim_teams_team_id [PASS]\n"
                 "12:00:06  Finished running 25 data tests in 0 hours 0 minutes and 3.68 seconds (3.68s).\n")
    r = runlog.parse_run_stats(text_lines(spark, str(p))).first()
    assert (r.models, r.data_tests, r.elapsed_seconds) == (4, 25, 3.68)
    t = dt.datetime(2024, 1, 1)
    rec = spark.createDataFrame([("dbt_run", t, t + dt.timedelta(seconds=6.997), "success", {"models": "4"})],
                                "stage_name string, start_ts timestamp, end_ts timestamp, status string, "
                                "metadata map<string,string>")
    path = str(tmp_path / "stages")
    assert runlog.read_stages(spark, path).count() == 0
    runlog.append_stages(rec, path)
    runlog.append_stages(rec, path)
    got = runlog.read_stages(spark, path).collect()
    assert len(got) == 2 and got[0].duration_seconds == 6.997


def test_flatten_suite_documents_in_spark(spark):
    import json

    from matchlake.plans import suites
    tree = {"version": 2, "models": [{"name": m, "columns": [{"name": c, "tests": t} for c, t in cols.items()]}
                                     for m, cols in suites.EXPANDED.items()]}
    odd = {"models": [{"name": "x", "columns": [{"name": "c", "tests": ["not_null", {"a": 1, "b": 2},
                                                                         {"accepted_values": 5}]}]}]}
    docs = spark.createDataFrame([(json.dumps(tree),), (json.dumps({"models": "bad"}),), (json.dumps(odd),)],
                                 "suite string")
    rows = RS.flatten_documents(docs).orderBy("model", "mpos", "cpos", "tpos").collect()
    got = [(r.model, r.column, r.test, json.dumps(json.loads(r.args), sort_keys=True)) for r in rows if r.model != "x"]
    exp = [(x.model, x.column, x.test, x.args_json) for x in suites.suite_rules("manual_expanded")]
    assert sorted(got) == sorted(exp)
    assert [(r.test, r.args) for r in rows if r.model == "x"] == [("not_null", "{}"), ("accepted_values", '{"value":5}')]
    back = RS.flatten_documents(RS.render_suites(
        _rules(spark, [("m", "a", "not_null", "{}"), ("m", "a", "accepted_values", '{"values": ["x"]}')], "g")))
    assert [(r.test, r.tpos) for r in back.orderBy("tpos").collect()] == [("not_null", 0), ("accepted_values", 1)]
