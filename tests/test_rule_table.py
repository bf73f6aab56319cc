"""Table-driven rules: the same results as the per-rule evaluation, whatever their number."""

import datetime as dt
import json

import pytest

from matchlake.operators import quality, rule_table
from matchlake.operators import rules as RS

SCHEMA = "run_id string, rule_id int, model string, column string, test string, args string"


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.createDataFrame([(1, "x", 1.5, True, dt.date(2024, 1, 1)), (1, None, 2.0, None, None), (2, "y", 0.1, False, dt.date(2024, 1, 2)),
                               (None, "y", None, True, None), (5, "3", 1.0, True, dt.date(2024, 1, 1))],
                              "k int, s string, d double, b boolean, day date")
    p = spark.createDataFrame([(1, "1", 1.5), (2, "x", 0.1), (3, "y", 2.0)], "id bigint, name string, v decimal(10,3)".replace("decimal(10,3)", "double"))
    return {"a": a, "p": p}


def all_rules():
    R = quality.Rule.make
    out = [R("a", c, t) for c in ("k", "s", "d", "b", "day") for t in ("not_null", "unique")]
    out += [R("a", "k", "accepted_values", values=[1, 2]), R("a", "s", "accepted_values", values=["x", "3"]), R("a", "d", "accepted_values", values=["1.50", 2]),
            R("a", "b", "accepted_values", values=[True]), R("a", "day", "accepted_values", values=["2024-01-01"])]
    out += [R("a", c, "relationships", to="p", field=f) for c in ("k", "s", "d") for f in ("id", "v")]
    out += [R("a", "s", "relationships", to="p", field="name"),
            R("a", "nope", "unique"), R("nope", "k", "unique"), R("a", "k", "strange"), R("a", "k", "accepted_values"), R("a", "k", "accepted_values", values=[]),
            R("a", "k", "accepted_values", values=["x"]), R("a", "k", "relationships", to="p", field="nope"), R("a", "k", "relationships")]
    return out


def as_table(spark, rules, runs):
    return spark.createDataFrame([(r, i, x.model, x.column, x.test, x.args_json) for r in runs for i, x in enumerate(rules)], SCHEMA)


def test_equals_the_per_rule_evaluation_in_every_run(spark, tables):
    rules = all_rules()
    runs = {"one": tables, "two": {**tables, "a": tables["a"].filter("k = 1")}, "three": {**tables, "p": tables["p"].limit(0)}}
    got = {}
    for r in rule_table.evaluate(as_table(spark, rules, runs), runs).collect():
        got.setdefault(r.run_id, {})[r.rule_id] = (r.status, r.failures, r.failing_rows)
    for run, models in runs.items():
        want = {r.rule_id: (r.status, r.failures, r.failing_rows) for r in quality.evaluate(spark, rules, models).collect()}
        assert got[run] == want, {rules[i]: (got[run][i], want[i]) for i in want if got[run][i] != want[i]}


def test_the_plan_does_not_grow_with_the_rules(spark, tables, tmp_path):
    def plan(n):
        path = str(tmp_path / f"r{n}")
        rows = [("one", i, "a", ("k", "s")[i % 2], "accepted_values", json.dumps({"values": [i]})) for i in range(n)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(path)
        out = rule_table.evaluate(spark.read.parquet(path), {"one": tables})
        assert out.count() == n
        return out._jdf.queryExecution().analyzed().toString().count("\n")
    assert plan(50) == plan(5000)


def test_no_rules_and_no_tables(spark, tables):
    empty = spark.createDataFrame([], SCHEMA)
    assert rule_table.evaluate(empty, {"one": tables}).count() == 0
    assert [r.status for r in rule_table.evaluate(as_table(spark, all_rules()[:2], ["gone"]), {"one": tables}).collect()] == ["error", "error"]


def test_audit_steps_stay_within_their_run(spark):
    rule = lambda run, c, pos=0: (run, pos, "m", c, "unique", "{}", "o")
    frame = lambda rows: spark.createDataFrame(rows, "run_id string, position int, model string, column string, test string, args string, origin string")
    by = ["run_id"]
    base, new = frame([rule("a", "x")]), frame([rule("a", "x"), rule("a", "y", 1), rule("b", "x"), rule("b", "z", 1)])
    merged = RS.merge(base, new, by)
    assert {(r.run_id, r.column, r.priority) for r in merged.collect()} == {("a", "x", 0), ("a", "y", 1), ("b", "x", 1), ("b", "z", 1)}
    assert {(r.run_id, r.column) for r in RS.not_in(new, base, by).collect()} == {("a", "y"), ("b", "x"), ("b", "z")}
    useful = spark.createDataFrame([("b", "unique", "m", "x"), ("a", "unique", "m", "z")], "run_id string, test string, model string, column string")
    classes = RS.classify(new, merged, base, useful, useful.filter("run_id = 'b'"), by)
    got = {(r.run_id, r.column): r.classification for r in classes.collect()}
    assert got == {("a", "x"): "redundant", ("a", "y"): "low_value", ("b", "x"): "useful", ("b", "z"): "low_value"}
    s = {r.run_id: (r.total, r.useful_count, r.redundant_count) for r in RS.audit_summary(classes, by).collect()}
    assert s == {"a": (2, 0, 1), "b": (2, 1, 0)}
    detections = spark.createDataFrame([("a", "1", "n1", "c", True), ("a", "1", "n1", "manual_only", False), ("b", "1", "n1", "c", True), ("b", "1", "n1", "manual_only", True)],
                                       "run_id string, batch_id string, anomaly_id string, condition string, detected boolean")
    detectors = spark.createDataFrame([("n1", "unique", "m", "x")], "anomaly_id string, test string, model string, column string")
    assert [r.run_id for r in RS.useful_families(detections, detectors, "c", by=by).collect()] == ["a"]


def test_counted_values_are_not_broadcast(spark, tables):
    """The counts' file may be small and their rows many: rules go to them, values meet parents in a shuffle."""
    out = rule_table.evaluate(as_table(spark, all_rules(), ["one"]), {"one": tables})
    lines, inside = out._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                inside.append(below)
    assert any("FileScan" in x for x in lines) and not any("FileScan" in x for x in inside)
