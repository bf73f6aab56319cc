"""Plan-shape checks: pruning, pushdown, exchange reuse, fused aggregates."""

import re

from conftest import SF001


def _executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_event_source_prunes_columns(spark):
    from matchlake.plans.registry import QUERIES
    plan = _formatted(QUERIES["fact_finished"](spark, SF001))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
    li = [s for s in schemas if "l_orderkey" in s]
    assert li and all(s == "struct<l_orderkey:bigint,l_suppkey:bigint,l_linestatus:string>" for s in li)
    assert not any("o_totalprice" in s or "c_acctbal" in s for s in schemas)


def test_not_null_rules_share_one_aggregate(spark):
    from matchlake.operators.quality import Rule, evaluate
    from matchlake.sources.tables import Tables
    li = Tables(spark, SF001).lineitem()
    rules = [Rule.make("lineitem", c, "not_null") for c in li.columns]
    plan = _formatted(evaluate(spark, rules, {"lineitem": li}))
    assert len(re.findall(r"\(\d+\) Scan parquet", plan)) == 1


def test_status_filter_reaches_the_scan(spark):
    from matchlake.plans.registry import QUERIES
    for name in ("fact_finished", "two_sided_unpivot", "either_side_filter"):
        plan = _formatted(QUERIES[name](spark, SF001))
        assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan
        assert "LeftSemi" in plan


def test_no_broadcast_by_hint(spark):
    from matchlake.sources.events import event_rows
    from matchlake.sources.tables import Tables
    logical = event_rows(Tables(spark, SF001))._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in logical


def test_accepted_values_without_expand(spark):
    from matchlake.operators.quality import Rule, evaluate
    from matchlake.sources.tables import Tables
    li = Tables(spark, SF001).lineitem()
    rules = [Rule.make("lineitem", "l_returnflag", "accepted_values", values=["A", "N"]),
             Rule.make("lineitem", "l_linestatus", "accepted_values", values=["F"]),
             Rule.make("lineitem", "l_orderkey", "not_null")]
    df = evaluate(spark, rules, {"lineitem": li})
    assert "Expand" not in _formatted(df)
    got = {r.column: (r.failures, r.failing_rows) for r in df.collect()}
    assert got["l_returnflag"][0] == 1 and got["l_linestatus"][0] == 1 and got["l_orderkey"] == (0, 0)
