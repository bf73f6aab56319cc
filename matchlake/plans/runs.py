"""Run analytics on the warehouse: the event stream read as a run log.

Each user's events are one pipeline run; an event is a stage record: stage = event
type, start = event time, end = start + ``value`` seconds, status ``failed`` when the
event's property ``k`` is at least 90. Trials are runs; a run is a fresh-generation
trial when its first stage is a signup, else a frozen-schema trial.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runlog
from ..sources.tables import Tables
from . import warehouse


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events(["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = e.select("*", (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("end_ts"),
                 F.when(k >= 90, "failed").otherwise("success").alias("status"))
    return runlog.stage_records(e, "user_id", "event_type", "ts", "end_ts", "status", "event_id")


def stage_latest(spark, sf_dir):
    return runlog.latest_successful(stages(spark, sf_dir))


def run_totals(spark, sf_dir):
    return runlog.run_totals(stage_latest(spark, sf_dir))


def trials(spark, sf_dir) -> DataFrame:
    e = Tables(spark, sf_dir).events(["event_id", "ts", "user_id", "event_type", "value"])
    first = F.min(F.struct("ts", "event_id", "event_type")).getField("event_type")
    return e.groupBy(F.col("user_id").alias("trial")).agg(
        F.when(first == "signup", "fresh_generation").otherwise("frozen_schema").alias("mode"),
        F.sum("value").alias("duration_seconds"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count(F.lit(1)).alias("events"))


def trial_stats(spark, sf_dir):
    return runlog.metric_stats(trials(spark, sf_dir), "mode", ["duration_seconds", "errors", "purchases", "events"])


def trial_counts(spark, sf_dir):
    t = trials(spark, sf_dir)
    return t.groupBy("mode").agg(F.count(F.lit(1)).alias("trial_count"),
                                 F.count_if(F.col("purchases") > F.col("errors")).alias("purchases_over_errors"),
                                 F.count_if(F.col("purchases") == F.col("errors")).alias("purchases_equal_errors"))


def test_log(spark, sf_dir) -> DataFrame:
    """Lines of the warehouse suite's run log, landed as text in the shared folder and read back."""
    from ..operators import quality
    from ..session import scratch_path
    from ..sources.files import text_lines
    rules = warehouse.warehouse_rules(warehouse.table_columns(spark, sf_dir))
    from .marts import as_table
    models = warehouse.warehouse_models(spark, sf_dir, rules)
    res = as_table(quality.evaluate(spark, rules, models), "test_results")
    path = scratch_path(spark, "run-log")
    runlog.render_log(res, len(rules), len(models)).write.text(path)
    return text_lines(spark, path).drop("file")     # one log, however many part files it has


def log_summary(spark, sf_dir):
    return runlog.parse_summary(test_log(spark, sf_dir))


def log_failed_tests(spark, sf_dir):
    return runlog.failed_tests(test_log(spark, sf_dir))


def log_run_stats(spark, sf_dir):
    return runlog.parse_run_stats(test_log(spark, sf_dir)).select("models", "data_tests", "sources")
