"""Detection scoring: which injected anomalies did a suite notice, per batch and condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def detectors_frame(spark: SparkSession, detectors: dict[str, list[tuple[str, str, str]]]) -> DataFrame:
    rows = [(a, t, m, c) for a, ds in detectors.items() for t, m, c in ds]
    return spark.createDataFrame(rows, "anomaly_id string, test string, model string, column string")


def detections(results: DataFrame, manifest: DataFrame, detectors: DataFrame, conditions: DataFrame,
               count_errors: bool = True) -> DataFrame:
    """(batch_id, condition, anomaly_id, detected).

    ``results``: (batch_id, condition, test, model, column, status). ``conditions``:
    (batch_id, condition) pairs that were run. Detected = some detector of the anomaly
    has status ``fail`` (or ``error`` when ``count_errors``, as the reference counts).
    Matching is on the structured (test, model, column), not on name containment.
    """
    bad = ["fail", "error"] if count_errors else ["fail"]
    fired = (results.filter(F.col("status").isin(bad))
             .select("batch_id", "condition", "test", "model", "column").distinct())
    m = manifest.select("batch_id", "anomaly_id").join(conditions, "batch_id")
    d = m.join(detectors, "anomaly_id", "left")
    j = d.join(fired.withColumn("_hit", F.lit(True)), ["batch_id", "condition", "test", "model", "column"], "left")
    return (j.groupBy("batch_id", "condition", "anomaly_id")
            .agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("detected")))


def matrix(det: DataFrame) -> DataFrame:
    """(batch_id, condition) → detected_count, total_anomalies, detection_rate (4 dp)."""
    g = det.groupBy("batch_id", "condition").agg(F.count_if("detected").alias("detected_count"),
                                                 F.count(F.lit(1)).alias("total_anomalies"))
    return g.withColumn("detection_rate", ratio(F.col("detected_count"), F.col("total_anomalies")))


def coverage(mx: DataFrame) -> DataFrame:
    """Per condition: totals, overall rate and mean of per-batch rates (4 dp)."""
    g = mx.groupBy("condition").agg(F.sum("detected_count").alias("total_detected"),
                                    F.sum("total_anomalies").alias("total_anomalies"),
                                    F.round(F.avg("detection_rate"), 4).alias("average_batch_detection_rate"),
                                    F.count(F.lit(1)).alias("batch_count"))
    return g.withColumn("overall_detection_rate", ratio(F.col("total_detected"), F.col("total_anomalies")))


def gain(cov: DataFrame, baseline: str = "manual_only") -> DataFrame:
    """Each condition against the baseline: extra detections, rate gain (4 dp), relative % (2 dp).

    The baseline figures enter as scalar subqueries (one row each), not as a join.
    """
    base = cov.filter(F.col("condition") == baseline)
    bd = base.select("total_detected").scalar()
    br = base.select("overall_detection_rate").scalar()
    return cov.filter(F.col("condition") != baseline).select(
        "condition",
        (F.col("total_detected") - bd).alias("absolute_additional_detections"),
        F.round(F.col("overall_detection_rate") - br, 4).alias("absolute_detection_rate_gain"),
        F.when(bd > 0, F.round((F.col("total_detected") - bd) / bd * 100, 2)).alias(
            "relative_detection_count_improvement"))
