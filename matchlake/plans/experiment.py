"""The anomaly-detection experiment as Spark jobs.

Clean marts are built once and cut from their lineage (Parquet tables in the shared
checkpoint folder). Each batch folds its corruptions over them; the *union* of
all suites is evaluated once per batch and results are assigned to conditions by
suite membership — three evaluations instead of one per (batch, suite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inject, quality, scoring
from ..session import ensure_checkpoint_dir
from ..sources.tables import Tables
from . import marts, suites
from .parallel import together


def clean_marts(spark: SparkSession, sf_dir: str, checkpoint: bool = True) -> dict[str, DataFrame]:
    """Staging and dimension materialised as tables (as the reference does); the fact is a
    filter over the materialised staging rows."""
    stg = marts.stg_matches(Tables(spark, sf_dir))
    if checkpoint:
        ensure_checkpoint_dir(spark)
        stg = marts.as_table(stg, "stg_matches")
    dim, fct = marts.dim_teams(stg), marts.fct_matches(stg)
    if checkpoint:
        dim, fct = together(lambda x: marts.as_table(*x), [(dim, "dim_teams"), (fct, "fct_matches")])
    return {"fct_matches": fct, "dim_teams": dim}


def with_features(models: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The feature table is derived from the (possibly corrupted) fact: corruption propagates.

    It is written once per batch: several rule families read it, each would otherwise run
    the rolling averages and their joins again."""
    out = dict(models)
    out["fct_training_dataset"] = marts.as_table(marts.training_dataset(models["fct_matches"]), "features")
    return out


def batch_results(spark: SparkSession, clean: dict[str, DataFrame], batch_id: str,
                  conditions, tg: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Test results of every condition on one corrupted batch, and its manifest."""
    corrupted, manifest = inject.apply(spark, clean, inject.BATCHES[batch_id], batch_id, tg)
    models = with_features(corrupted)
    rules, member = suites.union_rules(conditions)
    res = quality.evaluate(spark, rules, models)
    mem = spark.createDataFrame(member, "condition string, rule_id int")
    out = (res.join(mem, "rule_id")
           .select(F.lit(batch_id).alias("batch_id"), "condition", "model", "column", "test", "args",
                   "test_name", "status", "failures"))
    return out, manifest


def run(spark: SparkSession, clean: dict[str, DataFrame], batches: list[str] | None = None,
        conditions: list[str] | dict | None = None) -> dict[str, DataFrame]:
    """``conditions``: suite names or a mapping condition → rules (default: the three suites)."""
    batches = batches or list(inject.BATCHES)
    conditions = conditions or list(suites.CONDITIONS)
    results, manifests = None, None
    # targets of all batches from one bounded top-k per table
    tg = inject.targets(clean, [s for b in batches for s in inject.BATCHES[b]])
    for r, m in together(lambda b: batch_results(spark, clean, b, conditions, tg), batches):
        results = r if results is None else results.unionByName(r)
        manifests = m if manifests is None else manifests.unionByName(m)
    # results are one row per (batch, condition, rule): materialise once, every report reuses them
    results, manifests = together(lambda x: marts.as_table(*x), [(results, "test_results"), (manifests, "manifest")])
    conds = spark.createDataFrame([(b, c) for b in batches for c in list(conditions)],
                                  "batch_id string, condition string")
    det = scoring.detections(results, manifests, scoring.detectors_frame(spark, suites.DETECTORS), conds)
    mx = scoring.matrix(det)
    cov = scoring.coverage(mx)
    return {"results": results, "manifest": manifests, "detections": det, "matrix": mx,
            "coverage": cov, "gain": scoring.gain(cov)}


def audit(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Suggest rules on the clean marts, merge them into the baseline suite, run the
    experiment with the merged suite as a condition and classify every suggestion."""
    from ..operators import rules as RS
    from ..operators.suggest import suggest
    from . import warehouse
    clean = clean_marts(spark, sf_dir)
    generated = suggest({"dim_teams": clean["dim_teams"], "fct_matches": clean["fct_matches"]})
    base = suites.suite_rules("manual_only")
    merged_rules = list(base) + [r for r in generated if r.key not in {b.key for b in base}]
    proposed = generated + suites.NOT_EXECUTABLE     # what cannot run is not merged
    out = run(spark, clean, conditions={"manual_only": base, "suggested_merged": merged_rules})
    base_df = warehouse.rules_frame(spark, base, "baseline")
    merged_df = RS.merge(base_df, warehouse.rules_frame(spark, generated, "suggested"))
    gen_df = warehouse.rules_frame(spark, proposed, "suggested")
    useful = RS.useful_families(out["detections"], scoring.detectors_frame(spark, suites.DETECTORS),
                                "suggested_merged")
    fired = out["results"].filter(F.col("status") == "fail")
    classified = RS.classify(gen_df, merged_df, base_df, useful, fired)
    return {"classified": classified, "summary": RS.audit_summary(classified), "useful": useful, **out}


def results_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every suite on every corrupted batch, the batches as runs of one rule table."""
    from ..operators import rule_table
    clean = clean_marts(spark, sf_dir)
    tg = inject.targets(clean, [s for specs in inject.BATCHES.values() for s in specs])
    runs = dict(zip(inject.BATCHES, together(lambda b: with_features(inject.apply(spark, clean, inject.BATCHES[b], b, tg)[0]), inject.BATCHES), strict=True))
    rules, member = suites.union_rules(list(suites.CONDITIONS))
    table = quality.rules_frame(spark, rules).join(spark.createDataFrame([(b,) for b in runs], "run_id string"))
    mem = spark.createDataFrame(member, "condition string, rule_id int")
    return rule_table.evaluate(table, runs).join(mem, "rule_id").select(
        F.col("run_id").alias("batch_id"), "condition", "model", "column", "test", "args", "test_name", "status", "failures")


def audit_by_run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The audit with every batch as a run of its own: a suggestion may be useful in one run only."""
    from ..operators import rules as RS
    from ..operators.suggest import suggest
    from . import warehouse
    by, clean = ["run_id"], clean_marts(spark, sf_dir)
    generated = suggest({"dim_teams": clean["dim_teams"], "fct_matches": clean["fct_matches"]})
    base = suites.suite_rules("manual_only")
    merged_rules = list(base) + [r for r in generated if r.key not in {b.key for b in base}]
    out = run(spark, clean, conditions={"manual_only": base, "suggested_merged": merged_rules})
    ids = spark.createDataFrame([(b,) for b in inject.BATCHES], "run_id string")
    frame = lambda rules, origin: warehouse.rules_frame(spark, rules, origin).join(ids)  # noqa: E731  a row per run and rule
    base_df, run_id = frame(base, "baseline"), F.col("batch_id").alias("run_id")
    merged_df = RS.merge(base_df, frame(generated, "suggested"), by)
    useful = RS.useful_families(out["detections"].select("*", run_id), scoring.detectors_frame(spark, suites.DETECTORS), "suggested_merged", by=by)
    fired = out["results"].filter(F.col("status") == "fail").select("*", run_id)
    classified = RS.classify(frame(generated + suites.NOT_EXECUTABLE, "suggested"), merged_df, base_df, useful, fired, by)
    return {"classified": classified, "summary": RS.audit_summary(classified, by)}
