"""Registered queries: name → (spark, sf_dir) → DataFrame, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables
from . import marts, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _fct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact as a lazy plan: for queries that read it once."""
    return marts.fct_from_source(Tables(spark, sf_dir))


def _fct_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact as a materialised table: queries that use it several times (feature view,
    joins back) read it instead of re-running its joins."""
    return marts.as_table(_fct(spark, sf_dir))


@register("training_dataset", oracle.TRAINING_DATASET)
def q_training_dataset(spark, sf_dir):
    return marts.training_dataset(_fct_table(spark, sf_dir))


@register("fact_finished", oracle.FACT_FINISHED)
def q_fact_finished(spark, sf_dir):
    return _fct(spark, sf_dir)


@register("entity_dim", oracle.ENTITY_DIM)
def q_entity_dim(spark, sf_dir):
    return marts.dim_teams(marts.stg_matches(Tables(spark, sf_dir)))


# --- data-quality suites and the anomaly experiment -------------------------------

def _experiment(spark, sf_dir, output):
    from . import experiment
    clean = experiment.clean_marts(spark, sf_dir)
    return experiment.run(spark, clean)[output]


@register("dq_suite", oracle.suite_sql())
def q_dq_suite(spark, sf_dir):
    """All three suites over the clean marts (union evaluated once, split by membership)."""
    from pyspark.sql import functions as F

    from ..operators import quality
    from . import experiment, suites
    models = experiment.with_features(experiment.clean_marts(spark, sf_dir))
    rules, member = suites.union_rules(list(suites.CONDITIONS))
    res = quality.evaluate(spark, rules, models)
    mem = spark.createDataFrame(member, "condition string, rule_id int")
    return res.join(mem, "rule_id").select("condition", "model", "column", "test", "args", "test_name",
                                           "status", "failures", F.col("failing_rows"))


for _name, _out in [("detection_results", "results"), ("inject_manifest", "manifest"),
                    ("detections", "detections"), ("detection_matrix", "matrix"),
                    ("detection_coverage", "coverage"), ("detection_gain", "gain")]:
    register(_name, oracle.experiment_sql(_out))(
        lambda spark, sf_dir, _o=_out: _experiment(spark, sf_dir, _o))


# --- reconciliation ------------------------------------------------------------------

def _recon(fn_name):
    def run(spark, sf_dir):
        from . import recon
        return getattr(recon, fn_name)(spark, sf_dir)
    return run


for _name, _fn, _out in [("recon_counts", "recon_counts", "counts"), ("recon_nulls", "recon_nulls", "nulls"),
                         ("recon_checksum", "recon_checksum", "checksum"),
                         ("recon_diff_rows", "recon_diff_rows", "diff_rows"),
                         ("recon_diff_cells", "recon_diff_cells", "diff_cells"),
                         ("recon_first_diffs", "recon_first_diffs", "first_diffs"),
                         ("recon_summary", "recon_summary", "summary"), ("recon_status", "recon_status", "status")]:
    register(_name, oracle.recon_sql(_out))(_recon(_fn))


@register("recon_nested", oracle.RECON_NESTED)
def q_recon_nested(spark, sf_dir):
    """A copy whose nested timestamps, nested decimals and long JSON numbers differ in their last place."""
    from pyspark.sql import functions as F

    from ..operators import reconcile as R
    k = F.col("o_orderkey")
    micros = lambda n: F.timestamp_micros(F.unix_micros(F.to_timestamp("o_orderdate")) + n)
    hit = lambda n: F.when(k % 50 == n, 1).otherwise(0)
    tiny = lambda c: (c.cast("decimal(1,0)") * F.lit("0.000000000000000001").cast("decimal(18,18)"))

    def side(changed):
        at, n, j = (hit(i) if changed else F.lit(0) for i in range(3))
        v = F.struct(micros(k % 1000 + at).alias("at"), (k.cast("decimal(19,0)") + tiny(n)).cast("decimal(38,18)").alias("n"))
        js = F.concat(F.lit('{"n": 0.'), F.lit("7" * 45), (k * 10 + j).cast("string"), F.lit("}"))
        df = Tables(spark, sf_dir).orders(["o_orderkey", "o_orderdate"]).select(k.alias("k"), v.alias("v"), js.alias("j"))
        return R.normalise(df, ["k", "v", "j"])
    return R.cell_diffs(side(False), side(True), "k", ["k", "v", "j"]).groupBy("column").agg(F.count(F.lit(1)).alias("cells"))


# --- sources, marts extras, selections ------------------------------------------------

@register("nested_explode", oracle.NESTED_EXPLODE)
def q_nested_explode(spark, sf_dir):
    """Events → bounded JSON documents → parse with a fixed schema → unnest → fields."""
    from ..sources import events as ev
    docs = ev.event_documents(ev.event_rows(Tables(spark, sf_dir)))
    return ev.explode_documents(docs).select("match_data.*")


@register("nested_variant", oracle.NESTED_EXPLODE)
def q_nested_variant(spark, sf_dir):
    """Same documents through VARIANT: parse_json → explode events → variant_get fields."""
    from ..sources import events as ev
    docs = ev.event_documents(ev.event_rows(Tables(spark, sf_dir)))
    return ev.variant_fields(ev.explode_documents_variant(docs)).select("match_data.*")


@register("json_props_extract", oracle.JSON_PROPS)
def q_json_props(spark, sf_dir):
    from pyspark.sql import functions as F
    e = Tables(spark, sf_dir).events(["event_id", "user_id", "event_type", "props"])
    return e.select("event_id", "user_id", "event_type",
                    F.get_json_object("props", "$.k").try_cast("int").alias("k"),
                    F.size(F.json_object_keys("props")).alias("n_keys"))


@register("newest_files")
def q_newest_files(spark, sf_dir):
    from ..sources.files import newest_files
    return newest_files(spark, sf_dir, 30, "*.parquet")


@register("two_sided_unpivot", oracle.TWO_SIDED)
def q_two_sided(spark, sf_dir):
    from ..operators.unpivot import two_sided
    return two_sided(_fct(spark, sf_dir), [
        {"team_id": "home_team_id", "goals_scored": "home_team_score", "goals_conceded": "away_team_score"},
        {"team_id": "away_team_id", "goals_scored": "away_team_score", "goals_conceded": "home_team_score"},
    ], keep=["match_id", "match_date"])


@register("rolling_form", oracle.ROLLING_FORM)
def q_rolling_form(spark, sf_dir, **chunks):
    from ..operators.rolling import trailing_mean
    side = marts.as_table(q_two_sided(spark, sf_dir), "sides")     # counted, then read
    r = trailing_mean(side, "team_id", ["match_date", "match_id"],
                      {"avg_goals_scored_last_5": "goals_scored", "avg_goals_conceded_last_5": "goals_conceded"}, **chunks)
    return r.select("team_id", "match_id", "match_date", "goals_scored", "goals_conceded",
                    "avg_goals_scored_last_5", "avg_goals_conceded_last_5")


@register("rolling_form_ranged", oracle.ROLLING_FORM)
def q_rolling_form_ranged(spark, sf_dir):
    """The same by ranges of about 300 rows with a halo, as entities beyond a million rows are rolled."""
    return q_rolling_form(spark, sf_dir, chunk_rows=300)


@register("upsert_by_key", oracle.UPSERT_BY_KEY)
def q_upsert(spark, sf_dir):
    """A correction feed (two versions per key) replaces one season's rows."""
    from pyspark.sql import functions as F
    fct = _fct_table(spark, sf_dir)
    corr = (fct.filter(F.col("season") == oracle.UPSERT_SEASON)
            .withColumns({"home_team_score": F.col("away_team_score"), "away_team_score": F.col("home_team_score")}))
    batch = corr.unionByName(corr.withColumn("home_team_score", F.col("home_team_score") + 1))
    return marts.upsert(fct, batch, "match_id", prefer=["home_team_score"])


@register("either_side_filter", oracle.EITHER_SIDE)
def q_either_side(spark, sf_dir):
    from ..operators.latest import either_side
    return either_side(_fct(spark, sf_dir), "home_team_id", "away_team_id", oracle.EITHER_SIDE_TEAM)


@register("latest_form", oracle.LATEST_FORM)
def q_latest_form(spark, sf_dir):
    """Latest feature row per team and role (home / away), all teams at once."""
    from pyspark.sql import functions as F

    from ..operators.latest import latest_by
    from ..operators.unpivot import two_sided
    tr = marts.training_dataset(_fct_table(spark, sf_dir))
    sides = two_sided(tr, [
        {"team_id": "home_team_id", "role": F.lit("home"), "avg_goals_scored_last_5": "home_avg_goals_scored_last_5",
         "avg_goals_conceded_last_5": "home_avg_goals_conceded_last_5"},
        {"team_id": "away_team_id", "role": F.lit("away"), "avg_goals_scored_last_5": "away_avg_goals_scored_last_5",
         "avg_goals_conceded_last_5": "away_avg_goals_conceded_last_5"},
    ], keep=["match_id", "match_date"])
    out = latest_by(sides, ["team_id", "role"], ["match_date", "match_id"])
    return out.select("team_id", "role", "match_id", "match_date", "avg_goals_scored_last_5",
                      "avg_goals_conceded_last_5")


@register("latest_per_key", oracle.LATEST_PER_KEY)
def q_latest_per_key(spark, sf_dir):
    from ..operators.latest import latest_by
    e = Tables(spark, sf_dir).events(["user_id", "ts", "event_id", "event_type", "value"])
    return latest_by(e, ["user_id"], ["ts", "event_id"])


@register("nth_key_targets", oracle.NTH_KEYS)
def q_nth_keys(spark, sf_dir):
    from ..operators.latest import nth_keys
    return nth_keys(_fct(spark, sf_dir), "match_id", [0, 1, 10, 11, 12, 13, 14, 20, 21, 22])


# --- warehouse rules, profile, suggestion, merge --------------------------------------

def _wh_rules_static():
    """The warehouse suite with column lists from the test tables' schemas (for the oracle)."""
    from . import warehouse
    from .oracle import WAREHOUSE_TYPES
    return warehouse.warehouse_rules({t: list(WAREHOUSE_TYPES[t]) for t in warehouse.NOT_NULL_TABLES})


def _wh_query(tests):
    def run(spark, sf_dir):
        from . import warehouse
        return warehouse.evaluate(spark, sf_dir, tests)
    return run


for _name, _tests in [("dq_not_null", ("not_null",)), ("dq_unique", ("unique",)),
                      ("dq_accepted_values", ("accepted_values",)), ("dq_relationships", ("relationships",)),
                      ("dq_warehouse", None)]:
    _rules = [r for r in _wh_rules_static() if _tests is None or r.test in _tests]
    register(_name, oracle.rules_results_sql(_rules))(_wh_query(_tests))


@register("dq_relationships_mixed", oracle.RELATIONSHIPS_MIXED)
def q_relationships_mixed(spark, sf_dir):
    """Children and parents of different numeric types: fractions that a narrower type would round
    away, and whole numbers beyond what a double tells apart."""
    from pyspark.sql import functions as F

    from ..operators import quality
    t = Tables(spark, sf_dir)
    key, big = F.col("l_orderkey"), F.lit(2 ** 53)
    child = t.lineitem(["l_orderkey", "l_linenumber"]).select(
        (key.cast("decimal(20,0)") + F.when(F.col("l_linenumber") == 2, F.lit("0.000000000004")).otherwise("0").cast("decimal(13,12)")).alias("fraction"),
        (key + big).alias("large"), F.concat(F.lit(" 0"), key.cast("string"), F.when(F.col("l_linenumber") == 3, ".50").otherwise(".00")).alias("text"))
    parent = t.orders(["o_orderkey"]).select(F.col("o_orderkey").cast("double").alias("number"), (F.col("o_orderkey") + big).cast("double").alias("large"))
    rules = [quality.Rule.make("child", c, "relationships", to="parent", field=f) for c, f in (("fraction", "number"), ("large", "large"), ("text", "number"))]
    return quality.evaluate(spark, rules, {"child": child, "parent": parent}).select("column", "status", "failures")


@register("dq_profile", oracle.profile_sql(("orders", "lineitem", "customer", "events")))
def q_dq_profile(spark, sf_dir):
    from . import warehouse
    return warehouse.profile(spark, sf_dir)


def _rules_df(spark, rules):
    return spark.createDataFrame([(r.model, r.column, r.test, r.args_json) for r in rules],
                                 "model string, column string, test string, args string")


@register("dq_suggest_warehouse", oracle.warehouse_suggest_sql())
def q_suggest_warehouse(spark, sf_dir):
    from ..operators.suggest import suggest
    t = Tables(spark, sf_dir)
    return _rules_df(spark, suggest({n: t.read(n) for n in oracle.WAREHOUSE_SUGGEST_TABLES}))


@register("inclusion_dependencies", oracle.inclusion_sql())
def q_inclusion_dependencies(spark, sf_dir):
    """Which columns' values are contained in which others, found without names."""
    from ..operators.dependencies import inclusion_dependencies
    t = Tables(spark, sf_dir)
    columns = {n: [c for c, ty in oracle.WAREHOUSE_TYPES[n].items() if ty in ("int", "bigint", "string")] for n in oracle.DEPENDENCY_TABLES}
    return inclusion_dependencies({n: t.read(n, c) for n, c in columns.items()})


@register("composite_keys", oracle.composite_keys_sql())
def q_composite_keys(spark, sf_dir):
    from ..operators.dependencies import composite_keys
    return composite_keys("lineitem", Tables(spark, sf_dir).read("lineitem", list(oracle.KEY_COLUMNS)))


def _mart_suggestions(spark, sf_dir):
    """Suggestions read the materialised marts: profiling, confirmation and value lists are
    several passes, none of which should re-run the staging joins."""
    from ..operators.suggest import suggest
    from . import experiment
    m = experiment.clean_marts(spark, sf_dir)
    return suggest({"dim_teams": m["dim_teams"], "fct_matches": m["fct_matches"]})


@register("dq_suggest_rules", oracle.mart_suggest_sql())
def q_suggest_rules(spark, sf_dir):
    return _rules_df(spark, _mart_suggestions(spark, sf_dir))


@register("rules_merge", oracle.rules_merge_sql())
def q_rules_merge(spark, sf_dir):
    from ..operators import rules as R
    from . import suites, warehouse
    base = warehouse.rules_frame(spark, suites.suite_rules("manual_only"), "baseline")
    new = warehouse.rules_frame(spark, _mart_suggestions(spark, sf_dir), "suggested")
    return R.merge(base, new)


# --- rule audit -----------------------------------------------------------------------

@register("rules_audit", oracle.audit_sql("classified"))
def q_rules_audit(spark, sf_dir):
    from . import experiment
    return experiment.audit(spark, sf_dir)["classified"]


@register("rules_audit_summary", oracle.audit_sql("summary"))
def q_rules_audit_summary(spark, sf_dir):
    from . import experiment
    return experiment.audit(spark, sf_dir)["summary"]


@register("rules_audit_runs", oracle.audit_sql("by_run"))
def q_rules_audit_runs(spark, sf_dir):
    """The audit's summary keyed by run (every batch a run)."""
    from . import experiment
    return experiment.audit_by_run(spark, sf_dir)["summary"]


@register("rules_by_run", oracle.experiment_sql("results"))
def q_rules_by_run(spark, sf_dir):
    """Three suites over three runs' tables, all rules as rows of one table."""
    from . import experiment
    return experiment.results_by_run(spark, sf_dir)


# --- run analytics --------------------------------------------------------------------

def _runs(fn):
    def run(spark, sf_dir):
        from . import runs
        return getattr(runs, fn)(spark, sf_dir)
    return run


for _name, _fn, _sql in [("stage_latest", "stage_latest", oracle.STAGE_LATEST),
                         ("run_totals", "run_totals", oracle.RUN_TOTALS),
                         ("trial_stats", "trial_stats", oracle.trial_stats_sql()),
                         ("trial_counts", "trial_counts", oracle.TRIAL_COUNTS),
                         ("log_summary", "log_summary", oracle.log_sql("summary")),
                         ("log_failed_tests", "log_failed_tests", oracle.log_sql("failed")),
                         ("log_run_stats", "log_run_stats", oracle.log_sql("stats"))]:
    register(_name, _sql)(_runs(_fn))


# --- classifier (rows-only: a random forest has no SQL twin) --------------------------

@register("match_outcome_model")
def q_match_outcome_model(spark, sf_dir):
    from . import predict
    return predict.model_metrics(spark, sf_dir)


@register("pair_scores")
def q_pair_scores(spark, sf_dir):
    from . import predict
    return predict.pair_scores(spark, sf_dir)


# --- profiles, copies, verification, combined summary ---------------------------------

@register("json_key_profile", oracle.JSON_KEY_PROFILE)
def q_json_key_profile(spark, sf_dir):
    from pyspark.sql import functions as F
    e = Tables(spark, sf_dir).events(["event_type", "props"])
    k = e.select(F.explode(F.json_object_keys("props")).alias("key"), "event_type")
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("events"),
                                F.count_distinct("event_type").alias("event_types"))


@register("document_profile", oracle.DOC_PROFILE)
def q_document_profile(spark, sf_dir):
    """Documents landed from the event stream: count, events, events per document."""
    from pyspark.sql import functions as F

    from ..sources import events as ev
    docs = ev.event_documents(ev.event_rows(Tables(spark, sf_dir)))
    n = F.json_array_length(F.get_json_object("json", "$.events"))
    return docs.select(n.alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").cast("bigint").alias("events"),
                                         F.max("n").cast("bigint").alias("max_events_per_document"),
                                         F.min("n").cast("bigint").alias("min_events_per_document"))


@register("copy_summary", oracle.copy_summary_sql())
def q_copy_summary(spark, sf_dir):
    """Copy the marts to a second store (snappy Parquet under the shared folder), re-read, count."""
    from pyspark.sql import functions as F

    from ..session import scratch_path
    from ..sources.files import materialise
    from . import recon
    src = recon.source_marts(spark, sf_dir)
    parts = []
    for name in ("dim_teams", "fct_matches", "fct_training_dataset"):
        df = src[name]
        copied = materialise(recon.migrated(df), scratch_path(spark, f"copy-{name}"))
        n_src = df.count()
        parts.append(copied.agg(F.count(F.lit(1)).alias("target_rows")).select(
            F.lit(name).alias("table"), F.lit(n_src).cast("bigint").alias("source_rows"), "target_rows",
            F.when(F.col("target_rows") == F.lit(n_src), "success").otherwise("failed").alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("inject_verify", oracle.inject_verify_sql())
def q_inject_verify(spark, sf_dir):
    from ..operators import inject
    from . import experiment
    clean = experiment.clean_marts(spark, sf_dir)
    out = None
    for b, specs in inject.BATCHES.items():
        corrupted, _ = inject.apply(spark, clean, specs, b)
        from pyspark.sql import functions as F
        v = inject.verify(corrupted, specs).select(F.lit(b).alias("batch_id"), "anomaly_id", "present")
        out = v if out is None else out.unionByName(v)
    return out


@register("research_summary", oracle.research_summary_sql())
def q_research_summary(spark, sf_dir):
    """One row combining the run's artefacts: detection coverage and gain, reconciliation
    status and the rule audit (missing artefacts would stay NULL)."""
    from pyspark.sql import functions as F

    from . import experiment, recon
    a = experiment.audit(spark, sf_dir)
    cov = a["coverage"]
    base = cov.filter(F.col("condition") == "manual_only").select(
        F.struct("total_detected", "overall_detection_rate")).scalar()
    comp = cov.filter(F.col("condition") == "suggested_merged").select(
        F.struct("total_detected", "overall_detection_rate")).scalar()
    rs = recon.recon_status(spark, sf_dir).select(F.struct("compared", "match_count", "status")).scalar()
    return a["summary"].select(
        base.getField("total_detected").alias("baseline_detected"),
        comp.getField("total_detected").alias("suggested_detected"),
        (comp.getField("total_detected") - base.getField("total_detected")).alias("additional_detections"),
        "useful_count", "redundant_count", "low_value_count", "invalid_count",
        rs.getField("compared").alias("tables_compared"), rs.getField("match_count").alias("tables_matching"),
        rs.getField("status").alias("reconciliation_status"))


@register("rules_per_model", oracle.rules_per_model_sql())
def q_rules_per_model(spark, sf_dir):
    """How many rules of each kind the data supports per warehouse table."""
    from pyspark.sql import functions as F
    s = q_suggest_warehouse(spark, sf_dir)
    return s.groupBy("model", "test").agg(F.count(F.lit(1)).alias("rules"))


@register("name_lookup", oracle.NAME_LOOKUP)
def q_name_lookup(spark, sf_dir):
    """Entity id by name, for every event's home side (a join, not a per-name filter)."""
    from ..operators.latest import lookup_id
    stg = marts.stg_matches(Tables(spark, sf_dir))
    fct = marts.fct_matches(stg).select("match_id", "home_team_name")
    return lookup_id(marts.dim_teams(stg), "team_name", "team_id",
                     fct.withColumnRenamed("home_team_name", "team_name"), "home_team_key") \
        .withColumnRenamed("team_name", "home_team_name")


@register("rules_flatten", oracle.rules_flatten_sql())
def q_rules_flatten(spark, sf_dir):
    """Suggested warehouse rules rendered as suite documents (one per table) and flattened
    back to rule rows in Spark (VARIANT + posexplode)."""
    from ..operators import rules as RS
    from . import warehouse
    from ..operators.suggest import suggest
    t = Tables(spark, sf_dir)
    rules = suggest({n: t.read(n) for n in oracle.WAREHOUSE_SUGGEST_TABLES})
    docs = RS.render_suites(warehouse.rules_frame(spark, rules))
    return RS.flatten_documents(docs).select("model", "column", "test", "args", "cpos", "tpos")


# --- sources, sinks and small operators -------------------------------------------------

def _extras() -> None:
    from .extras import EXTRAS
    for name, (fn, sql) in EXTRAS.items():
        register(name, sql)(fn)


_extras()


@register("rules_not_in_baseline", f"SELECT model, \"column\", test, args FROM ({oracle.rules_merge_sql()}) WHERE priority = 1")
def q_rules_not_in(spark, sf_dir):
    """Suggested rules that the baseline lacks."""
    from ..operators import rules as R
    from . import suites, warehouse
    base = warehouse.rules_frame(spark, suites.suite_rules("manual_only"))
    return R.not_in(_rules_df(spark, _mart_suggestions(spark, sf_dir)), base)
