"""Queries for the sources, sinks and small operators that no mart query passes through:
landing and reading back, reports, run logs, selections and document checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_path, iso_date, to_timestamp_ntz
from ..operators import latest, ml, reports, rules, runlog, textmatch
from ..session import scratch_path
from ..sources import copying, events, files, schema
from ..sources.tables import Tables
from ..streaming.partitioned import PartitionedTable
from . import marts, oracle, predict, runs

# Fixed value: deadline of the first load in the incremental query.
CUTOFF = oracle.INCREMENTAL_CUTOFF


def landed_documents(spark, sf_dir) -> DataFrame:
    """Raw documents landed as files (nothing is written for an empty payload) and read back."""
    path = scratch_path(spark, "landed")
    files.land_snapshot(events.event_documents(events.event_rows(Tables(spark, sf_dir))), path)
    return events.read_documents(spark, path, multiline=False).select("match_data.*")


def full_refresh(spark, sf_dir) -> DataFrame:
    """A refresh ignores the watermark of the target and offers everything."""
    fct = marts.as_table(marts.fct_from_source(Tables(spark, sf_dir)), "fct")
    return marts.incremental_batch(fct, fct, full_refresh=True)


def incremental_load(spark, sf_dir) -> DataFrame:
    """First load up to a cut-off, then a run that is offered every row corrected twice: late and
    same-day rows must be dropped, of the two corrections of a new row the higher one stays."""
    fct = marts.as_table(marts.fct_from_source(Tables(spark, sf_dir)), "fct")
    t0 = fct.filter(F.col("match_date") <= F.lit(CUTOFF).cast("date"))
    offered = fct.withColumn("home_team_score", F.explode(F.array(F.col("home_team_score") + 100, F.col("home_team_score") + 101)))
    return marts.upsert(t0, marts.incremental_batch(offered, t0), "match_id", prefer=["home_team_score"])


def _merged_table(spark, sf_dir):
    """The fact partitioned by month: a first load up to a cut-off, then a season offered with two
    corrections of every row (the higher one stays), then that epoch once more with other values,
    which must change nothing."""
    fct = marts.as_table(marts.fct_from_source(Tables(spark, sf_dir)), "fct")
    table = PartitionedTable(spark, scratch_path(spark, "merged"), "match_id", F.date_format("match_date", "yyyy-MM"), high_water="match_date")
    table.merge(fct.filter(F.col("match_date") <= F.lit(CUTOFF).cast("date")), 0)
    offered = fct.filter(F.col("season") == oracle.UPSERT_SEASON)
    score = lambda *more: F.explode(F.array(*[F.col("home_team_score") + n for n in more]))
    table.merge(offered.withColumn("home_team_score", score(100, 101)), 1, prefer=["home_team_score"])
    table.merge(offered.withColumn("home_team_score", score(900)), 1)
    return table


def partition_merge(spark, sf_dir) -> DataFrame:
    return _merged_table(spark, sf_dir).read()


def partition_merge_log(spark, sf_dir) -> DataFrame:
    """Which epoch last wrote a month: only the season's months are rewritten."""
    return _merged_table(spark, sf_dir).log()


def all_sides(spark, sf_dir) -> DataFrame:
    return latest.either_side(marts.fct_from_source(Tables(spark, sf_dir)), "home_team_id", "away_team_id", None)


def teams_by_name(spark, sf_dir) -> DataFrame:
    return marts.dim_teams(marts.stg_matches(Tables(spark, sf_dir))).orderBy("team_name", "team_id")


def iso_dates(spark, sf_dir) -> DataFrame:
    """Null-on-failure dates (every third text is no date) and dates as timestamps."""
    o = Tables(spark, sf_dir).orders(["o_orderkey", "o_orderdate"])
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), day)).otherwise(day)
    return o.select("o_orderkey", iso_date(text).alias("iso"),
                    F.date_format(to_timestamp_ntz(F.to_date("o_orderdate")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def report_metrics(spark, sf_dir) -> DataFrame:
    """Trials written as nested JSON reports, read back, metrics taken by exact paths (a name
    that merely ends alike is another metric); a missing metric is NULL."""
    t = runs.trials(spark, sf_dir).select("trial", "mode", F.struct(
        F.struct(F.when(F.col("purchases") > 0, F.col("purchases")).alias("total")).alias("purchases"),
        F.struct((F.col("events") * 10).alias("total")).alias("not_events"),
        F.struct(F.col("events").alias("total")).alias("events")).alias("report"))
    path = scratch_path(spark, "reports")
    files.write_report(t, path)
    # a report that broke off in every fifth trial's place, and a folder that is not there
    t.filter("trial % 5 = 0").select(F.concat(F.lit('{"trial": '), F.col("trial").cast("string"), F.lit(', "mode": "broken')).alias("value")).write.mode("append").text(path)
    got = files.json_reports(spark, path, t.schema).unionByName(files.json_reports(spark, f"{path}-missing", t.schema))
    js = F.to_json("report")
    metric = lambda *p: first_path(js, list(p)).cast("bigint")
    return got.select("trial", "mode", metric("$.bought.total", "$.purchases.total").alias("purchases"),
                      metric("$.events.total").alias("events"))


# The names under which the trial reports may hold a metric, in order.
ALIASES = [("purchases", 0, "bought.total"), ("purchases", 1, "purchases.total"), ("events", 0, "events.total"), ("absent", 0, "nowhere")]


def alias_metrics(spark, sf_dir) -> DataFrame:
    """Trials as nested JSON reports, metrics found by the ends of their paths. Two paths end in
    ``events.total``: the first in document order counts and the metric is flagged."""
    t = runs.trials(spark, sf_dir).select("trial", F.to_json(F.struct(
        F.struct(F.struct(F.col("purchases").alias("total")).alias("purchases")).alias("sums"),
        F.struct((F.col("events") * 10).alias("total")).alias("not_events"),
        F.struct(F.col("events").alias("total")).alias("events"))).alias("report"))
    aliases = spark.createDataFrame(ALIASES, "metric string, position int, alias string")
    found = reports.resolve(reports.leaves(t, "trial", "report"), aliases)
    return found.select(F.col("id").alias("trial"), "metric", "path", F.col("value").cast("bigint").alias("value"), "ambiguous")


def trial_records(spark, sf_dir) -> DataFrame:
    """A row per trial with a column per event type: leaves of the trials' nested counts, pivoted."""
    e = Tables(spark, sf_dir).events(["user_id", "event_type"])
    n = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    docs = n.groupBy("user_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n")))).alias("by_type"))).alias("report"))
    kinds = ("click", "error", "purchase", "signup", "view")
    aliases = spark.createDataFrame([(k, 0, f"by_type.{k}.n") for k in kinds], "metric string, position int, alias string")
    table = reports.records(reports.resolve(reports.leaves(docs, "user_id", "report"), aliases), list(kinds))
    return table.select(F.col("id").alias("user_id"), *[F.coalesce(F.col(k).cast("bigint"), F.lit(0)).alias(k) for k in kinds])


def json_leaves(spark, sf_dir) -> DataFrame:
    """Paths and types of the events' properties, and how many events have each."""
    e = Tables(spark, sf_dir).events(["event_id", "props"])
    return reports.leaves(e, "event_id", "props").groupBy("path", "type").agg(F.count(F.lit(1)).alias("events"))


def contained_names(spark, sf_dir) -> DataFrame:
    """Which parts' names contain which words of three letters or more from the brands' and types' names."""
    p = Tables(spark, sf_dir).part(["p_partkey", "p_name", "p_type"])
    words = p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("name")).filter(F.length("name") > 2).distinct()
    parts = p.select("p_partkey", F.lower("p_name").alias("text"))
    first = parts.select(F.substring("text", 1, 4).alias("name")).distinct()
    hit = textmatch.containment(words.union(first).distinct(), parts)
    return hit.groupBy("name").agg(F.count(F.lit(1)).alias("parts"), F.count_if("prefix").alias("starts"))


def schema_drift(spark, sf_dir) -> DataFrame:
    """Event documents against the last landing's: erroneous events have a new field and text for a number."""
    e = Tables(spark, sf_dir).events(["event_id", "event_type", "value"])
    error = F.col("event_type") == "error"
    last = e.select(F.to_json(F.struct(F.struct("event_type", "event_id").alias("event"), F.col("event_id").alias("n"), F.lit(True).alias("old"))).alias("js"))
    now = e.select(F.to_json(F.struct(
        F.struct("event_type", F.when(error, F.lit("x")).alias("code")).alias("event"),
        F.when(error, F.lit('"text"')).otherwise(F.col("event_id").cast("string")).alias("n"))).alias("js"))
    now = now.select(F.regexp_replace(F.regexp_replace("js", r'"n":"([0-9]+)"', r'"n":$1'), r'\\\\"', "").alias("js"))
    return schema.drift(schema.inferred(last, "js"), schema.inferred(now, "js")).select("path", "change")


def stored_variant(spark, sf_dir) -> DataFrame:
    """Event documents landed as a VARIANT column; two fields read back by path."""
    docs = events.event_documents(events.event_rows(Tables(spark, sf_dir)))
    table = schema.land(spark, docs, "json", scratch_path(spark, "variant"))
    e = table.select(F.explode(F.variant_get("raw", "$.events", "array<variant>")).alias("e"))
    return e.select(F.variant_get("e", "$.idEvent", "string").alias("idEvent"), F.variant_get("e", "$.strStatus", "string").alias("strStatus"))


def copy_chunks(spark, sf_dir) -> DataFrame:
    """Orders copied in chunks: stopped after the first wave, then resumed; rows per state of the ledger."""
    orders, path = Tables(spark, sf_dir).orders(), scratch_path(spark, "copied")
    copying.copy(orders, path, "o_orderkey", chunks=12, wave=5, stop_after=1)
    done = copying.copy(orders, path, "o_orderkey", chunks=12, wave=7)
    both = copying.copied(spark, path, orders.schema).agg(F.count(F.lit(1)).alias("copied_rows"), F.sum("o_orderkey").alias("key_sum"))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("chunks"), F.sum("rows").alias("rows")).join(both)


def suite_trees(spark, sf_dir) -> DataFrame:
    """The baseline suite's document merged with the suggestions' documents as trees, flattened again."""
    from ..operators.suggest import suggest
    from . import experiment, suites, warehouse
    m = experiment.clean_marts(spark, sf_dir)
    base = rules.render_suites(warehouse.rules_frame(spark, suites.suite_rules("manual_only"), "baseline"))
    new = rules.render_suites(warehouse.rules_frame(spark, suggest({"dim_teams": m["dim_teams"], "fct_matches": m["fct_matches"]}), "suggested"))
    # a document per model on either side, numbered by the models' order
    number = F.when(F.col("model") == "dim_teams", 0).otherwise(1).alias("position")
    merged = rules.merge_documents(base.select(number, "suite"), new.select(number, "suite"))
    return rules.flatten_documents(merged).select("model", "column", "test", "args")


def csv_run_totals(spark, sf_dir) -> DataFrame:
    """A flat report as CSV with a header, read back."""
    path = scratch_path(spark, "totals")
    files.write_report(runs.run_totals(spark, sf_dir).select("run_id", "stages"), path, "csv")
    return spark.read.option("header", True).schema("run_id bigint, stages bigint").csv(path)


def stage_log(spark, sf_dir) -> DataFrame:
    """Stage records appended in two goes to the run log and read back."""
    path = scratch_path(spark, "stage-log")
    st = runs.stages(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("run"), F.col("run_id").cast("string")))
    for half in (0, 1):
        runlog.append_stages(st.filter(F.pmod("run_id", F.lit(2)) == half), path)
    log = runlog.read_stages(spark, path)
    return log.groupBy("stage_name", "status").agg(F.count(F.lit(1)).alias("records"),
                                                   F.count_distinct(F.col("metadata")["run"]).alias("runs"))


def suite_documents(spark, sf_dir) -> DataFrame:
    """One suite document per nation, five of six with a fault of their own."""
    n, name = F.col("n_nationkey") % 6, F.col("n_name")
    model = F.concat(F.lit('{"name": "'), name, F.lit('", "columns": []}'))
    doc = (F.when(n == 0, F.concat(F.lit('{"version": 2, "models": ['), model, F.lit("]}")))
           .when(n == 1, F.lit("{no json")).when(n == 2, F.lit('["list"]'))
           .when(n == 3, F.concat(F.lit('{"models": ['), model, F.lit("]}")))
           .when(n == 4, F.concat(F.lit('{"version": 2, "models": ['), model, F.lit(", "), model, F.lit("]}")))
           .otherwise(F.lit('{"version": 2, "models": [{"name": "other"}]}')))
    return Tables(spark, sf_dir).nation(["n_nationkey", "n_name"]).select("n_name", doc.alias("suite"))


def suite_validation(spark, sf_dir) -> DataFrame:
    return rules.validate_documents(suite_documents(spark, sf_dir), "suite", "n_name").select("n_name", "valid", "reason")


def label_counts(spark, sf_dir) -> DataFrame:
    return predict.features(spark, sf_dir).select(*ml.FEATURES, ml.LABEL).groupBy(ml.LABEL).agg(F.count(F.lit(1)).alias("rows"))


def pair_inputs(spark, sf_dir) -> DataFrame:
    """What the classifier is asked for every pairing that occurred."""
    return predict.pair_features(marts.as_table(predict.features(spark, sf_dir), "features"))


def pair_probability_sums(spark, sf_dir) -> DataFrame:
    """Class probabilities of every pairing add up to one, also after saving and loading the model."""
    feat = marts.as_table(predict.features(spark, sf_dir), "features")
    model, _ = ml.train_evaluate(feat)
    path = scratch_path(spark, "model")
    ml.save(model, path)
    scored = ml.class_probabilities(ml.load(path), predict.pair_features(feat))
    total = sum((F.col(f"p_{c.lower()}") for c in ml.CLASSES), F.lit(0.0))
    return scored.select("home_team_id", "away_team_id", F.round(total, 6).alias("probability"),
                         F.col("predicted").isin(ml.CLASSES).alias("known_class"))


_PAIRS = "WITH " + oracle.MARTS + """,
h AS (SELECT DISTINCT ON (home_team_id) * FROM features ORDER BY home_team_id, match_date DESC NULLS LAST, match_id DESC NULLS LAST),
a AS (SELECT DISTINCT ON (away_team_id) * FROM features ORDER BY away_team_id, match_date DESC NULLS LAST, match_id DESC NULLS LAST),
p AS (SELECT DISTINCT home_team_id, away_team_id FROM features WHERE home_team_id <> away_team_id)
"""

_MERGED = oracle.FCT + f""",
merged AS (SELECT * REPLACE (home_team_score + CASE WHEN season = '{oracle.UPSERT_SEASON}' THEN 101 ELSE 0 END AS home_team_score)
           FROM fct WHERE match_date <= DATE '{CUTOFF}' OR season = '{oracle.UPSERT_SEASON}')"""

EXTRAS = {
    "landed_documents": (landed_documents, oracle.NESTED_EXPLODE),
    "full_refresh": (full_refresh, oracle.FACT_FINISHED),
    "incremental_load": (incremental_load, "WITH " + oracle.FCT + f""",
t0 AS (SELECT * FROM fct WHERE match_date <= DATE '{CUTOFF}')
SELECT * REPLACE (home_team_score + CASE WHEN match_date <= DATE '{CUTOFF}' THEN 0 ELSE 101 END AS home_team_score) FROM fct
WHERE match_date <= DATE '{CUTOFF}' OR match_date > (SELECT max(match_date) FROM t0) OR (SELECT count(*) FROM t0) = 0"""),
    "partition_merge": (partition_merge, "WITH " + _MERGED + " SELECT * FROM merged"),
    "partition_merge_log": (partition_merge_log, "WITH " + _MERGED + f""" SELECT strftime(match_date, '%Y-%m') AS partition,
       CAST(max(CASE WHEN season = '{oracle.UPSERT_SEASON}' THEN 1 ELSE 0 END) AS INTEGER) AS epoch, count(*) AS rows,
       strftime(max(match_date), '%Y-%m-%d') AS high FROM merged GROUP BY 1"""),
    "all_sides": (all_sides, oracle.FACT_FINISHED),
    "teams_by_name": (teams_by_name, oracle.ENTITY_DIM),
    "iso_dates": (iso_dates, """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso,
       strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' 00:00:00' AS "at" FROM orders"""),
    "report_metrics": (report_metrics, "WITH " + oracle.TRIALS + " SELECT trial, mode, nullif(purchases, 0) AS purchases, events FROM trials"),
    "alias_metrics": (alias_metrics, "WITH " + oracle.TRIALS + """
SELECT trial, 'purchases' AS metric, 'sums.purchases.total' AS path, purchases AS value, false AS ambiguous FROM trials
UNION ALL SELECT trial, 'events', 'not_events.total', events * 10, true FROM trials"""),
    "trial_records": (trial_records, """SELECT user_id, """ + ", ".join(
        f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id"),
    "json_leaves": (json_leaves, """SELECT lower(k) AS path, CASE json_type(props, '$.' || k) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT'
       ELSE json_type(props, '$.' || k) END AS type, count(*) AS events
FROM (SELECT props, UNNEST(json_keys(props)) AS k FROM events) GROUP BY ALL"""),
    "contained_names": (contained_names, """WITH p AS (SELECT p_partkey, lower(p_name) AS t, lower(p_type) AS ty FROM part),
n AS (SELECT DISTINCT w AS name FROM (SELECT UNNEST(string_split(ty, ' ')) AS w FROM p) WHERE length(w) > 2 UNION SELECT DISTINCT substr(t, 1, 4) FROM p)
SELECT name, count(*) AS parts, count(*) FILTER (WHERE starts_with(t, name)) AS starts FROM n JOIN p ON contains(t, name) GROUP BY name"""),
    "schema_drift": (schema_drift, """SELECT * FROM (VALUES ('event.event_id', 'lost'), ('old', 'lost')) AS v(path, change)
UNION ALL SELECT * FROM (VALUES ('event.code', 'added'), ('n', 'retyped')) AS w(path, change)
WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'error')"""),
    "stored_variant": (stored_variant, f"SELECT idEvent, strStatus FROM ({oracle.NESTED_EXPLODE})"),
    "copy_chunks": (copy_chunks, """SELECT 'done' AS status, 12 AS chunks, count(*) AS rows, count(*) AS copied_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders"""),
    "suite_trees": (suite_trees, f"SELECT model, \"column\", test, replace(replace(args, '\": ', '\":'), ', \"', ',\"') AS args FROM ({oracle.rules_merge_sql()})"),
    "csv_run_totals": (csv_run_totals, "WITH " + oracle.STAGES + " SELECT run_id, count(*) AS stages FROM latest GROUP BY run_id"),
    "stage_log": (stage_log, "WITH " + oracle.STAGES + """ SELECT stage_name, status, count(*) AS records,
       count(DISTINCT run_id) AS runs FROM stages2 GROUP BY ALL"""),
    "suite_validation": (suite_validation, """SELECT n_name, n_nationkey % 6 = 0 AS valid, CASE n_nationkey % 6 WHEN 1 THEN 'not JSON'
       WHEN 2 THEN 'root is no mapping' WHEN 3 THEN 'no version' WHEN 4 THEN 'not exactly one model' WHEN 5 THEN 'unexpected model name' END AS reason
FROM nation"""),
    "label_counts": (label_counts, "WITH " + oracle.MARTS + " SELECT match_result, count(*) AS rows FROM features GROUP BY ALL"),
    "pair_inputs": (pair_inputs, _PAIRS + """SELECT p.home_team_id, p.away_team_id, h.home_avg_goals_scored_last_5, h.home_avg_goals_conceded_last_5,
       a.away_avg_goals_scored_last_5, a.away_avg_goals_conceded_last_5
FROM p JOIN h ON p.home_team_id = h.home_team_id JOIN a ON p.away_team_id = a.away_team_id"""),
    "pair_probability_sums": (pair_probability_sums, _PAIRS + "SELECT home_team_id, away_team_id, 1.0 AS probability, true AS known_class FROM p"),
}
