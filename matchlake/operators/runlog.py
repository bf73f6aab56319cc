"""Run analytics: stage records, latest successful stage, trial statistics, log parsing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest_by

# Patterns of a test-runner log (lines begin with a clock time or not).
SUMMARY_COUNTERS = ("PASS", "WARN", "ERROR", "SKIP", "NO-OP", "TOTAL")
CLOCK = r"^(?:\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\s+)?"
TEST_LINE = CLOCK + r"\d+ of \d+ (PASS|FAIL|WARN|ERROR|SKIP)(?: (\d+))? (\S+)"
FINISHED = r"Finished running .* in .*\(([0-9.]+)s\)"
FOUND = {"models": r"Found (?:.*, )?(\d+) models?\b", "data_tests": r"Found (?:.*, )?(\d+) data tests?\b",
         "sources": r"Found (?:.*, )?(\d+) sources?\b"}


def duration_seconds(start: Column, end: Column, places: int = 3) -> Column:
    """Seconds between two timestamps, rounded (microsecond arithmetic, no float time)."""
    s = F.unix_micros(start.cast("timestamp"))
    e = F.unix_micros(end.cast("timestamp"))
    return F.round((e - s) / F.lit(1_000_000), places)


def stage_records(df: DataFrame, run: str, stage: str, start: str, end: str, status: str, seq: str) -> DataFrame:
    """Normalised stage log: (run_id, stage_name, start_ts, end_ts, duration_seconds, status, seq)."""
    return df.select(F.col(run).alias("run_id"), F.col(stage).alias("stage_name"), F.col(start).alias("start_ts"),
                     F.col(end).alias("end_ts"), duration_seconds(F.col(start), F.col(end)).alias("duration_seconds"),
                     F.col(status).alias("status"), F.col(seq).alias("seq"))


def latest_successful(stages: DataFrame, ok: str = "success") -> DataFrame:
    """Per (run, stage): the last successful record (later entries overwrite earlier ones)."""
    return latest_by(stages, ["run_id", "stage_name"], ["end_ts", "seq"], where=F.col("status") == ok)


def run_totals(latest: DataFrame) -> DataFrame:
    """Per run: number of stages and total of their latest successful durations (3 dp)."""
    return latest.groupBy("run_id").agg(F.count(F.lit(1)).alias("stages"),
                                        F.round(F.sum("duration_seconds"), 3).alias("total_duration_seconds"))


def metric_stats(df: DataFrame, group: str, metrics: list[str], places: int = 4) -> DataFrame:
    """Per group and metric: n, mean, population std, min, max (n=1 → std 0; n=0 → NULLs).

    One aggregate for all metrics, unpivoted afterwards."""
    exprs = []
    for i, m in enumerate(metrics):
        c = F.col(m).cast("double")
        exprs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"a{i}"), F.stddev_pop(c).alias(f"s{i}"),
                  F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    g = df.groupBy(group).agg(*exprs)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n{i}").alias("n"),
                              F.round(F.col(f"a{i}"), places).alias("mean"),
                              F.round(F.col(f"s{i}"), places).alias("std"),
                              F.round(F.col(f"lo{i}"), places).alias("min"),
                              F.round(F.col(f"hi{i}"), places).alias("max")) for i, m in enumerate(metrics)])
    return g.select(group, F.explode(rows).alias("x")).select(group, "x.*")


def render_log(results: DataFrame, total: int, models: int, clock: str = "00:00:00") -> DataFrame:
    """Test results → runner-style log lines (``value``): what was found, one line per test, a summary.

    Lines are numbered by the rule's declared position (``rule_id``), so no ordering
    window or extra pass is needed; ``total`` is the number of rules in the suite."""
    at = F.lit(f"{clock}  ")
    word = F.upper(F.col("status"))
    tail = F.when(F.col("status") == "fail", F.concat(F.lit("FAIL "), F.col("failures").cast("string"))) \
        .otherwise(word)
    lines = results.select(F.concat(at, (F.col("rule_id") + 1).cast("string"), F.lit(f" of {total} "),
                                    tail, F.lit(" "), F.col("test_name"), F.lit(" ..... ["), tail,
                                    F.lit(" in 0.10s]")).alias("value"))
    cnt = results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "error")])
    summary = cnt.select(F.explode(F.array(
        F.concat(at, F.lit(f"Found {models} models, {total} data tests, 1 source, 475 macros")),
        F.concat(at, F.lit("Done. PASS="), F.col("pass").cast("string"), F.lit(" WARN=0 ERROR="),
                 (F.col("error") + F.col("fail")).cast("string"), F.lit(" SKIP=0 NO-OP=0 TOTAL="),
                 (F.col("pass") + F.col("fail") + F.col("error")).cast("string")))).alias("value"))
    return lines.unionByName(summary)


def _log(lines: DataFrame) -> list[str]:
    """The columns that tell logs apart: the file, where the lines carry it."""
    return ["file"] if "file" in lines.columns else []


def parse_summary(lines: DataFrame) -> DataFrame:
    """Counters from the ``Done.`` line(s): one row per log, line and counter (name, value)."""
    done = lines.filter(F.col("value").contains("PASS=") & F.col("value").contains("TOTAL="))
    cs = F.array(*[F.struct(F.lit(k).alias("counter"),
                            F.regexp_extract("value", rf"{k}=(\d+)", 1).try_cast("int").alias("value"))
                   for k in SUMMARY_COUNTERS])
    return done.select(*_log(lines), F.explode(cs).alias("x")).select(*_log(lines), "x.*")


def test_lines(lines: DataFrame) -> DataFrame:
    """Result lines of a log: (file, status, failures, test_name)."""
    part = lambda i: F.regexp_extract("value", TEST_LINE, i)
    return (lines.filter(F.col("value").rlike(TEST_LINE))
            .select(*_log(lines), F.lower(part(1)).alias("status"), part(2).try_cast("bigint").alias("failures"), part(3).alias("test_name")))


def failed_tests(lines: DataFrame) -> DataFrame:
    """Distinct names of failed tests per log, from ``n of m FAIL k name`` lines."""
    return test_lines(lines).filter(F.col("status") == "fail").select(*_log(lines), "test_name").distinct()


def failed_in_order(lines: DataFrame) -> DataFrame:
    """(file, position from 1, test_name): names that follow the word FAIL (and its count) on lines of
    ``ordered_lines``, each once per log, in the order of their first line."""
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    at = F.array_position(words, "FAIL")
    after = lambda k: F.get(words, (at + k - 1).cast("int"))
    name = F.when(after(1).rlike("^[0-9]+$") & after(2).isNotNull(), after(2)).otherwise(after(1))
    named = (lines.filter(F.col("value").contains(" FAIL ") & (at > 0)).select("file", "line_no", name.alias("test_name"))
             .filter(F.col("test_name").isNotNull() & ~F.col("test_name").isin("in", "of", "[FAIL")))
    first = named.groupBy("file", "test_name").agg(F.min("line_no").alias("line_no"))
    return first.select("file", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).alias("position"), "test_name")


def parse_run_stats(lines: DataFrame) -> DataFrame:
    """Run statistics, one row per log: models, data tests and sources found, elapsed seconds."""
    found = lambda p: F.regexp_extract("value", p, 1)
    stats = [F.max(F.when(found(p) != "", found(p).cast("int"))).alias(k) for k, p in FOUND.items()]
    secs = found(FINISHED)
    return lines.groupBy(*_log(lines)).agg(*stats, F.max(F.when(secs != "", secs.cast("double"))).alias("elapsed_seconds"))


STAGE_SCHEMA = ("stage_name string, start_ts timestamp, end_ts timestamp, duration_seconds double, "
                "status string, metadata map<string,string>")


def append_stages(records: DataFrame, path: str) -> None:
    """Append stage records to the run log table (durations derived from the timestamps)."""
    out = records.select("stage_name", "start_ts", "end_ts",
                         duration_seconds(F.col("start_ts"), F.col("end_ts")).alias("duration_seconds"),
                         "status", "metadata")
    out.write.mode("append").parquet(path)


def read_stages(spark, path: str) -> DataFrame:
    """The run log; a missing log is an empty table."""
    from ..sources.files import missing_path
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return spark.createDataFrame([], STAGE_SCHEMA)
