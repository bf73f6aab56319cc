"""Column rules, profiling and rule suggestion over the warehouse tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import canonical_text
from ..operators import quality
from ..operators.quality import Rule
from ..sources.tables import Tables

NOT_NULL_TABLES = ("orders", "lineitem", "customer", "supplier", "events")


def table_columns(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    t = Tables(spark, sf_dir)
    return {n: t.read(n).columns for n in NOT_NULL_TABLES}


def warehouse_rules(columns: dict[str, list[str]]) -> list[Rule]:
    """The warehouse suite: completeness, keys, domains and foreign keys of the test tables.

    ``columns`` lists the columns of the ``NOT_NULL_TABLES`` (every column is checked)."""
    rules = [Rule.make(t, c, "not_null") for t in NOT_NULL_TABLES for c in columns[t]]
    rules += [Rule.make(t, c, "unique") for t, c in [
        ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("customer", "c_custkey"), ("customer", "c_name"),
        ("supplier", "s_suppkey"), ("part", "p_partkey"), ("nation", "n_nationkey"), ("events", "event_id"),
        ("documents", "doc_id")]]
    rules += [Rule.make(t, c, "accepted_values", values=v) for t, c, v in [
        ("orders", "o_orderstatus", ["F", "O"]), ("lineitem", "l_linestatus", ["F", "O"]),
        ("lineitem", "l_returnflag", ["A", "N", "R"]),
        ("events", "event_type", ["signup", "purchase", "view", "click"]),
        ("customer", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]),
        ("documents", "lang", ["en", "de", "fr"])]]
    rules += [Rule.make(t, c, "relationships", to=p, field=f) for t, c, p, f in [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]]
    return rules


def warehouse_models(spark: SparkSession, sf_dir: str, rules: list[Rule]) -> dict[str, DataFrame]:
    t = Tables(spark, sf_dir)
    names = {r.model for r in rules} | {r.arg("to") for r in rules if r.test == "relationships"}
    return {n: t.read(n) for n in sorted(names)}


def evaluate(spark: SparkSession, sf_dir: str, tests: tuple[str, ...] | None = None) -> DataFrame:
    rules = [r for r in warehouse_rules(table_columns(spark, sf_dir)) if tests is None or r.test in tests]
    res = quality.evaluate(spark, rules, warehouse_models(spark, sf_dir, rules))
    return res.select("model", "column", "test", "args", "test_name", "status", "failures", "failing_rows")


PROFILE_TABLES = ("orders", "lineitem", "customer", "events")


def profile(spark: SparkSession, sf_dir: str, tables=PROFILE_TABLES) -> DataFrame:
    """(table, column, rows, nulls, min_value, max_value): one aggregate per table."""
    out = None
    t = Tables(spark, sf_dir)
    for name in tables:
        df = t.read(name)
        exprs = [F.count(F.lit(1)).alias("_rows")]
        for i, f in enumerate(df.schema.fields):
            c = F.col(f.name)
            shown = (lambda x: x) if isinstance(f.dataType, T.StringType) else (lambda x, t=f.dataType: canonical_text(x, t))
            exprs += [F.count_if(c.isNull()).alias(f"n{i}"), shown(F.min(c)).alias(f"lo{i}"), shown(F.max(c)).alias(f"hi{i}")]
        one = df.agg(*exprs)
        rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col("_rows").alias("rows"),
                                  F.col(f"n{i}").alias("nulls"), F.col(f"lo{i}").alias("min_value"),
                                  F.col(f"hi{i}").alias("max_value")) for i, f in enumerate(df.schema.fields)])
        p = one.select(F.lit(name).alias("table"), F.explode(rows).alias("p")).select("table", "p.*")
        out = p if out is None else out.unionByName(p)
    return out


def rules_frame(spark: SparkSession, rules: list[Rule], origin: str | None = None) -> DataFrame:
    rows = [(i, r.model, r.column, r.test, r.args_json) for i, r in enumerate(rules)]
    df = spark.createDataFrame(rows, "position int, model string, column string, test string, args string")
    return df if origin is None else df.withColumn("origin", F.lit(origin))
