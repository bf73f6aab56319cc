"""Rules as a table, evaluated for many runs at once.

``evaluate`` takes rules as rows (run_id, rule_id, model, column, test, args) and the tables of
every run. Rows are unpivoted once to (run, model, column, value) and counted, so one shuffle
with map-side combination serves all rules: NULLs, repeated values, values outside a list and
values without a parent are all read off these counts by joins on the rules' columns. The
counts are the large side whatever their file's size says: rules are broadcast to them (or, if
there are many, both are shuffled), and values meet their parents in a shuffle on the value. No
expression is built per rule: the plan depends on the tables and their columns, not on how
many rules there are, and the driver never sees the rules.

Values are compared as text that equal values share whatever their type (numbers by their
digits, dates as ISO text), as in ``quality``; a rule that cannot run (unknown model, column
or test, a value list that does not fit the column, no target) has status ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import canonical_text, number_key
from ..session import scratch_path
from .quality import TESTS

RUN = ["run_id", "rule_id"]
SMALL = 200_000      # rules up to which they are broadcast
WHOLE, NUMBER, FLAG, DAY, TEXT, OTHER = "int", "number", "boolean", "date", "string", "other"


def kind_of(dtype: T.DataType) -> str:
    for kind, types in ((WHOLE, T.IntegralType), (NUMBER, T.FractionalType), (FLAG, T.BooleanType), (DAY, T.DateType), (TEXT, T.StringType)):
        if isinstance(dtype, types):
            return kind
    return OTHER


def _value(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return c
    return number_key(c, dtype) if isinstance(dtype, T.NumericType) else canonical_text(c, dtype)


def _as_kind(text: Column, kind: Column) -> Column:
    """Text (of an argument, or of a text column) as a value of ``kind``; NULL where it is none."""
    return (F.when(kind == WHOLE, F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), number_key(text, T.StringType())))
            .when(kind == NUMBER, number_key(text, T.StringType()))
            .when(kind == FLAG, F.when(F.lower(text).isin("true", "false"), F.lower(text)))
            .when(kind == DAY, F.date_format(F.try_to_date(text), "yyyy-MM-dd")).when(kind == TEXT, text))


def _unpivoted(run: str, model: str, df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """(run_id, model, column, value, n) of the named columns; where only NULLs matter all other values count as one."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cell = [F.struct(F.lit(c).alias("column"), (_value(F.col(f"`{c}`"), types[c]) if whole else
                                               F.when(F.col(f"`{c}`").isNotNull(), F.lit("")))
                     .alias("value")) for c, whole in sorted(columns.items()) if c in types]
    return (df.select(F.explode(F.array(*cell)).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(run).alias("run_id"), F.lit(model).alias("model"), "column", "value", "n"))


def evaluate(rules: DataFrame, runs: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Results of every rule of every run: the rules' columns with status, failures, failing_rows."""
    spark = rules.sparkSession
    arg = lambda name: F.get_json_object("args", f"$.{name}")
    rules = rules.withColumns({"_to": arg("to"), "_field": arg("field"),
                               "_values": F.from_json(arg("values"), "array<string>")})
    # columns that any rule reads, and whether it reads their values (at most the columns of the tables)
    used = (rules.select("run_id", F.explode(F.array(
                F.struct(F.col("model"), F.col("column"), (F.col("test") != "not_null").alias("whole")),
                F.struct(F.col("_to").alias("model"), F.col("_field").alias("column"), F.lit(True).alias("whole")))).alias("u"))
            .filter("u.model IS NOT NULL AND u.column IS NOT NULL").groupBy("run_id", "u.model", "u.column").agg(F.max("u.whole").alias("whole")))
    kinds = spark.createDataFrame([(r, m, f.name, kind_of(f.dataType)) for r, models in runs.items() for m, df in models.items()
                                   for f in df.schema.fields], "run_id string, model string, column string, kind string")
    wanted: dict[tuple[str, str], dict[str, bool]] = {}
    for x in used.join(kinds, ["run_id", "model", "column"]).collect():
        wanted.setdefault((x.run_id, x.model), {})[x.column] = x.whole
    cells = None
    for (run, model), columns in sorted(wanted.items()):
        one = _unpivoted(run, model, runs[run][model], columns)
        cells = one if cells is None else cells.unionByName(one)
    if cells is None:
        cells = spark.createDataFrame([], "run_id string, model string, column string, value string, n bigint")
    path = scratch_path(spark, "cells")
    cells.write.parquet(path)
    cells = spark.read.parquet(path)

    target = kinds.select("run_id", F.col("model").alias("_to"), F.col("column").alias("_field"), F.col("kind").alias("_tkind"))
    known = rules.join(kinds, ["run_id", "model", "column"], "left").join(target, ["run_id", "_to", "_field"], "left")
    allowed = F.transform("_values", lambda v: _as_kind(v, F.col("kind")))
    listed, linked = F.col("test") == "accepted_values", F.col("test") == "relationships"
    wrong = (F.col("kind").isNull() | ~F.col("test").isin(*TESTS)
             | (listed & (F.coalesce(F.size("_values"), F.lit(0)) <= 0)) | (listed & F.coalesce(F.exists(allowed, lambda v: v.isNull()), F.lit(True)))
             | (linked & F.col("_tkind").isNull()))
    known = known.withColumns({"_error": F.coalesce(wrong, F.lit(True)), "_allowed": allowed})
    fit = known.filter(~F.col("_error"))
    # a rule's values; a text value is read as the parent's kind
    key = F.when(linked, F.when((F.col("kind") == TEXT) & (F.col("_tkind") != TEXT), _as_kind(
        F.col("value"), F.when(F.col("_tkind") == WHOLE, F.lit(NUMBER)).otherwise(F.col("_tkind")))).otherwise(F.col("value")))
    many = rules.count() > SMALL
    beside = lambda df: df.hint("merge") if many else F.broadcast(df)
    cell = cells.join(beside(fit), ["run_id", "model", "column"]).select(
        *RUN, "test", "_to", "_field", "value", "n", key.alias("_key"), F.when(listed, F.col("value")).alias("_item"))
    inside = fit.filter(listed).select(*RUN, F.explode(F.array_distinct("_allowed")).alias("_item"), F.lit(True).alias("_in"))
    parents = cells.filter("value IS NOT NULL").select("run_id", F.col("model").alias("_to"), F.col("column").alias("_field"),
                                                      F.col("value").alias("_key"), F.lit(True).alias("_has"))
    # only values of relationships look for a parent, only those of lists for an item
    none = F.lit(None).cast("boolean")
    cell = (cell.filter(linked).join(parents.hint("merge"), ["run_id", "_to", "_field", "_key"], "left").withColumn("_in", none)
            .unionByName(cell.filter(listed).join(inside, [*RUN, "_item"], "left").withColumn("_has", none))
            .unionByName(cell.filter(~linked & ~listed).withColumns({"_in": none, "_has": none})))
    set_ = F.col("value").isNotNull()
    bad = (F.when(F.col("test") == "not_null", ~set_).when(F.col("test") == "unique", set_ & (F.col("n") > 1))
           .when(listed, set_ & F.col("_in").isNull()).otherwise(set_ & F.col("_has").isNull()))
    by_value = F.col("test").isin("unique", "accepted_values")      # they count values, the others rows
    found = cell.filter(bad).groupBy(*RUN).agg(F.sum(F.when(by_value, F.lit(1)).otherwise(F.col("n"))).alias("failures"), F.sum("n").alias("failing_rows"))
    out = known.join(found, RUN, "left")
    count = lambda c: F.when(~F.col("_error"), F.coalesce(c, F.lit(0).cast("bigint"))).cast("bigint")
    status = F.when(F.col("_error"), "error").when(F.col("failures") > 0, "fail").otherwise("pass")
    plain = [c for c in rules.columns if not c.startswith("_")]
    return out.select(*plain, status.alias("status"), count(F.col("failures")).alias("failures"), count(F.col("failing_rows")).alias("failing_rows"))
