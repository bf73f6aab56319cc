"""Declarative column rules evaluated as fused Spark jobs.

Rule kinds and their failure counts:

* ``not_null``        rows where the column is NULL;
* ``unique``          number of non-NULL values that occur more than once;
* ``accepted_values`` number of *distinct* non-NULL values outside the list;
* ``relationships``   child rows whose non-NULL value has no parent row.

Per model the engine runs one aggregate for every ``not_null`` rule, one grouped count per
column-type family for all ``unique`` and ``accepted_values`` rules, and one anti join per
(parent model, parent column) for all ``relationships`` rules pointing there. Results
are a small table; a rule whose model, column, value list or target does not exist or fit
gets status ``error`` and the rest run.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import number_key

TESTS = ("not_null", "unique", "accepted_values", "relationships")

RESULT_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType(), False),
    T.StructField("failures", T.LongType(), True),
    T.StructField("failing_rows", T.LongType(), True),
])


@dataclass(frozen=True)
class Rule:
    model: str
    column: str
    test: str
    args: tuple = field(default=())  # sorted (key, value) pairs; values JSON-encoded

    @staticmethod
    def make(model: str, column: str, test: str, **args) -> "Rule":
        return Rule(model, column, test, tuple(sorted((k, json.dumps(v)) for k, v in args.items())))

    def arg(self, name, default=None):
        for k, v in self.args:
            if k == name:
                return json.loads(v)
        return default

    @property
    def args_json(self) -> str:
        return json.dumps({k: json.loads(v) for k, v in self.args}, sort_keys=True)

    @property
    def key(self) -> str:
        """Canonical identity (model, column, test, sorted args)."""
        return "|".join([self.model, self.column, self.test, self.args_json])

    @property
    def name(self) -> str:
        """Conventional test name: ``{test}_{model}_{column}`` plus argument suffixes."""
        base = f"{self.test}_{self.model}_{self.column}"
        if self.test == "accepted_values":
            vals = [re.sub(r"[^0-9A-Za-z]+", "_", str(v)) for v in self.arg("values", [])]
            return base + "__" + "__".join(vals)
        if self.test == "relationships":
            return f"{base}__{self.arg('field')}__ref_{self.arg('to')}_"
        return base


def rules_frame(spark: SparkSession, rules: list[Rule], extra: dict[str, list] | None = None) -> DataFrame:
    """Rules as a DataFrame (rule_id = list position)."""
    extra = extra or {}
    rows = []
    for i, r in enumerate(rules):
        rows.append((i, r.model, r.column, r.test, r.args_json, r.name, *[extra[k][i] for k in extra]))
    schema = ("rule_id int, model string, column string, test string, args string, test_name string"
              + "".join(f", {k} string" for k in extra))
    return spark.createDataFrame(rows, schema)


def _not_null_rules(df: DataFrame, items: list[tuple[int, Rule]]) -> DataFrame | None:
    """One pass of plain conditional counts for all not_null rules of a model."""
    if not items:
        return None
    one = df.agg(*[F.count_if(F.col(r.column).isNull()).alias(f"r{i}") for i, r in items])
    stack = ", ".join(f"{i}, r{i}, r{i}" for i, _ in items)
    return one.selectExpr(f"stack({len(items)}, {stack}) as (rule_id, failures, failing_rows)")


def _type_family(dt) -> str:
    return "bigint" if isinstance(dt, T.IntegralType) else dt.simpleString()


def allowed_values(r: Rule, dtype: T.DataType) -> list | None:
    """The rule's value list in the column's type; None where it has no list or one that
    does not fit the type."""
    values = r.arg("values")
    if not isinstance(values, list) or not values:
        return None
    try:
        if isinstance(dtype, T.IntegralType):
            return [int(str(v)) for v in values]
        if isinstance(dtype, T.FractionalType):
            return [float(str(v)) for v in values]
        if isinstance(dtype, T.BooleanType):
            return [{"true": True, "false": False}[str(v).lower()] for v in values]
        if isinstance(dtype, T.DateType):
            return [datetime.date.fromisoformat(str(v)) for v in values]
        return [str(v) for v in values] if isinstance(dtype, T.StringType) else None
    except (ValueError, KeyError):
        return None


def _value_rules(df: DataFrame, items: list[tuple[int, Rule]]) -> DataFrame | None:
    """All unique and accepted_values rules of a model: one pass per column-type family.

    Rows are exploded to (rule, value) — for accepted_values only the values outside the
    list, so only violations move — and grouped; partial aggregation combines hot values
    before the shuffle. unique counts values seen more than once, accepted_values counts
    distinct disallowed values. Values stay typed (integral columns widened to bigint).
    """
    fams: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in items:
        fams.setdefault(_type_family(df.schema[r.column].dataType), []).append((i, r))
    out = None
    for fam, xs in fams.items():
        pairs = []
        for i, r in xs:
            c, single = F.col(r.column), r.test == "unique"
            v = c if single else F.when(~c.isin(allowed_values(r, df.schema[r.column].dataType)), c)
            pairs.append(F.struct(F.lit(i).alias("rule_id"), F.lit(2 if single else 1).alias("least"), v.cast(fam).alias("v")))
        e = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter(F.col("v").isNotNull())
        bad = e.groupBy("rule_id", "least", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("least"))
        g = bad.groupBy("rule_id").agg(F.count(F.lit(1)).alias("failures"), F.sum("n").alias("failing_rows"))
        out = g if out is None else out.unionByName(g)
    return out


def _unique_rules(df: DataFrame, items: list[tuple[int, Rule]]) -> DataFrame | None:
    """The unique rules alone (used by the suggestion step)."""
    return _value_rules(df, items)


NUMBER = "number"      # compared by the digits of number_key


def _common_type(child: T.DataType, parent: T.DataType) -> str:
    """The type in which a child's value is compared with its parent's key: nothing is narrowed
    or rounded. Numbers of different types, and text against numbers, compare by their digits."""
    if isinstance(child, T.IntegralType) and isinstance(parent, T.IntegralType):
        return "bigint"
    if child == parent:
        return parent.simpleString()
    if isinstance(parent, T.NumericType) and isinstance(child, (T.NumericType, T.StringType)):
        return NUMBER
    return parent.simpleString() if isinstance(child, T.StringType) else "string"


def _relationship_rules(df: DataFrame, parent: DataFrame, pfield: str,
                        items: list[tuple[int, Rule]]) -> DataFrame:
    """Child rows without a parent, for every rule targeting ``parent.pfield``.

    Both sides are brought to a common type without loss; a child value that cannot be
    converted has no parent. Child values are pre-aggregated to (rule, value, rows) before
    the anti join, so a hot child value is combined map-side and crosses the shuffle once;
    parent keys are de-duplicated. Failures are child *rows*. One anti join per compared type.
    """
    ptype = parent.schema[pfield].dataType
    as_key = lambda d, c, fam: number_key(F.col(c), d.schema[c].dataType) if fam == NUMBER else F.col(c).try_cast(fam)
    fams: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in items:
        fams.setdefault(_common_type(df.schema[r.column].dataType, ptype), []).append((i, r))
    out = None
    for fam, xs in fams.items():
        pairs = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.col(r.column).isNotNull().alias("set"),
                                   as_key(df, r.column, fam).alias("v")) for i, r in xs])
        child = (df.select(F.explode(pairs).alias("p")).select("p.*").filter("set")
                 .groupBy("rule_id", "v").agg(F.count(F.lit(1)).alias("n")))
        keys = parent.select(as_key(parent, pfield, fam).alias("v")).filter(F.col("v").isNotNull()).distinct()
        g = child.join(keys, "v", "left_anti").groupBy("rule_id").agg(F.sum("n").alias("failures"), F.sum("n").alias("failing_rows"))
        out = g if out is None else out.unionByName(g)
    return out


def evaluate(spark: SparkSession, rules: list[Rule], models: dict[str, DataFrame]) -> DataFrame:
    """Run ``rules`` over ``models`` → (rule_id, model, column, test, args, test_name, status, failures, failing_rows)."""
    parts: list[DataFrame] = []
    errors: list[int] = []
    by_model: dict[str, list[tuple[int, Rule]]] = {}
    cols = {m: set(df.columns) for m, df in models.items()}  # one schema lookup per model
    for i, r in enumerate(rules):
        if r.model not in cols or r.column not in cols[r.model] or r.test not in TESTS:
            errors.append(i)
            continue
        if r.test == "accepted_values" and allowed_values(r, models[r.model].schema[r.column].dataType) is None:
            errors.append(i)      # no list, or one the column's type cannot hold
            continue
        if r.test == "relationships":
            to = str(r.arg("to"))
            if to not in cols or r.arg("field") not in cols[to]:
                errors.append(i)
                continue
        by_model.setdefault(r.model, []).append((i, r))
    for model, items in by_model.items():
        df = models[model]
        a = _not_null_rules(df, [x for x in items if x[1].test == "not_null"])
        v = _value_rules(df, [x for x in items if x[1].test in ("unique", "accepted_values")])
        parts += [p for p in (a, v) if p is not None]
        rel: dict[tuple[str, str], list] = {}
        for x in items:
            if x[1].test == "relationships":
                rel.setdefault((x[1].arg("to"), x[1].arg("field")), []).append(x)
        for (to, fld), xs in rel.items():
            parts.append(_relationship_rules(df, models[to], fld, xs))
    res = None
    for p in parts:
        p = p.select(F.col("rule_id").cast("int"), F.col("failures").cast("bigint"),
                     F.col("failing_rows").cast("bigint"))
        res = p if res is None else res.unionByName(p)
    if res is None:
        res = spark.createDataFrame([], RESULT_SCHEMA)
    res = res.groupBy("rule_id").agg(F.max("failures").alias("failures"), F.max("failing_rows").alias("failing_rows"))
    rf = rules_frame(spark, rules)
    err = F.col("rule_id").isin(errors) if errors else F.lit(False)
    out = rf.join(res, "rule_id", "left")
    failures = F.when(err, F.lit(None).cast("bigint")).otherwise(F.coalesce("failures", F.lit(0).cast("bigint")))
    failing = F.when(err, F.lit(None).cast("bigint")).otherwise(F.coalesce("failing_rows", F.lit(0).cast("bigint")))
    status = F.when(err, F.lit("error")).when(failures != 0, F.lit("fail")).otherwise(F.lit("pass"))
    return out.select("rule_id", "model", "column", "test", "args", "test_name",
                      status.alias("status"), failures.alias("failures"), failing.alias("failing_rows"))


def rule_sql(r: Rule, table: str | None = None, parent: str | None = None) -> str:
    """Plain SQL for one rule's failure count (the oracle form)."""
    t = table or r.model
    c = r.column
    if r.test == "not_null":
        return f"SELECT count(*) FROM {t} WHERE {c} IS NULL"
    if r.test == "unique":
        return (f"SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL "
                f"GROUP BY {c} HAVING count(*) > 1)")
    if r.test == "accepted_values":
        vals = ", ".join("'" + str(v).replace("'", "''") + "'" for v in r.arg("values", []))
        return f"SELECT count(DISTINCT {c}) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN ({vals})"
    if r.test == "relationships":
        p = parent or r.arg("to")
        f = r.arg("field")
        return (f"SELECT count(*) FROM {t} ch WHERE ch.{c} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {p} pa WHERE pa.{f} = ch.{c})")
    raise ValueError(r.test)


def validate(spark: SparkSession, rules: list[Rule], models: dict[str, DataFrame]) -> DataFrame:
    """Rule-table validation: unknown model / column / test, missing arguments → invalid + reason."""
    cols = {m: set(df.columns) for m, df in models.items()}
    rows = []
    for i, r in enumerate(rules):
        reason = None
        if r.model not in cols:
            reason = f"unknown model {r.model}"
        elif r.column not in cols[r.model]:
            reason = f"unknown column {r.model}.{r.column}"
        elif r.test not in TESTS:
            reason = f"unknown test {r.test}"
        elif r.test == "accepted_values" and not r.arg("values"):
            reason = "accepted_values without values"
        elif r.test == "relationships" and (r.arg("to") not in cols or r.arg("field") not in cols.get(r.arg("to"), ())):
            reason = "relationships target missing"
        rows.append((i, r.model, r.column, r.test, r.args_json, reason is None, reason))
    return spark.createDataFrame(rows, "rule_id int, model string, column string, test string, args string, "
                                       "valid boolean, reason string")


def describe(df: DataFrame, name: str, sample: int = 3) -> tuple[DataFrame, DataFrame]:
    """(column, type) rows of a table and a small sample (the context a rule author needs)."""
    spark = df.sparkSession
    cols = spark.createDataFrame([(name, f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                 "table string, column string, type string")
    return cols, df.limit(sample)
