"""Rule-set algebra over rule *tables* (model, column, test, args, ...).

Rules are data: many suites and many runs are just more rows, so merging, membership
and the usefulness audit are joins and combinable aggregates, never driver loops. Where the
tables hold several runs, ``by`` names the columns that tell them apart (``["run_id"]``):
every step is then taken within each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["model", "column", "test", "args"]


def canonical_key() -> F.Column:
    return F.concat_ws("|", *[F.col(c) for c in KEY])


def merge(base: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Base rules first (in their order), then new rules not already present.

    Output: (priority, position, model, column, test, args, origin); the merged order is
    (priority, position). De-duplication keeps the first occurrence via ``min(struct)``.
    """
    u = (base.select(*by, F.lit(0).alias("priority"), "position", *KEY, "origin")
         .unionByName(new.select(*by, F.lit(1).alias("priority"), "position", *KEY, "origin")))
    g = u.groupBy(*by, *KEY).agg(F.min(F.struct("priority", "position", "origin")).alias("f"))
    return g.select(*by, F.col("f.priority").alias("priority"), F.col("f.position").alias("position"), *KEY,
                    F.col("f.origin").alias("origin"))


def not_in(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rules of ``a`` whose canonical key is absent from ``b``."""
    return a.join(b.select(*by, *KEY).distinct(), [*by, *KEY], "left_anti")


def useful_families(detections: DataFrame, detectors: DataFrame, condition: str,
                    baseline: str = "manual_only", by: Sequence[str] = ()) -> DataFrame:
    """(test, model, column) of detectors whose anomaly ``condition`` caught and the baseline
    missed in the same batch."""
    d = detections.filter(F.col("condition").isin(condition, baseline))
    g = d.groupBy(*dict.fromkeys([*by, "batch_id", "anomaly_id"])).agg(
        F.max(F.when(F.col("condition") == condition, F.col("detected"))).alias("c"),
        F.max(F.when(F.col("condition") == baseline, F.col("detected"))).alias("b"))
    gained = g.filter(F.col("c") & ~F.coalesce(F.col("b"), F.lit(False))).select(*by, "anomaly_id").distinct()
    return gained.join(detectors, "anomaly_id").select(*by, "test", "model", "column").distinct()


def classify(generated: DataFrame, merged: DataFrame, baseline: DataFrame, useful: DataFrame,
             fired: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """First match wins: not in merged → invalid; in baseline → redundant; detector family
    useful → useful; else low_value (split into fired_no_gain / no_evidence when ``fired``
    — (test, model, column) that failed in some run — is given). Adds a rationale."""
    g, family = generated, [*by, "test", "model", "column"]
    g = g.join(merged.select(*by, *KEY).distinct().withColumn("_in_merged", F.lit(True)), [*by, *KEY], "left")
    g = g.join(baseline.select(*by, *KEY).distinct().withColumn("_in_base", F.lit(True)), [*by, *KEY], "left")
    g = g.join(useful.withColumn("_useful", F.lit(True)), family, "left")
    if fired is not None:
        g = g.join(fired.select(*family).distinct().withColumn("_fired", F.lit(True)), family, "left")
    else:
        g = g.withColumn("_fired", F.lit(None).cast("boolean"))
    cls = (F.when(F.col("_in_merged").isNull(), "invalid")
           .when(F.col("_in_base"), "redundant")
           .when(F.col("_useful"), "useful")
           .otherwise("low_value"))
    detail = (F.when(cls != "low_value", cls)
              .when(F.col("_fired"), "low_value_fired_no_gain").otherwise("low_value_no_evidence"))
    why = (F.when(cls == "invalid", "not executable in the merged suite")
           .when(cls == "redundant", "already in the baseline suite")
           .when(cls == "useful", "detects an anomaly the baseline misses")
           .when(F.col("_fired"), "fired, but no anomaly beyond the baseline")
           .otherwise("no detection evidence"))
    return g.select(*[c for c in generated.columns], cls.alias("classification"),
                    detail.alias("classification_detail"), why.alias("rationale"))


def audit_summary(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per class, share of all rules and of non-redundant executable rules (4 dp)."""
    c = (classified.groupBy(*by) if by else classified).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("classification") == "useful").alias("useful_count"),
        F.count_if(F.col("classification") == "redundant").alias("redundant_count"),
        F.count_if(F.col("classification") == "low_value").alias("low_value_count"),
        F.count_if(F.col("classification") == "invalid").alias("invalid_count"))
    nre = F.col("total") - F.col("redundant_count") - F.col("invalid_count")
    return c.select("*",
                    F.round(F.try_divide(F.col("useful_count"), F.col("total")), 4).alias("useful_pct_of_all"),
                    F.round(F.try_divide(F.col("useful_count"), nre), 4).alias("useful_pct_of_non_redundant"))


def render_suites(rules: DataFrame) -> DataFrame:
    """Rule rows (model, column, test, args, position) → one suite document per model:
    ``{"version": 2, "models": [{"name", "columns": [{"name", "tests": [...]}]}]}``; a
    test without arguments is a bare name, otherwise a one-key map. Groups are a
    model's columns and a column's tests, both small."""
    test_json = F.when(F.col("args") == "{}", F.to_json(F.array(F.col("test"))).substr(F.lit(2), F.length(
        F.to_json(F.array(F.col("test")))) - 2)).otherwise(
        F.concat(F.lit("{"), F.to_json(F.array(F.col("test"))).substr(F.lit(2), F.length(
            F.to_json(F.array(F.col("test")))) - 2), F.lit(": "), F.col("args"), F.lit("}")))
    cols = (rules.groupBy("model", "column")
            .agg(F.min("position").alias("p"),
                 F.array_sort(F.collect_list(F.struct("position", test_json.alias("j")))).alias("ts")))
    col_json = F.concat(F.lit('{"name": '), F.to_json(F.array("column")).substr(F.lit(2), F.length(
        F.to_json(F.array("column"))) - 2), F.lit(', "tests": ['), F.array_join(F.transform("ts", lambda x: x["j"]), ", "),
        F.lit("]}"))
    models = (cols.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("p", col_json.alias("j")))).alias("cs")))
    doc = F.concat(F.lit('{"version": 2, "models": [{"name": '), F.to_json(F.array("model")).substr(F.lit(2), F.length(
        F.to_json(F.array("model"))) - 2), F.lit(', "columns": ['), F.array_join(F.transform("cs", lambda x: x["j"]), ", "),
        F.lit("]}]}"))
    return models.select("model", doc.alias("suite"))


def flatten_documents(docs: DataFrame, col: str = "suite", keep: list[str] | None = None) -> DataFrame:
    """Suite documents → rule rows with positions, entirely in Spark (VARIANT + posexplode).

    Malformed nodes yield nothing (a missing ``models`` / ``columns`` / ``tests`` array,
    a test map with more than one key); ``{"arguments": {...}}`` is unwrapped and a
    scalar argument becomes ``{"value": x}``. ``args`` is compact JSON with sorted keys.
    """
    keep = keep or []
    v = docs.select(*keep, F.try_parse_json(F.col(col)).alias("_v"))
    m = v.select(*keep, F.posexplode(F.try_variant_get("_v", "$.models", "array<variant>")).alias("mpos", "_m"))
    c = m.select(*keep, "mpos", F.try_variant_get("_m", "$.name", "string").alias("model"),
                 F.posexplode(F.try_variant_get("_m", "$.columns", "array<variant>")).alias("cpos", "_c"))
    t = c.select(*keep, "mpos", "model", "cpos", F.try_variant_get("_c", "$.name", "string").alias("column"),
                 F.posexplode(F.try_variant_get("_c", "$.tests", "array<variant>")).alias("tpos", "_t"))
    bare = F.when(F.schema_of_variant("_t") == "STRING", F.try_variant_get("_t", "$", "string"))
    as_map = F.try_variant_get("_t", "$", "map<string,variant>")
    t = t.select("*", bare.alias("_bare"), as_map.alias("_map"))
    named = t.filter(F.col("_bare").isNotNull()).select(
        *keep, "mpos", "model", "cpos", "column", "tpos", F.col("_bare").alias("test"), F.lit("{}").alias("args"))
    mapped = (t.filter(F.col("_bare").isNull() & (F.size("_map") == 1))
              .select(*keep, "mpos", "model", "cpos", "column", "tpos", F.explode("_map").alias("test", "_a")))
    inner = F.try_variant_get("_a", "$.arguments", "variant")
    a = F.coalesce(inner, F.col("_a"))
    is_obj = F.schema_of_variant(a).startswith("OBJECT")
    args = F.when(is_obj, F.to_json(a)).otherwise(F.concat(F.lit('{"value":'), F.to_json(a), F.lit("}")))
    args = F.regexp_replace(args, r"ref\('([^']*)'\)", "$1")  # ref('model') -> model
    mapped = mapped.select(*keep, "mpos", "model", "cpos", "column", "tpos", "test", args.alias("args"))
    return named.unionByName(mapped)


def _nodes(docs: DataFrame, col: str, side: int, by: Sequence[str]) -> dict[str, DataFrame]:
    """Models, columns and tests of suite documents, each with its ``rank`` (side, document, positions)."""
    doc = docs.select(*by, F.col("position").alias("d"), F.try_parse_json(F.col(col)).alias("_v"))
    text = lambda c, f: F.try_variant_get(c, f"$.{f}", "string")
    m = doc.select(*by, "d", F.posexplode(F.try_variant_get("_v", "$.models", "array<variant>")).alias("i", "_m"))
    m = m.select(*by, text("_m", "name").alias("model"), F.nullif(text("_m", "description"), F.lit("")).alias("description"), "_m",
                 F.array(F.lit(side), F.col("d"), F.col("i")).alias("rank")).filter("model IS NOT NULL AND model <> ''")
    c = m.select(*by, "model", "rank", F.posexplode(F.try_variant_get("_m", "$.columns", "array<variant>")).alias("i", "_c"))
    c = c.select(*by, "model", text("_c", "name").alias("column"), F.nullif(text("_c", "description"), F.lit("")).alias("description"), "_c",
                 F.concat("rank", F.array("i")).alias("rank")).filter("column IS NOT NULL AND column <> ''")
    t = c.select(*by, "model", "column", "rank", F.posexplode(F.try_variant_get("_c", "$.tests", "array<variant>")).alias("i", "_t"))
    t = t.select(*by, "model", "column", F.to_json("_t").alias("j"), _test_key(F.col("_t")).alias("key"), F.concat("rank", F.array("i")).alias("rank"))
    return {"model": m.drop("_m"), "column": c.drop("_c"), "test": t}


def _test_key(t):
    """What makes two tests the same: name and arguments, however they are spelt."""
    entry = F.map_entries(F.try_variant_get(t, "$", "map<string,variant>"))
    one = F.get(entry, 0)
    args = F.coalesce(F.try_variant_get(one["value"], "$.arguments", "variant"), one["value"])
    mapped = F.concat(one["key"], F.lit(" "), F.regexp_replace(F.to_json(args), r"ref\('([^']*)'\)", "$1"))
    return F.when(F.schema_of_variant(t) == "STRING", F.concat(F.try_variant_get(t, "$", "string"), F.lit(" {}"))).when(F.size(entry) == 1, mapped).otherwise(F.to_json(t))


def merge_documents(base: DataFrame, new: DataFrame, col: str = "suite", by: Sequence[str] = ()) -> DataFrame:
    """Suite documents merged as trees: (by, suite) from ``base`` and ``new`` (by, position, ``col``).

    Models, columns and tests are matched by name (tests by name and arguments, in either
    spelling) on three levels. What the base has keeps its order, its tests (repeated ones, too)
    and its descriptions; a missing description is taken from the first new document that has
    one; unseen models, columns and tests follow in the order of the new documents.
    """
    b, n = _nodes(base, col, 0, by), _nodes(new, col, 1, by)
    both = {k: b[k].unionByName(n[k]) for k in b}
    path = [*by, "model", "column"]
    fresh = (n["test"].join(b["test"].select(*path, "key").distinct(), [*path, "key"], "left_anti")
             .groupBy(*path, "key").agg(F.min(F.struct("rank", "j")).alias("f")).select(*path, "f.j", "f.rank"))
    tests = b["test"].select(*path, "j", "rank").unionByName(fresh)
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x["j"]), ", ")
    described = lambda: F.min(F.when(F.col("description").isNotNull(), F.struct("rank", "description")))["description"]
    quote = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    head = lambda c: F.concat(F.lit('{"name": '), quote(F.col(c)), F.when(
        F.col("description").isNotNull(), F.concat(F.lit(', "description": '), quote(F.col("description")))).otherwise(""))
    of_column = tests.groupBy(*path).agg(in_order("j").alias("t"))
    columns = both["column"].groupBy(*path).agg(F.min("rank").alias("rank"), described().alias("description")).join(of_column, path, "left")
    columns = columns.withColumn("j", F.concat(head("column"), F.coalesce(F.concat(F.lit(', "tests": ['), F.col("t"), F.lit("]")), F.lit("")), F.lit("}")))
    of_model = columns.groupBy(*by, "model").agg(in_order("j").alias("c"))
    models = both["model"].groupBy(*by, "model").agg(F.min("rank").alias("rank"), described().alias("description")).join(of_model, [*by, "model"], "left")
    models = models.withColumn("j", F.concat(head("model"), F.lit(', "columns": ['), F.coalesce("c", F.lit("")), F.lit("]}")))
    return models.groupBy(*by).agg(F.concat(F.lit('{"version": 2, "models": ['), in_order("j"), F.lit("]}")).alias("suite"))


def validate_documents(docs: DataFrame, col: str = "suite", expected: str | None = None) -> DataFrame:
    """``docs`` with ``valid`` and ``reason``: a suite document is a JSON mapping with a version
    and exactly one model, of the name in column ``expected`` if that is given."""
    v = F.try_parse_json(F.col(col))
    models = F.try_variant_get(v, "$.models", "array<variant>")
    name = F.try_variant_get(F.get(models, 0), "$.name", "string")
    reason = (F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "root is no mapping")
              .when(F.try_variant_get(v, "$.version", "variant").isNull(), "no version")
              .when(models.isNull() | (F.size(models) != 1), "not exactly one model"))
    if expected is not None:
        reason = reason.when(~name.eqNullSafe(F.col(expected)), "unexpected model name")
    return docs.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
