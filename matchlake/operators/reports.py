"""Nested reports of any shape as rows: leaves with paths, and metrics found by alias.

``leaves`` explodes documents level by level until no container is left; a level is one job
over the containers of the level above, written, so depth costs passes and never plan size.
``resolve`` finds metrics whose path a report does not fix: an alias names the end of a path.
Path ends of just the lengths that aliases have are joined with the aliases by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def leaves(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, ord, type, value): every value of every document that is no object or array.

    ``path``: lower-cased, ``a.b[0].c``; ``ord``: the leaf's place in the document as an array that
    sorts in document order; ``type``: BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, STRING or VOID (null);
    ``value``: its text (NULL for null). A document that is no JSON has no leaves, nor have empty
    containers; a document that is a scalar has one, with an empty path.
    """
    spark = docs.sparkSession
    kind = lambda v: F.schema_of_variant(v)
    parsed = F.try_parse_json(F.col(json_col))
    root = docs.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.array().cast("array<int>").alias("ord"),
                       kind(parsed).alias("type"), F.when(kind(parsed) == "STRING", F.try_variant_get(parsed, "$", "string"))
                       .otherwise(F.col(json_col)).alias("value")).filter(parsed.isNotNull())
    inner = F.col("type").startswith("OBJECT") | F.col("type").startswith("ARRAY")
    level, out = _written(root, "leaves"), None
    while True:
        done = level.filter(~inner).withColumn("value", F.when(F.col("type") != "VOID", F.col("value")))
        out = done if out is None else out.unionByName(done)
        open_ = level.filter(inner)
        if open_.isEmpty():
            return out.withColumn("path", F.lower("path"))
        # members in document order, as text and as VARIANT for their types
        obj = F.col("type").startswith("OBJECT")
        o_text, o_type = (F.from_json(F.when(obj, F.col("value")), f"map<string,{t}>") for t in ("string", "variant"))
        a_text, a_type = (F.from_json(F.when(~obj, F.col("value")), f"array<{t}>") for t in ("string", "variant"))
        of = lambda texts, types, keys: F.transform(
            F.arrays_zip(texts.alias("t"), F.transform(types, kind).alias("k"), keys.alias("key")),
            lambda x: F.struct(x["key"].alias("key"), F.coalesce(x["k"], F.lit("VOID")).alias("type"), x["t"].alias("value")))
        members = F.when(obj, of(F.map_values(o_text), F.map_values(o_type), F.map_keys(o_text))).otherwise(
            of(a_text, a_type, F.transform(a_text, lambda _, i: F.concat(F.lit("["), i.cast("string"), F.lit("]")))))
        child = open_.select("id", "path", "ord", obj.alias("obj"), F.posexplode(members).alias("at", "m"))
        name = F.when(F.col("obj") & (F.size("ord") > 0), F.concat(F.lit("."), F.col("m.key"))).otherwise(F.col("m.key"))
        level = _written(child.select("id", F.concat("path", name).alias("path"), F.concat("ord", F.array("at")).alias("ord"),
                                      "m.type", "m.value"), "leaves")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, metric, alias, path, type, value, matches, ambiguous) from ``leaves`` and aliases (metric,
    position, alias).

    A metric's aliases are tried by position; the first that ends any path of the document counts,
    and of the paths it ends the first in document order. ``ambiguous``: it ends several.
    """
    lengths = sorted(r[0] for r in aliases.select(F.length("alias")).distinct().collect())     # at most the length of a path
    ends = F.explode(F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(
        F.length("path") >= n, F.when(n == 0, F.lit("")).otherwise(F.expr("path").substr(F.length("path") - n + 1, n)))), lambda e: e.isNotNull()))
    named = aliases.select("metric", "position", "alias", F.lower("alias").alias("end"))
    hit = found.withColumn("end", ends).join(named, "end")
    by_alias = hit.groupBy("id", "metric", "position", "alias").agg(
        F.min(F.struct("ord", "path", "type", "value")).alias("first"), F.count(F.lit(1)).alias("matches"))
    best = by_alias.groupBy("id", "metric").agg(F.min(F.struct("position", "alias", "first", "matches")).alias("b"))
    return best.select("id", "metric", "b.alias", "b.first.path", "b.first.type", "b.first.value", "b.matches", (F.col("b.matches") > 1).alias("ambiguous"))


def records(resolved: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per document with a column per metric (NULL where it has none)."""
    return resolved.groupBy("id").pivot("metric", metrics).agg(F.first("value"))
