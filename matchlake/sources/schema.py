"""Schema of JSON documents as rows, and how it drifts from one landing to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "path string, type string"


def _fields(text: str, path: str = "") -> list[tuple[str, str]]:
    """(path, type) of every field in a schema like ``OBJECT<a: BIGINT, b: ARRAY<OBJECT<c: STRING>>>``."""
    if text.startswith("ARRAY<"):
        return [(path, "ARRAY"), *_fields(text[6:-1], f"{path}[]")]
    if not text.startswith("OBJECT<"):
        return [(path, text)]
    out, depth, start, body, quoted = [(path, "OBJECT")], 0, 0, text[7:-1], False
    parts = []
    for i, c in enumerate(body):
        quoted ^= c == "`"
        depth += (c in "<(") - (c in ">)") if not quoted else 0
        if c == "," and depth == 0 and not quoted:
            parts.append(body[start:i])
            start = i + 1
    for part in filter(str.strip, [*parts, body[start:]]):
        part = part.strip()
        end = part.index("`: ", 1) + 1 if part.startswith("`") else part.index(": ")
        name = part[:end].strip("`")
        out += _fields(part[end + 2:], f"{path}.{name}" if path else name)
    return out


def inferred(docs: DataFrame, json_col: str) -> DataFrame:
    """(path, type) of every field that any document has, from one aggregate over all of them.

    Types that differ between documents are merged (a whole number and a fraction are a DECIMAL or
    DOUBLE; a number and text are VARIANT); ``[]`` stands for the items of an array, the empty path for
    the documents themselves. Documents that are no JSON are left out; none at all gives no rows.
    """
    spark = docs.sparkSession
    merged = docs.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(json_col)))).first()[0]
    rows = [] if merged in (None, "VOID") and docs.isEmpty() else _fields(merged) if merged else []
    return spark.createDataFrame(rows, FIELDS)


def drift(last: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change, last_type, type): fields added, lost or of another type since the last schema."""
    j = last.select("path", F.col("type").alias("last_type")).join(now, "path", "full")
    change = (F.when(F.col("last_type").isNull(), "added").when(F.col("type").isNull(), "lost")
              .when(F.col("last_type") != F.col("type"), "retyped"))
    return j.select("path", change.alias("change"), "last_type", "type").filter("change IS NOT NULL")


def merged(last: DataFrame, now: DataFrame) -> DataFrame:
    """The schema to keep: fields of both, VARIANT where their types differ."""
    j = last.select("path", F.col("type").alias("last_type")).join(now, "path", "full")
    kind = F.when(F.col("last_type") != F.col("type"), "VARIANT").otherwise(F.coalesce("type", "last_type"))
    return j.select("path", kind.alias("type"))


def land(spark: SparkSession, docs: DataFrame, json_col: str, path: str) -> DataFrame:
    """Append documents as a stored VARIANT column and return the table. Later reads of a path
    (``variant_get``) decode that path alone; nothing is parsed again."""
    docs.filter(F.try_parse_json(F.col(json_col)).isNotNull()).select(
        *[c for c in docs.columns if c != json_col], F.parse_json(F.col(json_col)).alias("raw")).write.mode("append").parquet(path)
    return spark.read.parquet(path)
