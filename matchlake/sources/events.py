"""Two-sided event source.

The engine's raw layer is a stream of event records shaped like a sports API payload
(every field text). On the test warehouse they are derived from the order tables: an
order is an event between the buyer's nation (home side) and the nation of its lowest
supplier nation (away side); finished and open line items are the two scores.
Orders whose two sides coincide are not events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Tables

# Status text per order status code.
STATUS_TEXT = {"F": "Match Finished", "O": "Not Started", "P": "Match Postponed"}
FINISHED = "Match Finished"

EVENT_FIELDS = ("idEvent", "idLeague", "strSeason", "dateEvent", "strStatus",
                "idHomeTeam", "strHomeTeam", "intHomeScore",
                "idAwayTeam", "strAwayTeam", "intAwayScore")

EVENT_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in EVENT_FIELDS])
DOCUMENT_SCHEMA = T.StructType([T.StructField("events", T.ArrayType(EVENT_SCHEMA), True)])


def _status_text(code: F.Column) -> F.Column:
    expr = None
    for k, v in STATUS_TEXT.items():
        expr = (F.when(code == k, F.lit(v)) if expr is None else expr.when(code == k, F.lit(v)))
    return expr


def event_rows(tables: Tables, status: str | None = None) -> DataFrame:
    """Flat event records (one per order with line items and two different sides).

    ``status`` (a status text) keeps only such events: the order scan filters on the status
    code, and line items are semi-joined to those orders before they are aggregated.

    Plan: lineitem ⋈ supplier, partial+final aggregate by order, ⋈ orders ⋈ customer on
    keys, and two lookups into ``nation``; the planner sizes every join.
    """
    li = tables.lineitem(["l_orderkey", "l_suppkey", "l_linestatus"])
    o = tables.orders(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    if status is not None:
        codes = [k for k, v in STATUS_TEXT.items() if v == status]
        o = o.filter(F.col("o_orderstatus") == codes[0] if len(codes) == 1 else F.col("o_orderstatus").isin(codes))
        li = li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    su = tables.supplier(["s_suppkey", "s_nationkey"])
    sides = (li.join(su, li.l_suppkey == su.s_suppkey)
             .groupBy("l_orderkey")
             .agg(F.min("s_nationkey").alias("away_nation"),
                  F.count_if(F.col("l_linestatus") == "F").alias("home_score"),
                  F.count_if(F.col("l_linestatus") == "O").alias("away_score")))
    c = tables.customer(["c_custkey", "c_nationkey"])
    nation = tables.nation(["n_nationkey", "n_name", "n_regionkey"])
    hn = nation.select(F.col("n_nationkey").alias("hn_key"), F.col("n_name").alias("hn_name"),
                       F.col("n_regionkey").alias("hn_region"))
    an = nation.select(F.col("n_nationkey").alias("an_key"), F.col("n_name").alias("an_name"))
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(sides, o.o_orderkey == sides.l_orderkey)
         .filter(F.col("c_nationkey") != F.col("away_nation"))
         .join(hn, F.col("c_nationkey") == F.col("hn_key"))
         .join(an, F.col("away_nation") == F.col("an_key")))
    y = F.year("o_orderdate")
    return j.select(
        F.col("o_orderkey").cast("string").alias("idEvent"),
        F.col("hn_region").cast("string").alias("idLeague"),
        F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string")).alias("strSeason"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("dateEvent"),
        _status_text(F.col("o_orderstatus")).alias("strStatus"),
        F.col("c_nationkey").cast("string").alias("idHomeTeam"),
        F.col("hn_name").alias("strHomeTeam"),
        F.col("home_score").cast("string").alias("intHomeScore"),
        F.col("away_nation").cast("string").alias("idAwayTeam"),
        F.col("an_name").alias("strAwayTeam"),
        F.col("away_score").cast("string").alias("intAwayScore"),
    )


def staged(events: DataFrame) -> DataFrame:
    """Staging layer: one nested ``match_data`` struct per event."""
    return events.select(F.struct(*[F.col(f) for f in EVENT_FIELDS]).alias("match_data"))


def event_documents(events: DataFrame, page_size: int = 1000) -> DataFrame:
    """Render events as JSON documents ``{"events": [...]}``, one per page of event ids.

    A page holds the events whose id falls in one block of ``page_size`` ids, so every
    document is bounded no matter how large the season is; the payload is the same shape
    the raw landing zone stores.
    """
    page = F.floor(F.col("idEvent").cast("bigint") / F.lit(page_size))
    return (events.withColumn("_page", page)
            .groupBy("_page")
            .agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*EVENT_FIELDS))).alias("events")))
                 .alias("json"))
            .select(F.col("_page").alias("page"), "json"))


def explode_documents(docs: DataFrame, col: str = "json") -> DataFrame:
    """Parse documents with the fixed schema and unnest: empty/NULL ``events`` yield no rows."""
    parsed = docs.select(F.from_json(F.col(col), DOCUMENT_SCHEMA).alias("d"))
    return parsed.select(F.explode("d.events").alias("match_data"))


def explode_documents_variant(docs: DataFrame, col: str = "json") -> DataFrame:
    """Semi-structured path: parse to VARIANT, lateral-flatten ``events``; rows stay VARIANT.

    A document that is no JSON yields no rows (``malformed_documents`` lists those)."""
    v = docs.select(F.try_parse_json(F.col(col)).alias("raw"))
    return v.select(F.explode(F.variant_get("raw", "$.events", "array<variant>")).alias("match_data"))


def malformed_documents(docs: DataFrame, col: str = "json") -> DataFrame:
    """The documents that cannot be parsed."""
    return docs.filter(F.col(col).isNotNull() & F.try_parse_json(F.col(col)).isNull())


def variant_fields(staged_variant: DataFrame) -> DataFrame:
    """Typed extraction from VARIANT rows (the ``match_data:field`` form), text typed."""
    return staged_variant.select(F.struct(*[
        F.variant_get(F.col("match_data"), f"$.{f}", "string").alias(f) for f in EVENT_FIELDS
    ]).alias("match_data"))


def read_documents(spark, path: str, multiline: bool = True) -> DataFrame:
    """Read landed raw documents (pretty-printed JSON objects) with the fixed schema."""
    return (spark.read.option("multiLine", multiline).schema(DOCUMENT_SCHEMA).json(path)
            .select(F.explode("events").alias("match_data")))
