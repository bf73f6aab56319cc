"""Exact de-duplication by content sort (DataFrame functions only).

Sampled splitters range-partition the rows on (leading normalised characters, content
hash, salt), so equal texts meet in one range; each range is sorted externally on the
whole normalised text, equal texts become neighbours, and neighbours are compared in full
(the window's partition key is the text itself, not a digest).

Hot texts: weights per text are aggregated first (map-side combined). A text that owns more
than a quarter of an average partition's bytes is dealt over several salts; its group
result was pre-aggregated by full text, at most ``4 x partitions`` such rows exist (their
bytes are disjoint shares of the total), so that table may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import az_lower, documents, identifier, keep_columns, shuffle_partitions, staged

PREFIX = 64
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                partitions: int | None = None) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a NULL text counts as empty.
    ``keep``: the row with the ``smallest`` or ``largest`` identifier stays; a NULL
    identifier loses against any other. Of repeated rows with that identifier exactly one
    stays. An empty table gives an empty result. Input columns named like a result column
    give way to it.
    """
    spark = docs.sparkSession
    parts = partitions or shuffle_partitions(spark)
    largest = keep == "largest"
    best = F.max if largest else F.min
    carried = keep_columns(docs, RESULT)
    text = F.coalesce(F.col(identifier(text_col)), F.lit(""))

    # bytes per text, under a fast key that equal texts share
    weight = staged(docs.select(F.xxhash64(F.lower(text)).alias("h"), (F.octet_length(text) + 64).alias("b"))
                    .groupBy("h").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")), "dedup-weight")
    limit = (weight.agg(F.sum("b")).first()[0] or 0) / (4 * parts)
    suspects = weight.filter((F.col("b") > limit) & (F.col("n") > 1)).select("h", F.lit(True).alias("suspect"))
    marked = (docs.select(F.struct(*[F.col(identifier(c)) for c in carried]).alias("row"),
                          F.col(identifier(id_col)).alias("id"), F.xxhash64(F.lower(text)).alias("h"))
              .join(F.broadcast(suspects), "h", "left"))
    body = F.coalesce(F.col("row").getField(text_col), F.lit(""))

    # among those, whole texts and their group results: at most 4 x partitions rows
    hot = staged(
        marked.filter("suspect").select(az_lower(body).alias("norm"), "id")
        .groupBy("norm").agg(best("id").alias("hot_keep"), F.count(F.lit(1)).alias("hot_size"))
        .withColumn("b", F.col("hot_size") * (F.octet_length("norm") + 64)).filter(F.col("b") > limit)
        .select(F.sha2(F.col("norm").cast("binary"), 256).alias("hot_sha"), "hot_keep", "hot_size",
                F.ceil(F.col("b") / F.lit(max(limit, 1.0))).cast("long").alias("salts")), "dedup-hot")
    digest = F.sha2(az_lower(body).cast("binary"), 256)
    dealt = (marked.withColumn("hot_sha", F.when(F.col("suspect"), digest))
             .join(F.broadcast(hot), "hot_sha", "left")
             .withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0).cast("long"))
                         .otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))))
             .withColumn("lead", az_lower(F.substring(body, 1, PREFIX)))
             # case variants of a suspect text are told apart, others share the fast key
             .withColumn("h", F.when(F.col("hot_sha").isNull(), F.col("h")).otherwise(F.xxhash64("hot_sha")))
             .select("row", "id", "h", "lead", "salt", "hot_keep", "hot_size"))
    ranged = dealt.repartitionByRange(parts, "lead", "h", "salt").withColumn("norm", az_lower(body))
    run = Window.partitionBy("lead", "h", "salt", "norm")
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    in_order = run.orderBy(order)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the digest is taken before the window: normalised texts need not outlive the comparison
    runs = (ranged.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
            .select("row", "id", "hot_keep", "hot_size", "sha", F.row_number().over(in_order).alias("rn"),
                    F.first("id").over(whole).alias("run_keep"), F.count(F.lit(1)).over(whole).alias("run_size")))
    keep_id = F.when(F.col("hot_size").isNull(), F.col("run_keep")).otherwise(F.col("hot_keep"))
    return runs.select(
        *[F.col("row").getField(c).alias(c) for c in carried],
        keep_id.alias("keep_id"), F.coalesce("hot_size", "run_size").cast("long").alias("group_size"),
        ((F.col("rn") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"), F.col("sha").alias("text_sha256"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: the row with the largest doc_id of equal texts stays."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
