"""Resumable copy of a table to a second store, in chunks with a ledger.

Rows fall into chunks by key hash. A wave of chunks is written in one job (each chunk its own
partition folder, replaced as a whole), read back, and compared by rows and an order-free
checksum of all values with the same chunks of the source; only then the ledger gets their
rows, one file per wave. A restart skips every chunk that the ledger calls done: it copies and
verifies the open ones alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import canonical_text
from ..operators.reconcile import row_hash
from .files import missing_path

CHUNK = "_chunk"
LEDGER = "chunk int, rows bigint, checksum string, status string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The copied chunks and their checksums; empty before the first."""
    try:
        return spark.read.schema(LEDGER).json(f"{path}/ledger")
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return spark.createDataFrame([], LEDGER)


def _sums(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Per chunk: rows, and the sums of the rows' hash parts."""
    text = df.select(CHUNK, *[canonical_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name in columns])
    h = text.select(CHUNK, row_hash([f"`{c}`" for c in columns]).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return h.groupBy(CHUNK).agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.concat_ws(":", *[part(i) for i in range(4)]).alias(f"{name}_sum"))


def copy(df: DataFrame, path: str, key: str, chunks: int = 64, wave: int = 16, stop_after: int | None = None) -> DataFrame:
    """Copy ``df`` to ``path`` and return the ledger. ``stop_after``: end after so many waves (to be
    resumed). A chunk whose checksums differ is recorded as failed and stays open."""
    spark, columns = df.sparkSession, df.columns
    chunked = df.withColumn(CHUNK, F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(chunks)), F.lit(0)).cast("int"))
    last = ledger(spark, path).filter("status = 'done'").select("chunk").distinct()
    done = {r[0] for r in last.collect()}                       # at most ``chunks``
    todo = [c for c in range(chunks) if c not in done]
    for k, at in enumerate(range(0, len(todo), wave)):
        if k == stop_after:
            break
        now = todo[at:at + wave]
        mine = chunked.filter(F.col(CHUNK).isin(now))
        (mine.repartition(CHUNK).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(CHUNK).parquet(f"{path}/data"))
        copied = spark.read.schema(f"{df.schema.toDDL()}, {CHUNK} int").parquet(f"{path}/data").filter(F.col(CHUNK).isin(now))
        both = _sums(mine, columns, "source").join(_sums(copied, columns, "target"), CHUNK, "full")
        same = F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_sum").eqNullSafe(F.col("target_sum"))
        every = spark.createDataFrame([(c,) for c in now], f"{CHUNK} int").join(both, CHUNK, "left")     # empty chunks are done, too
        (every.select(F.col(CHUNK).alias("chunk"), F.coalesce("target_rows", F.lit(0).cast("bigint")).alias("rows"), F.col("target_sum").alias("checksum"),
                      F.when(same, "done").otherwise("failed").alias("status")).coalesce(1).write.mode("append").json(f"{path}/ledger"))
    return ledger(spark, path)


def copied(spark: SparkSession, path: str, schema) -> DataFrame:
    """The copied rows."""
    return spark.read.schema(f"{schema.toDDL()}, {CHUNK} int").parquet(f"{path}/data").drop(CHUNK)
