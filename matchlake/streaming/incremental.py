"""Incremental fact maintenance as a Structured Streaming job.

Raw event files (Parquet or JSON lines with the event schema) land in a folder; each
micro-batch is typed, filtered to finished events, cut at the target's high-water mark (kept
in the target's version, no row is read for it) and merged by key into a partitioned table:
only the partitions a batch touches are rewritten, a version is committed by one rename, and
a retried epoch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import marts
from ..sources.events import EVENT_SCHEMA, staged
from .partitioned import PartitionedTable

BUCKETS = 64


def table(spark: SparkSession, target: str) -> PartitionedTable:
    return PartitionedTable(spark, target, "match_id", buckets=BUCKETS, high_water="match_date")


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest committed version of the target table, or None."""
    return table(spark, target).read()


def upsert_batch(spark: SparkSession, batch_events: DataFrame, target: str, epoch: int,
                 inclusive: bool = False) -> list[str]:
    """Merge one micro-batch as version ``epoch``; the partitions rewritten."""
    new, t = marts.fct_matches(staged(batch_events), strict=False), table(spark, target)
    high = t.high()
    if high is not None:
        day, mark = F.col("match_date"), F.lit(high).cast("date")
        new = new.filter(day >= mark if inclusive else day > mark)
    return t.merge(new, epoch)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, fmt: str = "parquet",
          available_now: bool = True, inclusive: bool = False):
    """Start the stream; with ``available_now`` it processes what has landed and stops."""
    src = (spark.readStream.schema(EVENT_SCHEMA).format(fmt)
           .option("recursiveFileLookup", "true").load(source))
    w = (src.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, epoch: upsert_batch(spark, df, target, epoch, inclusive)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
