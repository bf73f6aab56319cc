"""Running totals that no single key can overload.

``Window.partitionBy(key).orderBy(...)`` brings all rows of a key to one task. Here rows are
range-partitioned by (key, order): a hot key fills several ranges. Totals run inside each
(range, key); the ranges' sums, one row per (range, key), give every range the total of what
precedes it. The ranged rows are written once, because range borders come from a sample and
both passes must see the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def ranged(df: DataFrame, columns: list[str], partitions: int | None = None, name: str = "ranged", rows: int | None = None) -> DataFrame:
    """``df`` with ``_range``: the number of its sampled range in the order of ``columns``.

    ``rows``: each sampled range, a task, is cut by counting into ranges of at most so many rows,
    so ranges may be many without as many tasks and as large a sample; numbers ascend with gaps."""
    cut = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    path = scratch_path(df.sparkSession, name)
    number = F.spark_partition_id()
    if rows:
        cut = cut.sortWithinPartitions(*columns)
        # a task's number in the upper bits, the row's place in the lower ones
        at = F.monotonically_increasing_id()
        number = at.bitwiseAND(F.lit(-1 << 33)) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / rows)
    cut.withColumn("_range", number).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the key that come before the row.

    ``keys`` must not be NULL; rows with equal ``order`` follow each other in any order.
    """
    rows = ranged(df, [*keys, *order], name="running")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range", *keys).agg(F.sum(value).alias("_sum"))
    first = sums.withColumn("_first", F.coalesce(F.sum("_sum").over(before(Window.partitionBy(*keys).orderBy("_range"))), F.lit(0)))
    own = F.coalesce(F.sum(value).over(before(Window.partitionBy("_range", *keys).orderBy(*order))), F.lit(0))
    return (rows.withColumn("_own", own).join(first.drop("_sum"), ["_range", *keys])
            .withColumn(out, F.col("_first") + F.col("_own")).drop("_first", "_own", "_range"))
