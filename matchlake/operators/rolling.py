"""Trailing-window mean over the k rows *before* each row (the row itself excluded).

Semantics equal ``AVG(v) OVER (PARTITION BY entity ORDER BY o1 NULLS LAST, o2 ...
ROWS BETWEEN k PRECEDING AND 1 PRECEDING)``: NULL when no non-NULL value precedes. The k
values are always added oldest first, so the answer has the same bits whichever plan ran.

A plain window puts each entity in one task. Rows per entity are counted exactly (one
combined aggregate); while the busiest entity has at most ``2 * chunk_rows`` rows that is
the cheapest plan. Beyond it:

1. rows are cut at row-count quantiles of the full order key (entity, o1, o2 ...), so a hot
   entity, a hot day or consecutive ids all fall into ranges of about ``chunk_rows`` rows
   (short ranges are counted out inside tasks of about ``TASK_ROWS`` rows);
2. one pass inside (range, entity) computes the lags and the range's last k rows;
3. over the small table of (range, entity) pairs each pair gets the last k rows before it
   (its halo), and the first k rows of a range take what they miss from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import ranged

TASK_ROWS = 200_000     # rows of a task that cuts several ranges


def _asc(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def _mean(values: list[Column]) -> Column:
    """Mean of the non-NULL ``values``, added in the order given."""
    total, count = F.lit(0.0), F.lit(0)
    for v in values:
        total = total + F.coalesce(v, F.lit(0.0))
        count = count + v.isNotNull().cast("int")
    return F.when(count > 0, total / count)


def cut(df: DataFrame, entity: str, order: list[str], chunk_rows: int) -> DataFrame | None:
    """``df`` with ``_range`` (ranges of about ``chunk_rows`` rows of the order key), or ``None``
    when no entity has more than twice as many rows."""
    per = df.groupBy(F.col(entity)).agg(F.count(F.lit(1)).alias("n"))
    total, busiest = per.agg(F.sum("n"), F.max("n")).first()
    if not total or busiest <= 2 * chunk_rows:
        return None
    # half as many rows again would still be within the bound: the tasks' ranges come from a sample
    tasks = -(-3 * total // (2 * max(chunk_rows, TASK_ROWS)))
    return ranged(df, [F.col(entity).asc_nulls_first(), *[_asc(c) for c in order]], tasks, "rolling", chunk_rows)


def trailing_mean(df: DataFrame, entity: str, order: list[str], values: dict[str, str], k: int = 5,
                  chunk_rows: int = 1_000_000) -> DataFrame:
    """Return (entity, *order, *value inputs, *outputs); ``values`` maps output → input column.

    Only those columns flow through the operator (join other columns back on the order
    key if needed). Rows with equal ``order`` values must be interchangeable for the
    result to be deterministic, exactly as with the plain window.
    """
    base = list(dict.fromkeys([entity, *order, *values.values()]))
    df = df.select(*base)
    rows = cut(df, entity, order, chunk_rows)
    if rows is None:
        w = Window.partitionBy(entity).orderBy(*[_asc(c) for c in order])
        lag = lambda c, j: F.lag(F.col(c).cast("double"), j).over(w)
        return df.select(*base, *[_mean([lag(src, j) for j in range(k, 0, -1)]).alias(dst) for dst, src in values.items()])

    vin = list(dict.fromkeys(values.values()))
    # NULL entities are an entity of their own: a text key that is never NULL
    keyed = rows.withColumn("_e", F.coalesce(F.concat(F.lit("v"), F.col(entity).cast("string")), F.lit("n")))
    w = Window.partitionBy("_range", "_e").orderBy(*[_asc(c) for c in order])
    back = Window.partitionBy("_range", "_e").orderBy(*[F.col(c).desc_nulls_first() for c in order])
    one = keyed.select(*base, "_range", "_e", F.row_number().over(w).alias("_p"), F.row_number().over(back).alias("_rd"),
                       *[F.lag(F.col(v).cast("double"), j).over(w).alias(f"_{i}_{j}") for i, v in enumerate(vin) for j in range(1, k + 1)])
    last = F.struct((-F.col("_rd")).alias("at"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(vin)])
    tails = one.filter(F.col("_rd") <= k).groupBy("_e", "_range").agg(F.array_sort(F.collect_list(last)).alias("_t"))
    before = Window.partitionBy("_e").orderBy("_range").rowsBetween(-k, -1)
    halo = tails.select("_e", "_range", F.flatten(F.collect_list("_t").over(before)).alias("_h"))
    j = one.join(halo, ["_range", "_e"])

    def previous(i: int, n: int) -> Column:
        """The n-th previous value: in the range, else counted back from the halo's end."""
        missing = F.get("_h", F.size("_h") + F.col("_p") - F.lit(n + 1)).getField(f"v{i}")
        return F.when(F.col("_p") > n, F.col(f"_{i}_{n}")).otherwise(missing)
    return j.select(*base, *[_mean([previous(vin.index(src), n) for n in range(k, 0, -1)]).alias(dst) for dst, src in values.items()])


def trailing_mean_plain(df: DataFrame, entity: str, order: list[str], values: dict[str, str],
                        k: int = 5) -> DataFrame:
    """The textbook one-window form (reference for tests; one task per entity)."""
    w = Window.partitionBy(entity).orderBy(*[_asc(c) for c in order]).rowsBetween(-k, -1)
    return df.select("*", *[F.avg(F.col(src)).over(w).alias(dst) for dst, src in values.items()])
