"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into m segments; an index row per (segment, value) leads to the code. A query
searches its segments at radius 0, then one radius further in turn, segment by segment.
With radii r_1..r_m every code within ``sum(r_i + 1) - 1`` bits has been met, so a query
is done as soon as its k-th verified distance is at most that; until then it goes on.
Every round is one equi-join (index and probes, verified by bit count inside the join's
condition, which also admits a pair only in the first step that reaches it and only below
the query's k-th distance so far) and ends in a written table.

Equal vectors are one code with its k smallest identifiers (no more can be in any answer),
equal queries are searched once; m follows the number of codes so that a value holds few.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import identifier, shuffle_partitions, staged

BITS = 64
PROBE_COST = 24.0      # cost of one shuffled probe against one verified candidate


def sign_code(vector: Column) -> Column:
    """64-bit code: bit i is set where element i is above 0 (elements past the end: not set;
    NULL elements: not set). Vectors of more than 64 elements raise."""
    wide = F.when(F.size(vector) > BITS, F.raise_error(F.lit("vectors of more than 64 elements")).cast("bigint"))
    folded = F.aggregate(F.reverse(vector), F.lit(0).cast("bigint"),
                         lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))
    return F.coalesce(wide, F.when(vector.isNotNull(), folded))


def widths(m: int) -> list[int]:
    return [BITS // m + (i < BITS % m) for i in range(m)]


def steps(m: int):
    """(segment, radius) in the order of search; after step t (from 1) all codes within t - 1 bits are met."""
    w = widths(m)
    return [(s, r) for r in range(max(w) + 1) for s in range(m) if r <= w[s]]


def segments(n: int, k: int) -> int:
    """The number of segments with the least estimated cost of meeting the k-th neighbour of
    a query among ``n`` codes of independent bits."""
    want, total, d = k / max(n, k), 0.0, -1
    while total < want and d < BITS:
        d += 1
        total += comb(BITS, d) / 2.0 ** BITS
    best = None
    for m in range(1, 17):
        w = widths(m)
        cost = sum(comb(w[s], r) * (PROBE_COST + n / 2.0 ** w[s]) for s, r in steps(m)[:d + 1])
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1]


def _segment(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))


def search(data: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           query_id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each row of ``queries`` the ``k`` rows of
    ``data`` nearest in Hamming distance of sign codes, ties by the smaller identifier.

    Exact: fewer than ``k`` rows only where ``data`` has fewer. Repeated identifiers count as one row
    per vector. Rows with a NULL vector or identifier are neither found nor answered; an
    empty side gives an empty result; other columns are not read.
    """
    spark = data.sparkSession
    coded = lambda df, c: df.select(F.col(identifier(c)).alias("id"), sign_code(F.col(identifier(vector_col))).alias("x")).filter(
        "id IS NOT NULL AND x IS NOT NULL")
    rows = coded(data, id_col).distinct()
    # the k smallest identifiers of a code: first within salts, so a frequent code is no single task
    salt = F.pmod(F.xxhash64("id"), F.lit(shuffle_partitions(spark)))
    part = rows.withColumn("salt", salt).withColumn("rn", F.row_number().over(Window.partitionBy("x", "salt").orderBy("id"))).filter(F.col("rn") <= k)
    named = staged(part.withColumn("rn", F.row_number().over(Window.partitionBy("x").orderBy("id"))).filter(F.col("rn") <= k).select("x", "id"), "mih-ids")
    codes = staged(named.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "mih-codes")
    asked = staged(coded(queries, query_id_col).distinct(), "mih-asked")
    n = codes.count()
    schema = asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbor_id"), F.lit(1).alias("distance"))
    if not n or asked.isEmpty():
        return schema.limit(0)
    m = segments(n, k)
    w = widths(m)
    at = [sum(w[:i]) for i in range(m)]
    order = steps(m)
    number = {step: t for t, step in enumerate(order)}
    index = codes.select("x", "n", F.posexplode(F.array(*[_segment(F.col("x"), at[s], w[s]) for s in range(m)])).alias("s", "v"))

    live = asked.select(F.col("x").alias("q")).distinct().withColumn("bound", F.lit(BITS))
    done, found, t = [], [], 0
    while True:
        now = order[t:t + (m if t == 0 else max(1, -(-m // 2)))]
        if not now:
            break
        probe = live.mapInArrow(_prober([(s, r, number[s, r], at[s], w[s]) for s, r in now]), "q bigint, bound int, s int, t int, v bigint")
        diff = F.col("x").bitwiseXOR(F.col("q"))
        # the first step that meets a pair: the least number over segments of (segment, its distance)
        first = F.least(*[F.element_at(F.array(*[F.lit(number[s, r]) for r in range(w[s] + 1)]),
                                       (F.bit_count(_segment(diff, at[s], w[s])) + 1).cast("int")) for s in range(m)]) if m > 1 else \
            F.element_at(F.array(*[F.lit(number[0, r]) for r in range(w[0] + 1)]), (F.bit_count(diff) + 1).cast("int"))
        hit = (index.s == probe.s) & (index.v == probe.v) & (F.bit_count(diff) <= F.col("bound")) & (first == F.col("t"))
        new = staged(probe.join(index, hit).select("q", "x", "n", F.bit_count(diff).alias("d")), "mih-found")
        found.append(new)
        t += len(now)
        covered = t - 1
        # k-th verified distance: counts by distance, at most 65 rows a query
        tally = _union(found).groupBy("q", "d").agg(F.sum("n").alias("n"))
        reached = tally.withColumn("c", F.sum("n").over(Window.partitionBy("q").orderBy("d"))).filter(F.col("c") >= k)
        kth = reached.groupBy("q").agg(F.min("d").alias("kth"))
        state = staged(live.select("q").join(kth, "q", "left").withColumn("bound", F.coalesce("kth", F.lit(BITS))), "mih-state")
        done.append(state.filter(F.col("kth") <= covered).select("q", "kth"))
        live = state.filter(F.col("kth").isNull() | (F.col("kth") > covered)).select("q", "bound")
        if live.isEmpty():
            break
    # queries of a table with fewer than k rows end with every code met
    known = _union(done).unionByName(live.select("q", F.col("bound").alias("kth"))) if t >= len(order) else _union(done)
    near = _union(found).join(known, "q").filter(F.col("d") <= F.col("kth")).select("q", "x", "d")
    best = near.join(named, "x").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).filter(F.col("rank") <= k)
    return asked.select(F.col("id").alias("query_id"), F.col("x").alias("q")).join(best, "q").select(
        "query_id", "rank", F.col("id").alias("neighbor_id"), F.col("d").alias("distance"))


def _prober(now: list[tuple[int, int, int, int, int]]):
    """Arrow map from (q, bound) to the values exactly ``radius`` bits from each segment of q."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, bound = b.column("q").to_numpy(), b.column("bound").to_numpy()
            if not len(q):
                continue
            for s, radius, t, at, width in now:
                v = (q.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << width) - 1)
                ways = combinations(range(width), radius)
                while chunk := list(islice(ways, max(1, 200_000 // len(q)))):
                    flip = np.array([sum(1 << i for i in c) for c in chunk], np.uint64)
                    n = len(q) * len(flip)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q, len(flip))), pa.array(np.repeat(bound, len(flip))), pa.array(np.full(n, s, np.int32)),
                         pa.array(np.full(n, t, np.int32)), pa.array((v[:, None] ^ flip).ravel().view(np.int64))], names=["q", "bound", "s", "t", "v"])
    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op2_hamming_topk(spark, sf_dir: str) -> DataFrame:
    """Sign codes of ``embeddings``: the 10 nearest of all rows for every row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 50 == 0))


OP2_SQL = """
WITH c AS (SELECT DISTINCT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0
                  THEN (1::UHUGEINT << i::UHUGEINT)::HUGEINT ELSE 0 END))::UBIGINT AS x
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, bit_count(xor(q.x, c.x)::BIT) AS distance FROM c q, c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10
"""
