"""Hard-negative mining with residue-number-system matrix products.

Scores are integer inner products of quantised vectors. A matrix product of integers is taken
modulo several small primes: residues are centred, so every sum stays below 2 ** 24 and a
float32 product is exact; mixed-radix Chinese remaindering (centred digits) gives back the
exact signed score. The primes are chosen from the data: their product exceeds twice the
largest squared norm, which bounds every score (Cauchy-Schwarz).

Stated queries (the anchors) are scored against all rows, in blocks: rows and anchors are dealt
by hash into groups of bounded size, a cell is one group of rows with one group of anchors,
and each task keeps only its best few rows per anchor. A first pass scores rows of the
anchor's label (its positives), a second one rows of other labels within the score window
each positive opens; windows over (anchor, positive) then pick the few best of all cells.
No label, hot or not, decides where a row goes; selection is exact, without caps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import identifier, shuffle_partitions, staged

EXACT = 1 << 24          # float32 holds every integer up to here
DEPTH = 1024             # components multiplied at once
GROUP = 1 << 16          # rows, or anchors, of a cell at most
TILE = (512, 4096)       # anchors x rows scored at once
LOW = np.iinfo(np.int64).min


def primes_for(bound: int, depth: int) -> list[int]:
    """Odd primes, largest first, whose centred products of ``depth`` terms are exact in
    float32 and whose product exceeds ``2 * bound + 1``."""
    top = 2 * math.isqrt(EXACT // max(1, min(depth, DEPTH))) + 1
    out, product, p = [], 1, top | 1
    while product <= 2 * bound + 1:
        while p > 2 and any(p % k == 0 for k in range(3, math.isqrt(p) + 1, 2)):
            p -= 2
        if p < 3 or (p - 1) // 2 * ((p - 1) // 2) * min(depth, DEPTH) > EXACT:
            if p < 3:
                raise ValueError("scores are too large for the primes at hand")
            p -= 2
            continue
        out.append(p)
        product *= p
        p -= 2
    return out


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p`` in [-(p - 1) / 2, (p - 1) / 2], as float32."""
    r = np.mod(x, p)
    r[r > p // 2] -= p
    return r.astype(np.float32)


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """The same for exact integers held in floats."""
    x = x.astype(np.float64)
    return x - p * np.rint(x * (1.0 / p))


class Residues:
    """A matrix of integers as centred residues modulo each prime."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [_centred(rows, p) for p in primes]

    def pick(self, at) -> Residues:
        out = object.__new__(Residues)
        out.primes, out.parts = self.primes, [x[at] for x in self.parts]
        return out

    def scores(self, other: Residues) -> np.ndarray:
        """Exact inner products of all rows with all rows of ``other`` (int64)."""
        digits: list[np.ndarray] = []
        total, radix = None, 1
        for k, p in enumerate(self.primes):
            a, b = self.parts[k], other.parts[k]
            r = np.zeros((len(a), len(b)))
            for i in range(0, a.shape[1], DEPTH):
                r += _reduced(a[:, i:i + DEPTH] @ b[:, i:i + DEPTH].T, p)
            # next mixed-radix digit: what the digits so far leave, over their radix, modulo p
            weight, known = 1, np.zeros_like(r)
            for d, q in zip(digits, self.primes, strict=False):
                known += d * (weight % p)
                weight *= q
            digit = _reduced((r - known) if not digits else _reduced(r - known, p) * pow(weight, -1, p), p)
            digits.append(digit)
            step = digit.astype(np.int64) * np.int64(radix)
            total = step if total is None else total + step
            radix *= p
        return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zeros after a shorter vector's end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    if len(flat) == n * width:
        size = column.value_lengths().to_numpy(zero_copy_only=False)
        if n == 0 or (size == width).all():
            return flat.reshape(n, width)
    out = np.zeros((n, width), np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i, :len(x)] = x
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each line and their ids (``ids`` ascend, so ties go to the smallest); spent lines hold LOW."""
    line = np.arange(len(scores))
    s, i = np.full((len(scores), k), LOW), np.zeros((len(scores), k), np.int64)
    for j in range(min(k, scores.shape[1])):
        at = np.argmax(scores, 1)
        s[:, j], i[:, j] = scores[line, at], ids[at]
        scores[line, at] = LOW
    return s, i


def _merged(a, b, k):
    """The best ``k`` of two such lists along the last axis."""
    s, i = np.concatenate([a[0], b[0]], -1), np.concatenate([a[1], b[1]], -1)
    order = np.lexsort((i, -np.maximum(s, LOW + 1)), axis=-1)[..., :k]
    return np.take_along_axis(s, order, -1), np.take_along_axis(i, order, -1)


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` hundredths of ``score``, rounded up or down, without overflow."""
    whole, rest = score // 100, score % 100
    return whole * percent + (-(-rest * percent // 100) if up else rest * percent // 100)


class _Cell:
    """Rows and anchors of one cell, rows in ascending order of their ids."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, width: int, primes: list[int]):
        rows = rows.sort_by([("id", "ascending"), ("uid", "ascending")])
        number = lambda t, c: t.column(c).to_numpy()
        self.id, self.uid, self.label = number(rows, "id"), number(rows, "uid"), number(rows, "label")
        self.rows = Residues(_matrix(rows.column("q"), width), primes)
        self.anchors, self.table = Residues(_matrix(anchors.column("q"), width), primes), anchors
        self.a_uid, self.a_label = number(anchors, "uid"), number(anchors, "label")

    def positives(self, k: int):
        """(anchor, score, id) of the best ``k`` other rows of each anchor's label."""
        order = np.argsort(self.label, kind="stable")
        for label in np.unique(self.a_label):
            mine = np.flatnonzero(self.a_label == label)
            lo, hi = np.searchsorted(self.label[order], [label, label + 1])
            like = order[lo:hi]
            for i in range(0, len(mine), TILE[0]):
                a, found = mine[i:i + TILE[0]], None
                left = self.anchors.pick(a)
                for j in range(0, len(like), TILE[1]):
                    r = like[j:j + TILE[1]]
                    s = left.scores(self.rows.pick(r))
                    s[self.a_uid[a][:, None] == self.uid[r][None, :]] = LOW
                    now = _best(s, self.id[r], k)
                    found = now if found is None else _merged(found, now, k)
                if found is not None:
                    line, j = np.nonzero(found[0] > LOW)
                    yield a[line], found[0][line, j], found[1][line, j]

    def negatives(self, k: int, low: int, high: int):
        """(anchor, positive's number, score, id) of the best ``k`` rows of other labels in each positive's window."""
        column = self.table.column("positives").combine_chunks()
        size = column.value_lengths().to_numpy(zero_copy_only=False)
        wide = int(size.max()) if len(size) else 0
        score = np.zeros((len(size), wide), np.int64)
        real = np.arange(wide) < size[:, None]
        score[real] = column.flatten().to_numpy(zero_copy_only=False)
        floor, ceiling = share(score, low, True), share(score, high, False)
        for i in range(0, len(size), TILE[0]):
            a, found = np.arange(i, min(i + TILE[0], len(size))), None
            left = self.anchors.pick(a)
            for j in range(0, len(self.id), TILE[1]):
                r = slice(j, j + TILE[1])
                s = left.scores(self.rows.pick(r))
                s[self.a_label[a][:, None] == self.label[r][None, :]] = LOW
                each = []
                for p in range(wide):
                    inside = (s >= floor[a, p][:, None]) & (s <= ceiling[a, p][:, None]) & real[a, p][:, None]
                    each.append(_best(np.where(inside, s, LOW), self.id[r], k))
                now = np.stack([s for s, _ in each], 1), np.stack([i for _, i in each], 1)
                found = now if found is None else _merged(found, now, k)
            if found is not None:
                line, p, j = np.nonzero(found[0] > LOW)
                yield a[line], p, found[0][line, p, j], found[1][line, p, j]


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are quantised to ``floor(scale * x)``; a score is an exact integer inner
    product, higher first, ties by smaller identifier. A positive is one of the anchor's first
    ``positives`` other rows of its label; its negatives are the first ``negatives`` rows of
    other labels whose score lies between ``low`` and ``high`` percent of the positive's.

    Rows with a NULL identifier, label, vector or component, or a component that is not
    finite, take no part. Repeated rows are rows each (a copy of the anchor may be its positive;
    a repeated anchor is mined again). Vectors of different lengths are compared over their
    common components; an empty vector scores 0. Without rows or anchors the result is empty;
    other columns are not read. Scores must fit 64 bits (else it raises).
    """
    spark = vectors.sparkSession
    x, v = F.col(identifier(id_col)).cast("long"), F.col(identifier(vector_col))
    sound = v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = staged(vectors.filter(x.isNotNull() & F.col(identifier(label_col)).isNotNull() & F.coalesce(sound, F.lit(False)))
                  .select(F.monotonically_increasing_id().alias("uid"), x.alias("id"), F.col(identifier(label_col)).cast("long").alias("label"),
                          F.transform(v, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("q"),
                          F.coalesce(anchors, F.lit(False)).alias("anchor")), "mine-rows")
    norm = F.aggregate("q", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("int")).alias("a"),
                    F.max(norm).alias("norm"), F.max(F.size("q")).alias("width")).first()
    out_type = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not seen.a:
        return spark.createDataFrame([], out_type)
    bound, width = math.ceil(seen.norm * (1 + 1e-9)) + 1, seen.width
    if bound >= 1 << 62:
        raise ValueError("inner products of these vectors exceed 64 bits")
    primes = primes_for(bound, width)
    # groups of bounded size, and as many row groups as the shuffle has partitions
    size = min(GROUP, -(-seen.n // shuffle_partitions(spark)))
    row_groups, anchor_groups = -(-seen.n // size), -(-seen.a // GROUP)
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    fresh = [F.col(c).alias(c) for c in ("uid", "id", "label", "q")]       # the two sides stem from one table
    left = rows.select(*fresh, dealt(row_groups).alias("rg")).withColumn("ag", everywhere(anchor_groups))
    asked = rows.filter("anchor").select(*fresh, dealt(anchor_groups).cast("long").alias("ag"))

    def best_positives(r: pa.Table, a: pa.Table) -> Iterator[pa.Table]:
        if r.num_rows and a.num_rows:
            cell = _Cell(r, a, width, primes)
            for at, score, row in cell.positives(positives):
                yield pa.table({"uid": cell.a_uid[at], "score": score, "other": row})

    def best_negatives(r: pa.Table, a: pa.Table) -> Iterator[pa.Table]:
        if r.num_rows and a.num_rows:
            cell = _Cell(r, a, width, primes)
            for at, p, score, row in cell.negatives(negatives, low, high):
                yield pa.table({"uid": cell.a_uid[at], "p": p.astype(np.int64), "score": score, "other": row})

    def cells(a: DataFrame, fn, schema: str) -> DataFrame:
        def whole(r: pa.Table, t: pa.Table) -> pa.Table:
            made = list(fn(r, t))
            return pa.concat_tables(made) if made else pa.table({f.split()[0]: pa.array([], pa.int64()) for f in schema.split(", ")})
        spread = a.withColumn("rg", everywhere(row_groups))
        return left.groupBy("rg", "ag").cogroup(spread.groupBy("rg", "ag")).applyInArrow(whole, schema)

    first = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    near = cells(asked, best_positives, "uid bigint, score bigint, other bigint")
    near = staged(near.withColumn("p", F.row_number().over(first(["uid"]))).filter(F.col("p") <= positives)
                  .withColumn("p", F.col("p").cast("long") - 1), "mine-positives")
    opened = asked.join(near.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "score"))),
                                                            lambda s: s["score"]).alias("positives")), "uid")
    far = cells(opened, best_negatives, "uid bigint, p bigint, score bigint, other bigint")
    far = far.withColumn("rank", F.row_number().over(first(["uid", "p"]))).filter(F.col("rank") <= negatives)
    return (far.join(near.select("uid", "p", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), ["uid", "p"])
            .join(rows.filter("anchor").select("uid", F.col("id").alias("anchor_id")), "uid")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row of ``embeddings`` against all rows; every 7th row's label is moved on."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.u, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.u <> b.u),
p AS (
  SELECT u, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY u ORDER BY score DESC, other) AS p
  FROM s WHERE same QUALIFY p <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.u, p.p ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.u = p.u AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
