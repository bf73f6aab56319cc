"""Reconciliation of two copies of a table (e.g. a source store and a migrated copy).

Both sides are first *normalised*: column names lower-cased and every value rendered as
canonical text that loses nothing (``canonical_text``). Numbers in tolerance columns keep
a double beside their text for the tolerance; the text is the double's, or the number's own
digits where a double cannot hold them.

* counts and signed difference (right - left);
* null profile: one aggregate per side for all columns, unpivoted, joined on the column;
* order-free checksum: the four 32-bit parts of each row's MD5 over an unambiguous row text
  (a JSON array, so NULL, delimiters and empty text differ), summed part by part, + count;
* keyed diff: one aggregate over (key, row hash) with +1 for left and -1 for right rows
  finds what is left over; only the left-over rows' values are fetched, by a semi-join on the
  hash. They are paired by occurrence within their key (NULL keys pair with NULL keys) and
  compared cell by cell: both NULL are equal, one NULL differs, tolerance else.
  What is left over is written once, and counted: nothing left ends the diff there. While no
  key has more than ``KEY_ROWS`` left-over rows, a window by key numbers them; beyond that the
  same numbers are running totals over sorted ranges, so a key whose rows all differ is spread
  over as many tasks as it needs.
* one-row summary: every row is hashed once; equal checksums and an empty left-over table
  say the same of the two sides, so the summary reads the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import DEFAULT_TOLERANCE, canonical_text
from ..session import scratch_path
from .running import running_total

HASH = "_h"


def normalise(df: DataFrame, columns: list[str], numeric: list[str] | None = None) -> DataFrame:
    """Lower-case names; canonical text per column; ``numeric`` columns also as ``<c>__num``."""
    low = {c.lower(): c for c in df.columns}
    out = []
    for c in columns:
        src = F.col(low[c.lower()])
        if c in (numeric or []):
            dtype, num = df.schema[low[c.lower()]].dataType, src.cast("double")
            text = F.when(num == 0, F.lit("0.0")).otherwise(num.cast("string"))
            if isinstance(dtype, (T.DecimalType, T.IntegralType)):      # digits that a double would lose
                text = F.when(num.try_cast(dtype).eqNullSafe(src), text).otherwise(src.cast("string"))
            out += [text.alias(c), num.alias(f"{c}__num")]
        else:
            out.append(canonical_text(src, df.schema[low[c.lower()]].dataType).alias(c))
    return df.select(*out)


def row_text(columns: list[str]) -> Column:
    """Unambiguous text of a row: NULLs, quotes and delimiters cannot be confused."""
    return F.to_json(F.array(*[F.col(c) for c in columns]))


def row_hash(columns: list[str]) -> Column:
    return F.md5(row_text(columns))


def counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: left_rows, right_rows, row_diff (the right count enters as a scalar subquery)."""
    r = right.agg(F.count(F.lit(1))).scalar()
    l = left.agg(F.count(F.lit(1)).alias("left_rows")).select("left_rows", r.alias("right_rows"))
    return l.withColumn("row_diff", F.col("right_rows") - F.col("left_rows"))


def null_profile(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """(column, <prefix>_nulls) from one aggregate over all columns."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias(f"{prefix}_nulls")) for i, c in enumerate(columns)
    ])).alias("p")).select("p.*")


def null_compare(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    j = null_profile(left, columns, "left").join(null_profile(right, columns, "right"), "column", "full")
    return j.withColumn("match", F.col("left_nulls").eqNullSafe(F.col("right_nulls")))


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, checksum) — independent of row order and partitioning; all 128 hash bits count."""
    h = df.select(row_hash(columns).alias(HASH))
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(HASH, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")),
                                F.lit(0).cast("decimal(38,0)")).cast("string")
    return h.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *[part(i) for i in range(4)]).alias("checksum"))


BLOCK = 10_000
KEY_ROWS = 100_000      # left-over rows of a key that one window may number
KN, KV = "_kn", "_kv"   # key encoded as (is-null flag, value with NULL replaced): plain equi-joins


def _expand(groups: DataFrame, columns: list[str], block: int = BLOCK, hot: bool = True) -> DataFrame:
    """(encoded key, _n copies of _row) → one row per copy with its occurrence number in the key.

    Occurrence numbers follow the row text order inside a key: a running total over the
    left-over *groups* (one row per distinct row, never per copy), by a window per key or,
    with a ``hot`` key, over sorted ranges. Copies are produced in blocks of at most ``block``:
    the block list is redistributed before it is expanded, so a row repeated a billion times
    is spread over many tasks.
    """
    groups = groups.withColumn("_txt", row_text([f"_row.{c}" for c in columns]))
    if hot:
        g = running_total(groups, [KN, KV], ["_txt"], "_n", "_base")
    else:
        before = Window.partitionBy(KN, KV).orderBy("_txt").rowsBetween(Window.unboundedPreceding, -1)
        g = groups.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    blocks = g.select(KN, KV, "_row", "_n", "_base",
                      F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block).cast("long"))).alias("_b"))
    blocks = blocks.repartition(KN, KV, "_b", "_base")
    i = F.explode(F.sequence(F.col("_b") * block, F.least(F.col("_n"), (F.col("_b") + 1) * block) - 1))
    return blocks.select(KN, KV, "_row", "_base", i.alias("_i")).select(
        KN, KV, "_row", (F.col("_base") + F.col("_i") + 1).alias("_occ"))


def _keyed(df: DataFrame, key: str, columns: list[str], payload: list[str]) -> DataFrame:
    return df.select(F.col(key).isNull().alias(KN), F.coalesce(F.col(key), F.lit("")).alias(KV), row_hash(columns).alias(HASH), *payload)


def left_over(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(encoded key, row hash, _s): rows that the sides do not share, as copies more on the left
    (positive) or on the right; written once."""
    l, r = _keyed(left, key, columns, []), _keyed(right, key, columns, [])
    both = l.withColumn("_s", F.lit(1)).unionByName(r.withColumn("_s", F.lit(-1)))
    path = scratch_path(left.sparkSession, "left-over")
    both.groupBy(KN, KV, HASH).agg(F.sum("_s").alias("_s")).filter(F.col("_s") != 0).write.parquet(path)
    return left.sparkSession.read.parquet(path)


def paired(left: DataFrame, right: DataFrame, key: str, columns: list[str], numeric: list[str] | None = None,
           eps: float = DEFAULT_TOLERANCE, over: DataFrame | None = None, key_rows: int = KEY_ROWS) -> DataFrame:
    """Rows not identical on both sides, paired by occurrence within their key.

    Output: (key, occ, side ∈ {both, left_only, right_only}, cells array<struct<column,
    left_value, right_value, differs>>). NULL keys pair with NULL keys. ``over``: the sides'
    ``left_over``, where it is known already.
    """
    numeric = numeric or []
    payload = [*columns, *[f"{c}__num" for c in numeric]]
    l0, r0 = _keyed(left, key, columns, payload), _keyed(right, key, columns, payload)
    over = left_over(left, right, key, columns) if over is None else over
    most = over.groupBy(KN, KV, F.col("_s") > 0).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if not most:
        cell = "struct<column:string,left_value:string,right_value:string,differs:boolean>"
        return left.sparkSession.createDataFrame([], f"`{key}` string, occ bigint, side string, cells array<{cell}>")

    def residue(side, sign):
        """The side's left-over rows: values fetched by hash, one row per distinct row."""
        mine = over.filter(F.col("_s") * sign > 0).select(KN, KV, HASH, F.abs("_s").alias("_n"))
        rows = side.join(mine, [KN, KV, HASH])
        g = rows.groupBy(KN, KV, HASH).agg(F.max("_n").alias("_n"), F.first(F.struct(*payload)).alias("_row"))
        return _expand(g.drop(HASH), columns, hot=most > key_rows)

    p = residue(l0, 1).alias("l").join(residue(r0, -1).alias("r"), [KN, KV, "_occ"], "full")
    side = (F.when(F.col("l._row").isNull(), F.lit("right_only"))
            .when(F.col("r._row").isNull(), F.lit("left_only")).otherwise(F.lit("both")))
    cells = []
    for c in columns:
        same = F.col(f"l._row.{c}").eqNullSafe(F.col(f"r._row.{c}"))
        if c in numeric:
            a, b = F.col(f"l._row.{c}__num"), F.col(f"r._row.{c}__num")
            same = same | F.coalesce(F.abs(a - b) <= F.lit(eps), F.lit(False))
        cells.append(F.struct(F.lit(c).alias("column"), F.col(f"l._row.{c}").alias("left_value"),
                              F.col(f"r._row.{c}").alias("right_value"), (~same).alias("differs")))
    return p.select(F.when(~F.col(KN), F.col(KV)).alias(key), F.col("_occ").alias("occ"), side.alias("side"),
                    F.array(*cells).alias("cells"))


def diff(left: DataFrame, right: DataFrame, key: str, columns: list[str], numeric: list[str] | None = None,
         eps: float = DEFAULT_TOLERANCE, over: DataFrame | None = None) -> DataFrame:
    """Paired rows that differ or lack a partner: (key, occ, side, diff_columns array<string>)."""
    p = paired(left, right, key, columns, numeric, eps, over)
    dc = F.transform(F.filter("cells", lambda x: x["differs"]), lambda x: x["column"])
    out = p.select(key, "occ", "side", F.when(F.col("side") == "both", dc)
                   .otherwise(F.array().cast("array<string>")).alias("diff_columns"))
    return out.filter((F.col("side") != "both") | (F.size("diff_columns") > 0))


def cell_diffs(left: DataFrame, right: DataFrame, key: str, columns: list[str], numeric: list[str] | None = None,
               eps: float = DEFAULT_TOLERANCE) -> DataFrame:
    """One row per differing cell of paired rows: (key, occ, column, left_value, right_value)."""
    p = paired(left, right, key, columns, numeric, eps).filter(F.col("side") == "both")
    e = p.select(key, "occ", F.explode("cells").alias("x")).filter(F.col("x.differs"))
    return e.select(key, "occ", "x.column", "x.left_value", "x.right_value")


def summary(name: str, left: DataFrame, right: DataFrame, key: str, columns: list[str],
            numeric: list[str] | None = None, eps: float = DEFAULT_TOLERANCE) -> DataFrame:
    """One row: counts, checksum match, mismatching rows and both status modes."""
    over = left_over(left, right, key, columns)
    none = over.isEmpty()
    dc = diff(left, right, key, columns, numeric, eps, over).agg(
        F.count_if(F.col("side") == "both").alias("mismatched_rows"), F.count_if(F.col("side") == "left_only").alias("left_only_rows"),
        F.count_if(F.col("side") == "right_only").alias("right_only_rows"))
    j = dc.select(left.agg(F.count(F.lit(1))).scalar().alias("left_rows"), right.agg(F.count(F.lit(1))).scalar().alias("right_rows"), "*")
    eq_rows = F.col("left_rows") == F.col("right_rows")
    ck = F.lit(none)
    clean = (F.col("mismatched_rows") + F.col("left_only_rows") + F.col("right_only_rows")) == 0
    return j.select(F.lit(name).alias("table"), "left_rows", "right_rows",
                    (F.col("right_rows") - F.col("left_rows")).alias("row_diff"),
                    ck.alias("checksum_match"), "mismatched_rows", "left_only_rows", "right_only_rows",
                    F.when(eq_rows & ck, "MATCH").otherwise("MISMATCH").alias("status_strict"),
                    F.when(eq_rows & clean, "MATCH").otherwise("MISMATCH").alias("status_tolerant"))


def overall(summaries: DataFrame, status_col: str = "status_tolerant") -> DataFrame:
    """compared / match / mismatch and success | partial_success | failed."""
    g = summaries.agg(F.count(F.lit(1)).alias("compared"),
                      F.count_if(F.col(status_col) == "MATCH").alias("match_count"))
    g = g.withColumn("mismatch_count", F.col("compared") - F.col("match_count"))
    return g.withColumn("status", F.when(F.col("mismatch_count") == 0, "success")
                        .when(F.col("match_count") > 0, "partial_success").otherwise("failed"))
