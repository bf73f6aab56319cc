"""Latest / n-th row selection without one-task-per-key windows.

``latest_by`` keeps, per key, the row with the greatest order tuple using ``max_by``: a
combinable aggregate, so a key holding a third of the rows is reduced map-side like any
other. Only the order columns are compared; the others may have any type (maps, variants).
``nth_keys`` picks the n-th keys of a table in key order with a bounded top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str], where=None) -> DataFrame:
    """One row per ``keys``: a row with the largest ``order`` tuple (NULLs lose)."""
    if where is not None:
        df = df.filter(where)
    rest = [c for c in df.columns if c not in keys]
    pack = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
    g = df.groupBy(*keys).agg(F.max_by(pack, F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r._{i}").alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def nth_keys(df: DataFrame, key: str, positions: list[int]) -> DataFrame:
    """(position, key) for the requested 0-based positions of ``key`` in ascending order."""
    top = df.select(key).filter(F.col(key).isNotNull()).orderBy(F.col(key).asc()).limit(max(positions) + 1)
    place = (F.row_number().over(Window.orderBy(key)) - 1).alias("position")   # over the few rows of the top-k
    return top.select(place, key).filter(F.col("position").isin(positions))


def either_side(df: DataFrame, a: str, b: str, value=None) -> DataFrame:
    """Rows where ``value`` appears in column ``a`` or ``b``; ``None`` ("all") disables the filter."""
    if value is None:
        return df
    return df.filter((F.col(a) == F.lit(value)) | (F.col(b) == F.lit(value)))


def lookup_id(dim: DataFrame, name_col: str, id_col: str, names: DataFrame, as_col: str | None = None) -> DataFrame:
    """Attach the id of each name (name → id lookup as a join, for many names at once).

    A name that maps to several ids (two spellings of one entity are the opposite case)
    yields one row per id, as a relational lookup does."""
    d = dim.select(F.col(name_col).alias("_name"), F.col(id_col).alias(as_col or id_col)).distinct()
    return names.join(d, names[name_col] == d["_name"], "left").drop("_name")
