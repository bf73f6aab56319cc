"""Two-sided record → one row per side, in a single scan.

``explode(array(struct(side A), struct(side B)))`` replaces a UNION ALL of two
projections, which would scan (and recompute) the input twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_sided(df: DataFrame, sides: list[dict[str, str | Column]], keep: list[str] | None = None,
              side_col: str | None = None) -> DataFrame:
    """Unpivot ``df`` into one row per entry of ``sides``.

    ``sides`` maps output column → input column (or expression) per side; all sides
    must produce the same output names. ``keep`` columns are copied to every side.
    ``side_col`` optionally records the side index (0, 1, ...).
    """
    names = list(sides[0].keys())
    structs = []
    for i, side in enumerate(sides):
        fields = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in side.items()]
        if side_col:
            fields.append(F.lit(i).alias(side_col))
        structs.append(F.struct(*fields))
    out = df.select(*(keep or []), F.explode(F.array(*structs)).alias("_side"))
    cols = names + ([side_col] if side_col else [])
    return out.select(*(keep or []), *[F.col(f"_side.{c}").alias(c) for c in cols])
