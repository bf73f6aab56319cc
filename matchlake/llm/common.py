"""Small helpers that several training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AZ = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
AZ_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def az_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is exact (and fast) where the text has ASCII alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and a
    lost executor costs only the tasks it was running."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL = 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table, marked for broadcast where it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def addressed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` and the same with its rows' addresses ``_file`` and ``_row``. Rows of files have
    one; any other table is written first."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        return docs, docs.select("*", *place)
    except AnalysisException:
        docs = staged(docs, "addressed")
        return docs, docs.select("*", *place)


def spare(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keep_columns(df: DataFrame, new: list[str]) -> list[str]:
    """Columns of ``df`` that do not clash with the result columns ``new``."""
    taken = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in taken]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, NULL as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one piece holds about ``limit`` bytes of ``column``
    (one row at least): bounds a task's memory whatever the texts' lengths."""
    import numpy as np
    import pyarrow.compute as pc
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def identifier(name: str) -> str:
    """``name`` quoted for a column reference."""
    return "`" + re.sub("`", "``", name) + "`"
