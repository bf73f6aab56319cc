"""Parquet table access with explicit projections (column pruning reaches the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy handle over a folder of ``<name>.parquet`` tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df.select(*columns) if columns else df

    def __getattr__(self, name: str):
        if name in TABLES:
            return lambda columns=None: self.read(name, columns)
        raise AttributeError(name)
