"""File-level sources: object listings, text logs, JSON reports; and simple sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def newest_files(spark: SparkSession, path: str, n: int = 30, glob: str = "*") -> DataFrame:
    """Newest ``n`` objects under ``path``: (path, modificationTime, length), newest first.

    Only file metadata is read: the ``content`` column is never selected.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return (files.select("path", "modificationTime", "length")
            .orderBy(F.col("modificationTime").desc(), F.col("path")).limit(n))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files line by line: (file, value)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files line by line with places: (file, line_no from 1, value), read in parallel.

    A line's place within its split is known where it is read; the splits' line counts, one row
    per split, give every split the number of lines before it in its file. Lines are written once,
    so that both see the same splits.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                                       "value", F.monotonically_increasing_id().alias("at"))
    scratch = scratch_path(spark, "lines")
    raw.write.parquet(scratch)
    lines = spark.read.parquet(scratch)
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(placed, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def missing_path(e: AnalysisException) -> bool:
    """Whether a read failed because there is nothing at its path (any other failure is one)."""
    return e.getCondition() == "PATH_NOT_FOUND"


def json_reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON reports with a fixed schema; unreadable records are dropped, a missing folder is empty."""
    s = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
    try:
        df = (spark.read.schema(s).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return spark.createDataFrame([], schema)
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def land_snapshot(docs: DataFrame, path: str, col: str = "json") -> bool:
    """Write raw documents, replacing the previous snapshot — but write nothing when the
    payload has no events (an empty landing never replaces a good one)."""
    nonempty = docs.filter(F.coalesce(F.json_array_length(F.get_json_object(F.col(col), "$.events")), F.lit(0)) > 0)
    if nonempty.isEmpty():
        return False
    nonempty.select(col).write.mode("overwrite").text(path)
    return True


def materialise(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy") -> DataFrame:
    """Drop-and-recreate a table at ``path`` and return the re-read table."""
    df.write.mode("overwrite").option("compression", compression).format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Nested reports as JSON; flat reports as CSV with a header (a part file per partition)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)
