"""Session helper: one place for the settings every job relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Sizing for large clusters (hundreds of TB): many initial shuffle partitions that AQE
# coalesces to ~256 MB each, 256 MB scan splits, skew splitting above 1 GB. Partitions
# stay far below executor memory, so sorts and aggregations spill rarely.
CLUSTER = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def get_session(master: str | None = None, app: str = "matchlake",
                shuffle_partitions: int | None = None, extra: dict | None = None,
                profile: str | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster ``master`` stays ``None`` and the launcher decides (``profile="cluster"``
    adds the large-scale sizing above); locally the tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    if profile == "cluster":
        conf.update(CLUSTER)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is taken only where none is configured and the master is
    ``local[...]`` (driver and executors are then one process); any other master without
    a configured folder raises, because executors could not see each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set; master {master} needs a folder all executors share")
        d = tempfile.mkdtemp(prefix="matchlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder for a written intermediate table; removed at exit."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/matchlake/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(drop_scratch)
    _SCRATCH.append((spark, path))
    return path


def scratch_tables() -> list[str]:
    """Paths of the intermediate tables that exist now."""
    return [path for _, path in _SCRATCH]


def drop_scratch(paths: list[str] | None = None) -> None:
    """Delete the intermediate tables written so far, or those of ``paths`` (runs at interpreter exit,
    or call it once the results that read them are no longer needed)."""
    chosen = [x for x in _SCRATCH if paths is None or x[1] in paths]
    while chosen:
        spark, path = chosen.pop()
        _SCRATCH.remove((spark, path))
        if spark.sparkContext._jsc is None:   # session already stopped
            continue
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
