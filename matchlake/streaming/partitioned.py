"""A keyed table merged partition by partition (copy on write), with atomic versions.

Layout under the table's folder: ``data/<epoch>-<attempt>/_p=<partition>/*.parquet`` and
``versions/<epoch>.json``. A version lists for every partition the folder that holds it, its
rows and its high-water mark. A merge reads and rewrites only the partitions that a batch
touches, into a new data folder; then it writes the next version beside the others under a
temporary name and commits it by one rename. Readers take the newest committed version, so
until the rename they see the old table, whole; data of an attempt that died is never listed.
An epoch that is already committed changes nothing, whoever retries it.

A partition is a stable function of the row. With ``by="hash"`` it is one of ``buckets`` hash
ranges of the key, so a key never moves. With a column expression (say, the month of an event)
a changed row may move: the partitions that hold the batch's keys are then looked up, reading
the key column alone.

The list of partitions is held by the driver: thousands, not rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.marts import dedupe_by_key

PART = "_p"


@dataclass
class Version:
    epoch: int
    schema: str = ""                                             # of the rows, as JSON
    parts: dict[str, dict] = field(default_factory=dict)        # partition -> {path, rows, high, epoch}


class PartitionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, by: str | Column = "hash", buckets: int = 64,
                 high_water: str | None = None):
        self.spark, self.path, self.key, self.by, self.buckets, self.high_water = spark, path.rstrip("/"), key, by, buckets, high_water

    # --- files ---------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self) -> list[int]:
        p, fs = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, epoch: int | None = None) -> Version | None:
        """The newest committed version, or the one of ``epoch``."""
        done = self._committed()
        if not done or (epoch is not None and epoch not in done):
            return None
        epoch = done[-1] if epoch is None else epoch
        p, fs = self._fs(f"{self.path}/versions/{epoch:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _commit(self, v: Version) -> bool:
        """Publish ``v`` by a rename; False where another attempt was first."""
        tmp, fs = self._fs(f"{self.path}/versions/.{v.epoch}-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(v.__dict__, sort_keys=True).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/versions/{v.epoch:012d}.json")
        if not fs.exists(final) and fs.rename(tmp, final):
            return True
        fs.delete(tmp, False)
        return False

    # --- rows ------------------------------------------------------------------------------

    def _part(self) -> Column:
        if isinstance(self.by, Column):
            return F.coalesce(self.by.cast("string"), F.lit("none"))
        return F.coalesce(F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)), F.lit(0)).cast("string")

    def _rows(self, v: Version, parts: list[str] | None = None) -> DataFrame:
        schema = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(v.schema).toDDL()
        paths = [v.parts[p]["path"] for p in (v.parts if parts is None else parts) if p in v.parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, epoch: int | None = None) -> DataFrame | None:
        """The table as of the newest (or the given) version; None before the first."""
        v = self.version(epoch)
        return None if v is None else self._rows(v)

    def high(self) -> str | None:
        """The high-water mark from the version alone, as text; no row is read."""
        v = self.version()
        marks = [p["high"] for p in v.parts.values() if p["high"] is not None] if v else []
        return max(marks, default=None)

    def touched(self, batch: DataFrame, v: Version) -> list[str]:
        """Partitions that a merge of ``batch`` rewrites."""
        new = {r[0] for r in batch.select(self._part().alias(PART)).distinct().collect()}
        if isinstance(self.by, Column) and v.parts:
            old = self._rows(v).select(self.key, self._part().alias(PART))
            keys = batch.select(self.key).distinct()
            new |= {r[0] for r in old.join(keys, self.key, "left_semi").select(PART).distinct().collect()}
        return sorted(new)

    def merge(self, batch: DataFrame, epoch: int, prefer: list[str] | None = None) -> list[str]:
        """Upsert ``batch`` by key as version ``epoch``; the partitions rewritten (none where the
        epoch, or a later one, is committed already). Of a key's rows in the batch the greatest by
        ``prefer`` stays; rows with a NULL key are appended."""
        done = self._committed()
        if done and done[-1] >= epoch:
            return []
        v = self.version() or Version(-1)
        batch = dedupe_by_key(batch, self.key, prefer)
        parts = self.touched(batch, v)
        schema, found = batch.schema.json(), {}
        if parts:
            old = self._rows(v, parts) if v.parts else None
            keys = batch.select(self.key).filter(F.col(self.key).isNotNull())
            rows = batch if old is None else old.join(keys, self.key, "left_anti").select(*batch.columns).unionByName(batch)
            folder = f"{self.path}/data/{epoch:012d}-{uuid.uuid4().hex[:8]}"
            # one shuffle by partition; AQE splits a large one over several files
            (rows.withColumn(PART, self._part()).hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(folder))
            high = F.max(self.high_water).cast("string") if self.high_water else F.lit(None).cast("string")
            written = self.spark.read.schema(f"{batch.schema.toDDL()}, {PART} string").parquet(folder)
            found = {r[PART]: {"path": f"{folder}/{PART}={_escaped(r[PART])}", "rows": r["rows"], "high": r["high"], "epoch": epoch}
                     for r in written.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), high.alias("high")).collect()}
        kept = {p: x for p, x in v.parts.items() if p not in parts}
        return parts if self._commit(Version(epoch, schema, {**kept, **found})) else []

    def log(self) -> DataFrame:
        """(partition, epoch that last wrote it, rows, high-water mark) of the newest version."""
        v = self.version()
        rows = [(p, x["epoch"], x["rows"], x["high"]) for p, x in sorted(v.parts.items())] if v else []
        return self.spark.createDataFrame(rows, "partition string, epoch int, rows bigint, high string")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete versions but the newest ``keep`` and the data folders that these do not list
        (also those of attempts that died). Run it where no merge is under way."""
        done = self._committed()
        listed = {x["path"].rsplit("/", 2)[1] for e in done[-keep:] for x in self.version(e).parts.values()}
        for e in done[:-keep]:
            p, fs = self._fs(f"{self.path}/versions/{e:012d}.json")
            fs.delete(p, False)
        p, fs = self._fs(f"{self.path}/data")
        gone = [st.getPath() for st in (fs.listStatus(p) if fs.exists(p) else []) if st.getPath().getName() not in listed]
        for g in gone:
            fs.delete(g, True)
        return sorted(g.getName() for g in gone)


def _escaped(value: str) -> str:
    """A partition value as Spark writes it into a path."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{}[]^" or ord(c) < 32 else c for c in value) or "__HIVE_DEFAULT_PARTITION__"
