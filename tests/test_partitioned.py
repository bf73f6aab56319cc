"""Partition-level merge: only touched partitions are rewritten, versions commit by a rename."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from matchlake.streaming.partitioned import PartitionedTable

SCHEMA = "k bigint, day date, v int, name string"


def rows(spark, data):
    import datetime as dt
    return spark.createDataFrame([(k, dt.date(2024, m, d) if m else None, v, n) for k, m, d, v, n in data], SCHEMA)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def state(df):
    return sorted(map(tuple, df.select("k", "v", "name").collect()), key=str)


@pytest.mark.parametrize("by", ["hash", "month"])
def test_only_touched_partitions_are_rewritten(spark, tmp_path, by):
    path = str(tmp_path / "t")
    t = PartitionedTable(spark, path, "k", by="hash" if by == "hash" else F.date_format("day", "yyyy-MM"), buckets=8, high_water="day")
    assert t.read() is None and t.high() is None
    first = [(i, 1 + i % 6, 1, 0, f"n{i}") for i in range(60)] + [(None, 1, 1, 0, "no key")]
    t.merge(rows(spark, first), 0)
    assert state(t.read()) == state(rows(spark, first)) and t.high() == "2024-06-01"
    before = files(path)
    # by month: key 7 moves from month 2 to month 9, key 100 is new in month 9; of two rows of a key the greater stays
    batch = rows(spark, [(7, 9, 5, 1, "moved"), (100, 9, 6, 1, "new"), (100, 9, 6, 2, "new")])
    parts = t.merge(batch, 1, prefer=["v"])
    assert parts == (["2024-02", "2024-09"] if by == "month" else sorted(parts)) and 1 <= len(parts) <= 2
    after = files(path)
    assert all(after[f] == m for f, m in before.items())           # nothing old was written again
    assert {f.split("_p=")[1].split("/")[0] for f in after if f not in before} <= set(parts)
    want = [x for x in first if x[0] != 7] + [(7, 9, 5, 1, "moved"), (100, 9, 6, 2, "new")]
    assert state(t.read()) == state(rows(spark, want)) and t.high() == "2024-09-06"
    assert state(t.read(0)) == state(rows(spark, first))           # the old version is still there
    assert {r.partition for r in t.log().collect() if r.epoch == 1} == set(parts)
    assert sum(r.rows for r in t.log().collect()) == len(want)


def test_a_retried_epoch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    t = PartitionedTable(spark, path, "k", buckets=4)
    t.merge(rows(spark, [(1, 1, 1, 1, "a")]), 3)
    seen = files(path)
    assert t.merge(rows(spark, [(1, 1, 1, 9, "z")]), 3) == [] and t.merge(rows(spark, [(2, 1, 1, 9, "z")]), 2) == []
    assert files(path) == seen and state(t.read()) == [(1, 1, "a")]


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    t = PartitionedTable(spark, path, "k", buckets=4)
    t.merge(rows(spark, [(1, 1, 1, 1, "a"), (2, 1, 1, 1, "b")]), 0)

    def die(v):
        raise RuntimeError("lost")
    monkeypatch.setattr(t, "_commit", die)
    with pytest.raises(RuntimeError, match="lost"):
        t.merge(rows(spark, [(1, 1, 1, 2, "changed")]), 1)
    monkeypatch.undo()
    assert len(files(path)) > 2 and state(t.read()) == [(1, 1, "a"), (2, 1, "b")]
    assert t.merge(rows(spark, [(1, 1, 1, 2, "changed")]), 1) and state(t.read()) == [(1, 2, "changed"), (2, 1, "b")]
    gone = t.vacuum(keep=1)
    assert len(gone) >= 1 and state(t.read()) == [(1, 2, "changed"), (2, 1, "b")]


def test_empty_batches_and_odd_partition_values(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"), "k", by=F.col("name"))
    t.merge(rows(spark, []), 0)
    assert t.read().count() == 0
    odd = [(1, 1, 1, 1, "a/b=c %"), (2, 1, 1, 1, None), (3, 1, 1, 1, "x:y")]
    t.merge(rows(spark, odd), 1)
    assert state(t.read()) == state(rows(spark, odd))
    t.merge(rows(spark, [(1, 1, 1, 5, "x:y")]), 2)
    assert state(t.read()) == state(rows(spark, [(1, 1, 1, 5, "x:y"), *odd[1:]]))
    assert t.merge(rows(spark, []), 3) == [] and t.version().epoch == 3
