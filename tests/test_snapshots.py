"""Commits of a store of records: what readers see, who wins, and what a killed writer leaves."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.schema import RECORD
from vellum.sources import snapshots


def rows(spark, *pairs):
    made = spark.createDataFrame(list(pairs), "key string, status string")
    return made.select(*(F.col(f.name) if f.name in ("key", "status") else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RECORD).fields))


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def seen(spark, root, version=None):
    return {r["key"]: r["status"] for r in snapshots.read(spark, root, version).collect()}


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert seen(spark, root) == {}
    assert snapshots.commit(spark, root, rows(spark, ("a", "draft"), ("b", "draft"), ("c", "draft"))) == 1
    assert snapshots.commit(spark, root, rows(spark, ("b", "clean"), ("d", "draft")), keys(spark, "a")) == 2
    assert snapshots.commit(spark, root, removed=keys(spark, "c", "none")) == 3
    assert snapshots.commit(spark, root, rows(spark, ("a", "back"))) == 4
    assert [seen(spark, root, v) for v in (1, 2, 3)] == [{"a": "draft", "b": "draft", "c": "draft"}, {"b": "clean", "c": "draft", "d": "draft"}, {"b": "clean", "d": "draft"}]
    assert seen(spark, root) == {"a": "back", "b": "clean", "d": "draft"}
    assert {tuple(r) for r in snapshots.changes(spark, root, 2).collect()} == {("a", False), ("c", True), ("none", True)}
    with pytest.raises(ValueError, match="no version 9"):
        snapshots.read(spark, root, 9)
    with pytest.raises(ValueError, match="more than once: x"):
        snapshots.commit(spark, root, rows(spark, ("x", "1"), ("x", "2")))
    assert snapshots.compact(spark, root) == 5 and len(snapshots.snapshot(spark, root).parts) == 1
    assert seen(spark, root) == {"a": "back", "b": "clean", "d": "draft"} and seen(spark, root, 4) == seen(spark, root)
    gone = snapshots.expire(spark, root, keep=1, older_than_hours=0)
    assert len(gone) == 4 and seen(spark, root) == {"a": "back", "b": "clean", "d": "draft"} and len(os.listdir(tmp_path / "data")) == 1


def test_conflicts(spark, tmp_path):
    root = str(tmp_path)
    base = snapshots.commit(spark, root, rows(spark, ("a", "draft"), ("b", "draft")))
    assert snapshots.commit(spark, root, rows(spark, ("a", "first")), base=base) == 2
    with pytest.raises(snapshots.CommitConflict) as e:
        snapshots.commit(spark, root, rows(spark, ("a", "second"), ("c", "new")), base=base)
    assert (e.value.version, e.value.keys) == (2, ["a"]) and seen(spark, root) == {"a": "first", "b": "draft"}
    with pytest.raises(snapshots.CommitConflict):
        snapshots.commit(spark, root, removed=keys(spark, "a"), base=base)
    assert snapshots.commit(spark, root, rows(spark, ("b", "other")), base=base) == 3  # another record: both are kept
    assert seen(spark, root) == {"a": "first", "b": "other"}
    assert snapshots.compact(spark, root) == 4
    with pytest.raises(snapshots.CommitConflict):
        snapshots.commit(spark, root, rows(spark, ("a", "late")), base=base)
    assert snapshots.commit(spark, root, removed=keys(spark, "b"), base=3) == 5  # the compaction itself changes no record
    snapshots.compact(spark, root)
    with pytest.raises(snapshots.CommitConflict):
        snapshots.commit(spark, root, rows(spark, ("b", "late")), base=4)  # gone since


def test_writers_at_once(spark, tmp_path):
    root = str(tmp_path)
    snapshots.commit(spark, root, rows(spark, ("a", "0")))

    def write(i):
        try:
            return snapshots.commit(spark, root, rows(spark, ("a", str(i)), (f"own{i}", "x")), base=1)
        except snapshots.CommitConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(write, range(1, 5)))
    assert [v for v in won if v] == [2]
    i = won.index(2) + 1
    assert seen(spark, root) == {"a": str(i), f"own{i}": "x"}
    with ThreadPoolExecutor(3) as pool:  # different records: all are kept, one after another
        assert sorted(pool.map(lambda i: snapshots.commit(spark, root, rows(spark, (f"more{i}", "y"))), range(3))) == [3, 4, 5]
    assert len(seen(spark, root)) == 5


def test_a_killed_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    snapshots.commit(spark, root, rows(spark, ("a", "old")))
    broken = rows(spark, ("a", "new"), ("b", "new")).withColumn("status", F.when(F.col("key") == "b", F.raise_error(F.lit("stop"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="stop"):
        snapshots.commit(spark, root, broken)
    monkeypatch.setattr(snapshots, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))  # killed between data and manifest
    with pytest.raises(KeyboardInterrupt):
        snapshots.commit(spark, root, rows(spark, ("a", "new")))
    monkeypatch.undo()
    assert seen(spark, root) == {"a": "old"} and snapshots.snapshot(spark, root).version == 1
    assert snapshots.expire(spark, root, older_than_hours=1) == []  # may be somebody's work in progress
    assert len(snapshots.expire(spark, root, older_than_hours=0)) >= 1 and seen(spark, root) == {"a": "old"}


def test_a_key_is_pushed_to_all_parts(spark, tmp_path):
    root = str(tmp_path)
    snapshots.commit(spark, root, rows(spark, ("a", "1"), ("b", "1")))
    snapshots.commit(spark, root, rows(spark, ("b", "2")))
    one = snapshots.read(spark, root).where("key = 'b'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(key,b)") >= 2 and [r["status"] for r in one.collect()] == ["2"]
