"""The store's folders as a data source, and files asked for and written inside tasks."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.operators import check
from vellum.sources import directory, store

ODD = ["a,b", "{x}", "c[1]*", "d?", "ß é", "k\\1"]


@pytest.fixture
def root(tmp_path):
    for i in range(25):
        (tmp_path / f"key{i:02d}").mkdir()
        (tmp_path / f"key{i:02d}" / "paper.json").write_text(json.dumps({"key": f"key{i:02d}", "status": "draft"}))
    for k in ODD:
        (tmp_path / k).mkdir()
        (tmp_path / k / "paper.json").write_text(json.dumps({"key": k, "status": "clean"}))
    (tmp_path / "key00" / "empty").mkdir()
    (tmp_path / "key00" / "a.pdf").write_text("x")
    (tmp_path / "hollow").mkdir()
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "paper.json").write_bytes(b'{"key": "\xff"}')
    (tmp_path / "config.json").write_text("{}")
    return str(tmp_path)


def test_all_folders(spark, root):
    rows = {r["dir_key"]: r for r in directory.read_directories(spark, root, keys_a_task=7).collect()}
    assert len(rows) == 25 + len(ODD) + 2
    assert [tuple(f) for f in rows["key00"]["files"]] == [("a.pdf", False), ("empty", True), ("paper.json", False)]
    assert rows["hollow"]["value"] is None and rows["hollow"]["files"] == [] and rows["hollow"]["failure"] is None
    assert rows["latin"]["failure"] == "cannot read: UnicodeDecodeError"
    assert directory.read_directories(spark, root, keys_a_task=7).rdd.getNumPartitions() == 5
    loaded = {r["dir_key"]: r for r in store.load_records(directory.read_directories(spark, "file:" + root).where("value is not null or failure is not null"), strict=False).collect()}
    assert loaded["latin"]["load_error"] == "cannot read: UnicodeDecodeError" and loaded["{x}"]["load_error"] is None and "hollow" not in loaded


def test_keys_are_pushed(spark, root):
    some = directory.read_directories(spark, root).where(F.col("dir_key").isin("key01", "key02", "none", "../x", "") & (F.length("value") > 3))
    assert sorted(r["dir_key"] for r in some.collect()) == ["key01", "key02"] and some.rdd.getNumPartitions() == 1
    reader = directory._Reader("/no/such/root", 10)
    rest = list(reader.pushFilters([directory.In(("dir_key",), ("a", "b")), directory.EqualTo(("dir_key",), "b"), directory.EqualTo(("value",), "b")]))
    assert [p.value for p in reader.partitions()] == [["b"]] and len(rest) == 1  # nothing is listed
    assert sorted(r["dir_key"] for r in directory.read_directories(spark, root).where("dir_key like 'key1%'").collect()) == [f"key1{i}" for i in range(10)]


def test_scan_of_keys_with_any_characters(spark, root):
    assert sorted(r["key"] for r in store.scan_records(spark, root, [*ODD, "none"]).collect()) == sorted(ODD)
    with pytest.raises(Exception, match="cannot read"):
        store.scan_records(spark, root, ["latin"]).collect()


def test_empty_folders_are_seen_by_the_check(spark, root):
    rows = directory.read_directories(spark, root)
    papers = store.load_records(rows.where("value is not null"), strict=False)
    found = check.fsck(papers.where("load_error is null"), directory.directory_files(rows), spark.createDataFrame([], "path string"))
    assert sorted((r["key"], r["msg"]) for r in found.collect()) == [("key00", 'directory "empty" belongs to no version'), ("key00", 'file "a.pdf" belongs to no version')]


def test_status_and_asked_files(spark, root):
    asked = [f"{root}/key00/a.pdf", f"file://{root}/key01/paper.json", f"{root}/key00", f"{root}/none", "odd://x/y", f"{root}/none"]
    got = {r["path"]: r["kind"] for r in directory.file_status(spark.createDataFrame([(a,) for a in asked], "path string")).collect()}
    assert [got[a] for a in asked[:5]] == ["file", "file", "directory", "missing", "unreachable"] and len(got) == 5
    taken, failed = store.ingest_files(spark, spark.createDataFrame([(a,) for a in asked], "path string"))
    assert {(r["path"], r["length"]) for r in taken.select("path", "length").collect()} >= {(asked[0], 1)} and taken.count() == 2
    assert {r["detail"] for r in failed.collect()} == {"is a directory", "no such file", "cannot be reached"}
    assert store.ingest_files(spark, asked[:1], since="2999-01-01T00:00:00")[0].count() == 0
    assert store.ingest_files(spark, asked[:1], since="2000-01-01T00:00:00Z")[0].count() == 1


def test_written_folders(spark, tmp_path):
    rows = spark.range(30).select(F.concat(F.lit("k"), "id").alias("dir_key"), F.to_json(F.struct(F.concat(F.lit("k"), "id").alias("key"))).alias("value"))
    assert directory.write_directories(rows, str(tmp_path)) == 30 == directory.write_directories(rows, f"file://{tmp_path}")
    assert store.scan_records(spark, str(tmp_path)).count() == 30
    assert all(len(r["files"]) == 1 for r in directory.read_directories(spark, str(tmp_path)).collect())
