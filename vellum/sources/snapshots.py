"""A store of records under commits: immutable parts, one manifest a commit, and one winner a version.

<root>/data holds parts, each written whole by one commit: changed records, and
keys of removed ones.  <root>/commits/<version>.json lists the parts that make
up a version.  A manifest appears complete or not at all and never replaces
another, so a writer that was killed leaves the last version as it was, and of
two writers that aim at the same version one is told that it came too late.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.schema import RECORD, RECORD_FIELDS

TOLD_KEYS = 20


class CommitConflict(RuntimeError):
    """Another writer has changed the same records since the version that a commit is based on; nothing was changed."""

    def __init__(self, version: int, keys: list[str]):
        super().__init__(f"version {version} has changed the same records: {', '.join(keys)}")
        self.version, self.keys = version, keys


@dataclass(frozen=True)
class Snapshot:
    """A version, its parts, (version, folder) with the oldest first, and the last batch that each writer of batches has committed."""

    version: int = 0
    parts: tuple[tuple[int, str], ...] = ()
    batches: tuple[tuple[str, int], ...] = ()


def _schema() -> StructType:
    return StructType.fromDDL(RECORD + ", _removed boolean")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, path.makeQualified(fs.getUri(), fs.getWorkingDirectory())


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _path(spark, f"{root}/commits")
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The last version, or a given one that is still kept; version 0 is the empty store."""
    known = _versions(spark, root)
    version = (known[-1] if known else 0) if version is None else version
    if not version:
        return Snapshot()
    if version not in known:
        raise ValueError(f"{root} has no version {version}")
    fs, path = _path(spark, f"{root}/commits/{version:020d}.json")
    stream = fs.open(path)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(version, tuple((p["version"], p["path"]) for p in said["parts"]), tuple(sorted(said.get("batches", {}).items())))


def publish(spark: SparkSession, root: str, made: Snapshot) -> bool:
    """Write the manifest of a version; false if it has one already."""
    fs, draft = _path(spark, f"{root}/commits/.{uuid.uuid4().hex}")
    _, final = _path(spark, f"{root}/commits/{made.version:020d}.json")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({"version": made.version, "parts": [{"version": v, "path": p} for v, p in made.parts], "batches": dict(made.batches)}), "utf-8"))
    stream.close()
    jvm = spark._jvm
    try:
        if final.toUri().getScheme() == "file":  # a link is made at once and only where nothing is; a local rename replaces
            file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(file(final), file(draft))
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            how = spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, how)
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)


def _write(spark: SparkSession, root: str, changed: DataFrame | None, removed: DataFrame | None) -> str:
    """A new part of whole records (RECORD) and of keys (key) that go; each key once."""
    fields = _schema().fields
    none = spark.createDataFrame([], _schema())
    rows = none if changed is None else changed.select(*RECORD_FIELDS, F.lit(False).alias("_removed"))
    gone = none if removed is None else removed.select("key", *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields[1:-1]), F.lit(True).alias("_removed"))
    rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in fields)).unionByName(gone)
    name = f"data/{uuid.uuid4().hex}"
    rows.sortWithinPartitions("key").write.option("compression", "zstd").parquet(f"{root}/{name}")
    odd = _part(spark, root, name).groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key is null").select("key").limit(TOLD_KEYS).collect()
    if odd:
        _drop(spark, root, name)
        raise ValueError(f"keys that are null or come more than once: {', '.join(sorted(str(r['key']) for r in odd))}")
    return name


def _part(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_schema()).parquet(f"{root}/{name}")


def _drop(spark: SparkSession, root: str, name: str) -> None:
    fs, path = _path(spark, f"{root}/{name}")
    fs.delete(path, True)


def commit(spark: SparkSession, root: str, changed: DataFrame | None = None, removed: DataFrame | None = None, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
    """Store whole records (RECORD) and remove keys (key), all of them or none; the new version.

    base is the version that the caller has read, the last one if it isn't
    given.  A writer that was overtaken goes on from the newer version if that
    has changed other records only, and gets CommitConflict otherwise.  batch
    names a writer and the number of its batch: a number that it has committed
    before, or a lower one, changes nothing.
    """
    before = snapshot(spark, root, base)
    if _is_done(snapshot(spark, root) if batch else before, batch):
        return snapshot(spark, root).version
    name = _write(spark, root, changed, removed)
    while True:
        newest = snapshot(spark, root)
        if _is_done(newest, batch):  # another copy of the same writer was faster
            _drop(spark, root, name)
            return newest.version
        if newest.version > before.version:
            found = _touched(spark, root, before, newest, name)
            if found:
                _drop(spark, root, name)
                raise CommitConflict(newest.version, found)
            before = newest
        made = Snapshot(newest.version + 1, (*newest.parts, (newest.version + 1, name)), _with(newest, batch))
        if publish(spark, root, made):
            return made.version


def _is_done(at: Snapshot, batch: tuple[str, int] | None) -> bool:
    return batch is not None and dict(at.batches).get(batch[0], -1) >= batch[1]


def _with(at: Snapshot, batch: tuple[str, int] | None) -> tuple[tuple[str, int], ...]:
    return tuple(sorted((dict(at.batches) | dict([batch] if batch else [])).items()))


def _touched(spark: SparkSession, root: str, before: Snapshot, newest: Snapshot, name: str) -> list[str]:
    """Some keys of a part that versions after `before` may have changed.  Where those were compacted, all their keys count, and keys that have gone."""
    theirs = [_part(spark, root, p).select("key") for v, p in newest.parts if v > before.version]
    if not set(before.parts) <= set(newest.parts):
        theirs.append(_rows(spark, root, before).select("key").join(_rows(spark, root, newest).select("key"), "key", "left_anti"))
    if not theirs:
        return []
    same = _part(spark, root, name).select("key").join(reduce(DataFrame.unionByName, theirs), "key", "left_semi")
    return sorted(r["key"] for r in same.limit(TOLD_KEYS).collect())


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """RECORD rows of a version.

    The oldest part is read past the keys of later ones, whose newest row a key
    counts; a filter on key reaches the files of all parts.
    """
    return _rows(spark, root, snapshot(spark, root, version))


def _rows(spark: SparkSession, root: str, at: Snapshot) -> DataFrame:
    if not at.parts:
        return spark.createDataFrame([], StructType.fromDDL(RECORD))
    first = _part(spark, root, at.parts[0][1])
    later = [_part(spark, root, p).withColumn("_v", F.lit(v)) for v, p in at.parts[1:]]
    if later:
        newest = reduce(DataFrame.unionByName, later).withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_v")))).where("_r = 1").drop("_r", "_v")
        first = first.join(newest.select("key"), "key", "left_anti").select(*first.columns).unionByName(newest)
    return first.where("not _removed").select(*RECORD_FIELDS)


def changes(spark: SparkSession, root: str, since: int, version: int | None = None) -> DataFrame:
    """(key, removed) of the records that commits after `since` have touched, each once; after a compaction past `since`, all keys count as touched."""
    at = snapshot(spark, root, version)
    parts = [_part(spark, root, p).select("key", F.col("_removed").alias("removed"), F.lit(v).alias("_v")) for v, p in at.parts if v > since]
    if not parts:
        return spark.createDataFrame([], "key string, removed boolean")
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max_by("removed", "_v").alias("removed"))


def compact(spark: SparkSession, root: str) -> int:
    """The last version's rows as one part, under a version of its own; CommitConflict if another writer was faster.

    The part counts as old as the version that it repeats, so writers based on
    that version go on undisturbed.
    """
    at = snapshot(spark, root)
    if len(at.parts) <= 1:
        return at.version
    name = _write(spark, root, _rows(spark, root, at).repartitionByRange("key"), None)
    if not publish(spark, root, Snapshot(at.version + 1, ((at.version, name),), at.batches)):
        _drop(spark, root, name)
        raise CommitConflict(at.version + 1, [])
    return at.version + 1


def expire(spark: SparkSession, root: str, keep: int = 10, older_than_hours: float = 24.0) -> list[str]:
    """Forget all but the last `keep` versions, and drop parts that no kept version lists and that are old enough to be nobody's work in progress; the parts that went."""
    known = _versions(spark, root)
    kept = {p for v in known[-keep:] for _, p in snapshot(spark, root, v).parts}
    for v in known[:-keep]:
        _drop(spark, root, f"commits/{v:020d}.json")
    fs, path = _path(spark, f"{root}/data")
    latest = (time.time() - 3600 * older_than_hours) * 1000
    gone = [f"data/{s.getPath().getName()}" for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getModificationTime() <= latest]
    gone = sorted(set(gone) - kept)
    for name in gone:
        _drop(spark, root, name)
    return gone
