"""Scanning a store of record documents and its event log."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.schema import EVENT, EVENT_FIELDS, RECORD, RECORD_FIELDS
from vellum.session import cut
from vellum.sources import directory

STORE = "spark.vellum.store"
_TEXT, _OBJECT, _LIST, _NUMBER, _FLAG = "STRING", "OBJECT", "ARRAY", "BIGINT", "BOOLEAN"
_MEMBERS = {
    "": {"key": _TEXT, "status": _TEXT, "pending": _TEXT, "bibtex": _OBJECT, "doi": _TEXT, "arxiv": _OBJECT, "isbn": _TEXT, "leeds": _TEXT, "abstract": _TEXT, "holdings": _TEXT, "versions": _OBJECT, "audit": _OBJECT, "log": _LIST},
    "bibtex": {"type": _TEXT, "fields": _OBJECT},
    "arxiv": {"id": _TEXT, "version": _NUMBER},
    "versions": {"acquired": _TEXT, "source": _TEXT, "deprecated": _FLAG, "note": _TEXT},
    "log": {"when": _TEXT, "action": _TEXT, "detail": _TEXT},
}


def _kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, BIGINT, BOOLEAN, ... of a variant; VOID for null."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))


def _fault(v: Column, part: str) -> Column:
    """What is wrong with the members of one object of a record, null if nothing is."""
    members, path = _MEMBERS[part], f"{part}." if part else ""
    unknown = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, members)))
    kinds = [F.when(~_kind(F.try_variant_get(v, f"$.{n}", "variant")).isin(k, "VOID"), F.lit(f"member {path}{n} is no {k.lower()}")) for n, k in members.items()]
    other = F.when(F.size(unknown) > 0, F.concat(F.lit(f"unknown member {path}"), F.try_element_at(unknown, F.lit(1))))
    return F.when(_kind(v) != _OBJECT, f"{part or 'record'} is no object").otherwise(F.coalesce(other, *kinds))


def _first_fault(parts: Column, part: str) -> Column:
    return F.try_element_at(F.filter(F.transform(parts, lambda v: _fault(v, part)), lambda x: x.isNotNull()), F.lit(1))


def load_error(value: Column) -> Column:
    """Why a JSON text is no record: not JSON, a member that RECORD lacks or one of another type, at any depth; null if it is one."""
    v = F.try_parse_json(value)
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    none = F.lit(None).cast("string")
    one = lambda part: F.when(_kind(get(part, "variant")) != "VOID", _fault(get(part, "variant"), part)).otherwise(none)
    fields = F.map_entries(get("bibtex.fields", "map<string,variant>"))
    texts = F.try_element_at(F.filter(fields, lambda e: ~_kind(e["value"]).isin(_TEXT, "VOID")), F.lit(1))["key"]
    several = F.coalesce(one("bibtex"), F.concat(F.lit("member bibtex.fields."), texts, F.lit(" is no string")), one("arxiv"), _first_fault(F.map_values(get("versions", "map<string,variant>")), "versions"), _first_fault(get("log", "array<variant>"), "log"))
    return F.when(v.isNull(), "not a JSON object").otherwise(F.coalesce(_fault(v, ""), several))


def open_store(spark: SparkSession, root: str | None = None) -> str:
    """The store's root: the argument, or else the session's setting STORE; it must be a folder.  One status call on the driver."""
    asked = root or spark.conf.get(STORE, None)
    if not asked:
        raise ValueError(f"which store? pass a root or set {STORE}")
    path = spark._jvm.org.apache.hadoop.fs.Path(asked)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"{asked} is no folder ({'argument' if root else STORE})")
    return asked


def scan_records(spark: SparkSession, root: str | None = None, keys: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Rows of RECORD with dir_key and load_error, one for each <root>/<key>/paper.json.

    keys are looked up one by one by the store's data source, with nothing
    listed.  A document that is no record has a load_error; with strict the
    whole scan fails on it when it is used.  root is that of open_store().
    """
    root = open_store(spark, root)
    if keys:
        raw = directory.read_directories(spark, root, keys).where("value is not null or failure is not null").select("value", "dir_key", "failure")
    else:
        raw = spark.read.text(f"{root}/*/paper.json", wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dir_key"), F.lit(None).cast("string").alias("failure"))
    return load_records(raw, strict)


def load_records(documents: DataFrame, strict: bool = True) -> DataFrame:
    """RECORD rows with dir_key and load_error of documents (dir_key, value, failure): what could not be read has its failure as load_error."""
    error = F.coalesce("failure", load_error(F.col("value")))
    loaded = documents.select("dir_key", error.alias("load_error"), F.from_json("value", RECORD).alias("r"))
    if strict:
        loaded = loaded.withColumn("r", F.when(F.col("load_error").isNull(), F.col("r")).otherwise(F.raise_error(F.concat("dir_key", F.lit(": "), "load_error"))))
    return loaded.select("dir_key", "load_error", "r.*")


def load_config(spark: SparkSession, root: str) -> dict:
    """The store's settings, read on the driver; none without a file, and an unknown one is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/config.json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    config = json.loads(spark.read.text(f"{root}/config.json", wholetext=True).first()[0])
    if unknown := sorted(set(config) - {"email"}):
        raise ValueError(f"unknown member {unknown[0]} in {root}/config.json")
    return config


def store_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file below root, relative to it; empty directories don't show."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(F.expr("substring(path, locate('{}', path) + {})".format(top.replace("'", "\\'"), len(top) + 1)).alias("path"))


def entry_files(records: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, name, is_dir): what the directory of each record (dir_key) holds at its first level."""
    parts = F.split("path", "/")
    inside = paths.where(F.size(parts) > 1).select(parts[0].alias("key"), parts[1].alias("name"), (F.size(parts) > 2).alias("is_dir")).distinct()
    return inside.join(records.select(F.col("dir_key").alias("key")), "key", "left_semi")


def ingest_files(spark: SparkSession, paths: list[str] | DataFrame, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The files (path, modificationTime, length) that were asked for and are not too old, and (path, detail) of those that can't be taken.

    paths is a list, or a table (path) of any size; tasks ask for their status.
    """
    asked = spark.createDataFrame([(p,) for p in paths], "path string") if isinstance(paths, list) else paths
    status = cut(directory.file_status(asked), "asked-files")
    found = status.where("kind = 'file'").select("path", F.col("modified").alias("modificationTime"), "length")
    if since is not None:
        found = found.where(F.col("modificationTime") >= _cutoff(since))
    why = F.when(F.col("kind") == "missing", "no such file").when(F.col("kind") == "directory", "is a directory").otherwise("cannot be reached")
    return found, status.where("kind <> 'file'").select("path", why.alias("detail"))


def _cutoff(since: str) -> Column:
    time = F.coalesce(F.try_to_timestamp(F.lit(since), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(F.lit(since), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.coalesce(time, F.raise_error(F.lit(f"not a time: {since}")).cast("timestamp"))


def recent_files(spark: SparkSession, path: str | list[str], since: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of files below path; those modified before `since` are left out, equal times stay."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    if since is None:
        return files
    return files.where(F.col("modificationTime") >= _cutoff(since))


def write_records(records: DataFrame, path: str) -> None:
    """A new snapshot of records as JSON lines; the former one stays until the caller drops it."""
    records.select(*RECORD_FIELDS).write.mode("errorifexists").json(path)


def upsert(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """The next snapshot: stored rows whose key isn't in changed, and changed."""
    return stored.join(changed.select("key"), "key", "left_anti").unionByName(changed)


def append_events(events: DataFrame, path: str) -> None:
    events.select(*EVENT_FIELDS).write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)
