"""The record store as folders, <root>/<key>/paper.json, as a data source of its own; and status and writing of files inside tasks.

Files are reached through pyarrow's file systems, in tasks: local and mounted
folders, and hdfs, s3 and gs where their libraries are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from vellum.session import ship_package

KEYS_A_TASK = 1000
DOCUMENT = "paper.json"
SCHEMA = "dir_key string, value string, files array<struct<name:string,is_dir:boolean>>, failure string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(root: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/") or "/")


class _Keys(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


class _Reader(DataSourceReader):
    def __init__(self, root: str, keys_a_task: int):
        self.root, self.keys_a_task = root, keys_a_task
        self.keys: set[str] | None = None
        self.starts: tuple[str, ...] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, lists and beginnings of dir_key choose folders; all else stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("dir_key",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = wanted if self.keys is None else self.keys & wanted
            elif isinstance(f, StringStartsWith) and f.attribute == ("dir_key",):
                self.starts += (f.value,)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Asked keys are not listed; else the root's folders are, by name only."""
        from pyarrow import fs

        if self.keys is None:
            system, top = opened(self.root)
            names = [i.base_name for i in system.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory]
        else:
            names = [k for k in self.keys if k and k not in (".", "..") and "/" not in k]
        names = sorted(n for n in names if all(n.startswith(s) for s in self.starts))
        return [_Keys(names[i : i + self.keys_a_task]) for i in range(0, len(names), self.keys_a_task)] or [_Keys([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, top = opened(self.root)
        for key in partition.value:
            try:
                entries = sorted((i.base_name, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(f"{top}/{key}")))
            except (FileNotFoundError, NotADirectoryError):
                continue
            except OSError as e:
                yield key, None, [], f"cannot list: {e.strerror or e}"
                continue
            value = failure = None
            if (DOCUMENT, False) in entries:
                try:
                    with system.open_input_stream(f"{top}/{key}/{DOCUMENT}") as f:
                        value = f.read().decode()
                except (OSError, UnicodeDecodeError) as e:
                    failure = f"cannot read: {type(e).__name__}"
            yield key, value, entries, failure


class RecordDirectories(DataSource):
    """One row a folder below the root: its name, its document, what it holds at its first level (empty folders too), and why it can't be read."""

    @classmethod
    def name(cls) -> str:
        return "record_directories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("keysPerTask", KEYS_A_TASK)))


def read_directories(spark: SparkSession, root: str, keys: list[str] | None = None, keys_a_task: int = KEYS_A_TASK) -> DataFrame:
    """SCHEMA rows of the folders below root, or of those named by keys, whatever characters they have; an absent one gives no row.

    Filters on dir_key reach the source, which then lists only what they ask for.
    """
    ship_package(spark)
    if spark.conf.get(PUSHDOWN, None) in (None, "false"):
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(RecordDirectories)
    rows = spark.read.format("record_directories").option("keysPerTask", keys_a_task).load(root)
    return rows if keys is None else rows.where(F.col("dir_key").isin(sorted(set(keys))))


def directory_files(rows: DataFrame) -> DataFrame:
    """(key, name, is_dir) of read_directories() rows that have a document."""
    return rows.where("value is not null").select(F.col("dir_key").alias("key"), F.explode("files").alias("f")).select("key", "f.*")


def file_status(paths: DataFrame) -> DataFrame:
    """(path, kind, length, modified) of paths (path), each once: kind is file, directory, missing or unreachable.  Asked inside tasks."""
    ship_package(paths.sparkSession)
    fields = [("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = {fs.FileType.File: "file", fs.FileType.Directory: "directory", fs.FileType.NotFound: "missing"}
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                try:
                    system, at = opened(p)
                    i = system.get_file_info(at)
                    out.append((p, kinds.get(i.type, "unreachable"), i.size, i.mtime))
                except (OSError, pa.ArrowException):
                    out.append((p, "unreachable", None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True) if out else [[]] * 4, fields, strict=True)], schema=pa.schema(fields))

    return paths.select("path").where("path is not null").distinct().mapInArrow(ask, "path string, kind string, length long, modified timestamp")


def write_directories(documents: DataFrame, root: str) -> int:
    """Write documents (dir_key, value) as <root>/<dir_key>/paper.json inside tasks; how many.

    Each file is written beside its place and then moved there, so readers see
    the former document or the whole new one, and a repeated task changes nothing.
    """
    ship_package(documents.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, top = opened(root)
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(f"{top}/{key}", recursive=True)
                draft = f"{top}/{key}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as f:
                    f.write(value.encode())
                system.move(draft, f"{top}/{key}/{DOCUMENT}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return documents.select("dir_key", "value").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def document(record: Column) -> Column:
    """A record (RECORD struct) as the JSON text of its document; null members are left out."""
    return F.to_json(record)
