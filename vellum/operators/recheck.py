"""A check of the whole store that looks again only at what has changed.

Problems lie in a table of their own, under manifests like those of the record
store, with a mark of what each entry was made of: its record, what its folder
holds and its conflicting copies.  Entries whose mark differs are checked anew,
entries that are gone are forgotten, and all other problems stay as they are.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators.check import check_all, sync_conflicts
from vellum.sources import snapshots

_STATE = "key string, mark string, removed boolean, problems array<struct<ord:int,rule:string,severity:string,msg:string>>"


def marks(records: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, mark) of every entry; one pass over each table, with sums that don't depend on the order of rows."""
    record = records.select(F.col("dir_key").alias("key"), F.lit("record").alias("kind"), F.to_json(F.struct(*sorted(records.columns))).alias("text"))
    held = files.select("key", F.lit("file").alias("kind"), F.concat_ws("/", "is_dir", "name").alias("text"))
    copies = sync_conflicts(paths).select("key", F.lit("copy").alias("kind"), F.col("path").alias("text"))
    part = lambda seed: F.xxhash64("kind", "text", F.lit(seed))
    every = record.unionByName(held).unionByName(copies).select("key", part(1).alias("a"), F.pmod(part(2), F.lit(1 << 40)).alias("b"))
    return every.groupBy("key").agg(F.concat_ws(":", F.count("*"), F.bit_xor("a"), F.sum("b")).alias("mark"))


def _state(spark: SparkSession, root: str, at: snapshots.Snapshot) -> DataFrame:
    parts = [spark.read.schema(_STATE).parquet(f"{root}/{p}").withColumn("_v", F.lit(v)) for v, p in at.parts]
    if not parts:
        return spark.createDataFrame([], _STATE)
    rows = reduce(DataFrame.unionByName, parts).withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_v"))))
    return rows.where("_r = 1 and not removed").drop("_r", "_v")


def stored_problems(spark: SparkSession, root: str) -> DataFrame:
    """(key, ord, rule, severity, msg) as of the last update."""
    return _state(spark, root, snapshots.snapshot(spark, root)).select("key", F.explode("problems").alias("p")).select("key", "p.*")


def update(spark: SparkSession, root: str, records: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """Bring the stored problems up to date; (key, removed) of the entries that were looked at again or forgotten.

    records, files and paths are those of check.check_all().  Afterwards
    stored_problems() equals a full check.  An update that another one has
    overtaken gets CommitConflict and has changed nothing.
    """
    at = snapshots.snapshot(spark, root)
    now, known = marks(records, files, paths), _state(spark, root, at).select("key", F.col("mark").alias("_known"))
    name = f"data/{uuid.uuid4().hex}"
    differ = now.join(known, "key", "full").where("mark is null or _known is null or mark <> _known").select("key", "mark")
    differ.write.parquet(f"{root}/{name}-keys")
    differ = spark.read.schema("key string, mark string").parquet(f"{root}/{name}-keys")
    again = differ.where("mark is not null").select("key")
    mine = records.join(again.withColumnRenamed("key", "dir_key"), "dir_key", "left_semi").select(*records.columns)
    own_paths = paths.withColumn("_key", F.substring_index("path", "/", 1)).join(again.withColumnRenamed("key", "_key"), "_key", "left_semi").select("path")
    found = check_all(mine, files.join(again, "key", "left_semi"), own_paths)
    found = found.groupBy("key").agg(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), "rule", "severity", "msg")).alias("problems"))  # those of one entry
    rows = differ.join(found, "key", "left").select("key", "mark", F.col("mark").isNull().alias("removed"), F.coalesce("problems", F.array().cast(_STATE.rsplit("problems ", 1)[1])).alias("problems"))
    rows.write.option("compression", "zstd").parquet(f"{root}/{name}")
    if not snapshots.publish(spark, root, snapshots.Snapshot(at.version + 1, (*at.parts, (at.version + 1, name)))):
        raise snapshots.CommitConflict(at.version + 1, [])
    return differ.select("key", F.col("mark").isNull().alias("removed"))
