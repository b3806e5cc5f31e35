"""An index for scored search: posting lists of grams in buckets, and the folded fields beside them.

A row of postings has a gram, as a number, and the keys of a batch of records
that hold it, as 32 bits each.  Every term of three characters or more that a field holds is there with all its
grams.  A search reads the postings of a few grams of each term, intersects
them, fetches the folded fields of the candidates, and scores those as a scan
of all records would, so the result is the same.  Parts are added for changed
records only, under manifests like those of the record store; postings of
former texts only make candidates that don't score.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import tex
from vellum.operators.search import WEIGHTS, folded_fields, score_of
from vellum.session import ship_package
from vellum.sources import snapshots

GRAM = 3
BUCKETS = 64
KEY_BUCKETS = 256
GRAMS_A_TERM = 4
_FIELDS = "key string, fields struct<" + ",".join(f"{n}:string" for n in WEIGHTS) + ">, removed boolean, key_bucket int"
_POSTINGS = "gram bigint, keys array<int>, bucket int"


def gram_number(gram: str) -> int:
    """A gram as one number: 21 bits for each of its characters."""
    number = 0
    for c in gram:
        number = number << 21 | ord(c)
    return number


def _posting_lists(batches):
    """Batches of (gram, keys) for those of (k, fields): the distinct grams of all fields, and for each those rows of a batch that hold it."""
    import numpy as np
    import pyarrow as pa

    end = np.array([(1 << 21) - 1], dtype=np.uint32)  # no character has this number
    for batch in batches:
        keys, held = batch.column("k").to_numpy(zero_copy_only=False), []
        for fields in batch.column("fields").to_pylist():
            text = np.concatenate([x for f in fields if len(f) >= GRAM for x in (np.frombuffer(f.encode("utf-32-le"), dtype=np.uint32), end)] or [end]).astype(np.int64)
            whole = np.ones(max(len(text) - GRAM + 1, 0), dtype=bool)
            numbers = np.zeros(len(whole), dtype=np.int64)
            for i in range(GRAM):
                part = text[i : i + len(whole)]
                numbers = numbers << 21 | part
                whole &= part != end[0]
            held.append(np.unique(numbers[whole]))
        every = np.concatenate(held) if held else np.zeros(0, dtype=np.int64)
        order = np.argsort(every, kind="stable")
        every, of = every[order], np.repeat(keys, [len(h) for h in held])[order]
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(every)], pa.int32()), pa.array(of, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(every[starts], pa.int64()), lists], names=["gram", "keys"])


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(3)), F.lit(n)).cast("int")


def _key_number(key: Column) -> Column:
    """32 bits for a key; its bucket is told by them too."""
    return F.call_function("shiftright", F.call_function("shiftleft", F.xxhash64(key, F.lit(3)), F.lit(32)), F.lit(32)).cast("int")


def update(spark: SparkSession, root: str, changed: DataFrame, removed: DataFrame | None = None) -> int:
    """Index records (the columns of WEIGHTS, key once each), in place of what the index has of their keys, and forget keys (key); the index's new version.

    Only `changed` is read.  Of two updates at a time the one that ends last
    counts for the keys that both have.
    """
    ship_package(spark)
    name = f"data/{uuid.uuid4().hex}"
    none = F.lit(None)
    rows = changed.select("key", folded_fields().alias("fields"), F.lit(False).alias("removed"))
    if removed is not None:
        rows = rows.unionByName(removed.select("key", none.cast(rows.schema["fields"].dataType).alias("fields"), F.lit(True).alias("removed")))
    rows = rows.withColumn("key_bucket", _bucket(F.col("key"), KEY_BUCKETS))
    rows.hint("rebalance", "key_bucket").sortWithinPartitions("key_bucket", "key").write.partitionBy("key_bucket").option("compression", "zstd").parquet(f"{root}/{name}/fields")
    folded = _fields(spark, root, name).where("not removed")
    texts = folded.select(_key_number(F.col("key")).alias("k"), F.array(*(F.col("fields")[n] for n in WEIGHTS)).alias("fields"))
    postings = texts.mapInArrow(_posting_lists, "gram bigint, keys array<int>").withColumn("bucket", _bucket(F.col("gram"), BUCKETS))
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/{name}/postings")
    while True:
        at = snapshots.snapshot(spark, root)
        made = snapshots.Snapshot(at.version + 1, (*at.parts, (at.version + 1, name)))
        if snapshots.publish(spark, root, made):
            return made.version


def rebuild(spark: SparkSession, root: str, records: DataFrame) -> int:
    """A new index of all records in place of the parts so far."""
    own = f"{root}/rebuilt-{uuid.uuid4().hex}"
    update(spark, own, records)
    part = f"{own.removeprefix(root + '/')}/{snapshots.snapshot(spark, own).parts[0][1]}"
    at = snapshots.snapshot(spark, root)
    if not snapshots.publish(spark, root, snapshots.Snapshot(at.version + 1, ((at.version + 1, part),))):
        raise snapshots.CommitConflict(at.version + 1, [])
    return at.version + 1


def _fields(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_FIELDS).parquet(f"{root}/{name}/fields")


def _latest_fields(spark: SparkSession, root: str, at: snapshots.Snapshot, buckets: list[int] | None) -> DataFrame:
    """(key, fields) as of the last part that has a key; only files of some key buckets, if those are given."""
    parts = [_fields(spark, root, p).withColumn("_v", F.lit(v)) for v, p in at.parts]
    if buckets is not None:
        parts = [p.where(F.col("key_bucket").isin(buckets)) for p in parts]
    rows = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_v")))).where("_r = 1")
    return rows.where("not removed").select("key", "key_bucket", "fields")


def candidates(spark: SparkSession, root: str, terms: list[str], at: snapshots.Snapshot | None = None) -> DataFrame | None:
    """(number) of the keys of records that may hold all terms, by their postings; None if no term is long enough to tell.

    Of a term's grams the rarest few are intersected; how many records a gram
    has is counted in the postings themselves, one row a gram and part.  Keys that
    share a number come together.
    """
    at = at or snapshots.snapshot(spark, root)
    spelled = [{s for s in (t.lower(), f) if s} for t, f in zip(terms, _folded(spark, terms), strict=True)]
    wanted = [[sorted({gram_number(s[i : i + GRAM]) for i in range(len(s) - GRAM + 1)}) for s in forms] for forms in spelled if forms and all(len(s) >= GRAM for s in forms)]
    if not wanted or not at.parts:
        return None
    every = sorted({g for forms in wanted for f in forms for g in f})
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in every], "gram bigint").select(_bucket(F.col("gram"), BUCKETS)).collect()]
    of = dict(zip(every, buckets, strict=True))

    def postings(chosen: list[int]) -> DataFrame:
        here = sorted({of[g] for g in chosen})
        parts = [spark.read.schema(_POSTINGS).parquet(f"{root}/{p}/postings").where(F.col("bucket").isin(here) & F.col("gram").isin(chosen)) for _, p in at.parts]
        return reduce(DataFrame.unionByName, parts).select("gram", "keys")

    n = {r["gram"]: r["n"] for r in postings(every).groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()}
    kept = [[sorted(f, key=lambda g: (n.get(g, 0), g))[:GRAMS_A_TERM] for f in forms] for forms in wanted]
    found = postings(sorted({g for forms in kept for f in forms for g in f})).select("gram", F.explode("keys").alias("number")).groupBy("number").agg(F.collect_set("gram").alias("g"))
    fits = reduce(Column.__and__, (reduce(Column.__or__, (F.size(F.array_except(F.array(*map(F.lit, f)), F.col("g"))) == 0 for f in forms)) for forms in kept))
    return found.where(fits).select("number")


def _folded(spark: SparkSession, terms: list[str]) -> list[str]:
    return list(spark.range(1).select(*(tex.fold(F.lit(t)) for t in terms)).first()) if terms else []


def search(spark: SparkSession, root: str, terms: list[str], k: int | None = None) -> DataFrame:
    """(key, score) of the indexed records that match every term, the best first; only the first k, if k is given.

    Equal to operators.search.search over the records.  Terms that are all
    shorter than a gram are looked for in all fields of the index.
    """
    at = snapshots.snapshot(spark, root)
    if not at.parts:
        return spark.createDataFrame([], "key string, score double")
    found = candidates(spark, root, terms, at)
    if found is None:
        rows = _latest_fields(spark, root, at, None)
    else:
        buckets = [r[0] for r in found.select(F.pmod("number", F.lit(KEY_BUCKETS))).distinct().collect()]  # KEY_BUCKETS numbers at most
        rows = _latest_fields(spark, root, at, buckets).join(found, _key_number(F.col("key")) == F.col("number"), "left_semi")
    scored = rows.select("key", F.explode(score_of(F.col("fields"), terms, _folded(spark, terms))).alias("score")).orderBy(F.desc("score"), "key")
    return scored if k is None else scored.limit(k)
