"""Queries over stores that are written from the supplied tables: commits, folders, and an index that is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import recheck, search, search_index
from vellum.plans.papers import _FILES, PAPERS, paper_records
from vellum.plans.queries import _SQL_DOCS, _doc_records, _sql_fold, _sql_term
from vellum.plans.registry import SQL, registered, rows_of
from vellum.schema import RECORD_FIELDS
from vellum.session import cut, scratch_path, ship_package, table
from vellum.sources import directory, snapshots, store


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with all members of RECORD, and doc_id."""
    rows = paper_records(spark, sf_dir)
    return rows.select(*(F.col(n) if n in rows.columns else F.lit(None).cast("string" if n != "log" else "array<struct<when:string,action:string,detail:string>>").alias(n) for n in RECORD_FIELDS), "doc_id", "dir_key", "load_error")


@registered(
    f"""select key, case when doc_id % 7 = 0 then 'clean' when doc_id % 13 = 0 then 'late' else status end as status, kind as type, coalesce(doi, '') as doi from ({PAPERS}) where doc_id % 11 <> 0"""
)
def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after changes, removals, a late writer that is refused and one that is let through, read as committed."""
    root, rows = scratch_path(spark, "commits"), _whole(spark, sf_dir)
    some = lambda n, status: rows.where(f"doc_id % {n} = 0 and doc_id % 11 <> 0").withColumn("status", F.lit(status))
    base = snapshots.commit(spark, root, rows)
    snapshots.commit(spark, root, some(7, "clean"), rows.where("doc_id % 11 = 0").select("key"))
    try:
        snapshots.commit(spark, root, some(7, "lost"), base=base)
    except snapshots.CommitConflict:
        snapshots.commit(spark, root, some(13, "late").where("doc_id % 7 <> 0"), base=base)
    snapshots.compact(spark, root)
    return snapshots.read(spark, root).select("key", "status", "bibtex.type", F.coalesce("doi", F.lit("")).alias("doi"))


@registered(f"select dir_key, key, status, case when load_error is not null then load_error end as load_error from (select dir_key, load_error, case when load_error is null then key end as key, case when load_error is null then status end as status from ({PAPERS})) where dir_key like 'doc1%' or dir_key = 'dir19'")
def store_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as folders inside tasks, and those of some keys read back by the data source."""
    root, rows = scratch_path(spark, "folders"), _whole(spark, sf_dir)
    value = directory.document(F.struct(*RECORD_FIELDS))
    odd = F.concat(F.lit('{"colour":1,'), F.substring(value, F.lit(2), F.length(value)))
    directory.write_directories(rows.select("dir_key", F.when(F.col("load_error").isNull(), value).otherwise(odd).alias("value")), root)
    found = directory.read_directories(spark, root).where("dir_key like 'doc1%'").unionByName(directory.read_directories(spark, root, ["dir19", "none"]))
    loaded = store.load_records(found, strict=False)
    good = lambda n: F.when(F.col("load_error").isNull(), F.col(n)).alias(n)
    return loaded.select("dir_key", good("key"), good("status"), "load_error")


_CHANGED = f"select doc_id, key, case when doc_id % 3 = 0 then author || ' réeu src1' else author end as author, title, venue, case when doc_id % 5 = 0 then '' else abstract end as abstract from ({_SQL_DOCS.replace(_sql_fold('source'), 'source')}) where doc_id % 7 <> 0"
_FOUND = f"{_sql_term('reeu', 'réeu')} + {_sql_term('src1', 'src1')}"


@registered(f"with c as ({_CHANGED}), d as (select key, {_sql_fold('author')} as author, title, venue, abstract from c) select key, {_FOUND} as score from d where {_FOUND} is not null")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by an index of posting lists that was told of changed and removed records."""
    root, docs = scratch_path(spark, "index"), _doc_records(table(spark, sf_dir, "documents"))
    search_index.update(spark, root, docs)
    author = F.when(F.col("doc_id") % 3 == 0, F.concat("author", F.lit(" réeu src1"))).otherwise(F.col("author"))
    abstract = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("abstract"))
    changed = docs.where("(doc_id % 3 = 0 or doc_id % 5 = 0) and doc_id % 7 <> 0").withColumns({"author": author, "abstract": abstract})
    search_index.update(spark, root, changed, docs.where("doc_id % 7 = 0").select("key"))
    return search_index.search(spark, root, ["Réeu", "src1"])


@registered(f"with d as ({_SQL_DOCS}), s as (select key, {_FOUND} as score from d) select key, score, title from s join d using (key) where score is not null order by score desc, key limit 20")
def search_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best records for two terms, with their folded titles."""
    from vellum.functions import tex

    found = search.search(_doc_records(table(spark, sf_dir, "documents")), ["Réeu", "src1"], 20)
    return found.select("key", "score", tex.fold(F.col("title")).alias("title"))


@registered(SQL["check_store"])
def check_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems of a store after changes of many kinds, of which only the changed entries were checked anew."""
    ship_package(spark)
    root, papers = scratch_path(spark, "problems"), cut(paper_records(spark, sf_dir).drop("doc_id"), "papers")
    files = cut(rows_of(spark, sf_dir, f"{_FILES.replace('from p', f'from ({PAPERS}) p')}", "documents").select(F.col("dir_key").alias("key"), "name", "is_dir"), "files")
    n = lambda c, m: F.pmod(F.regexp_extract(c, "[0-9]+", 0).cast("int"), F.lit(m))
    before = papers.where(n("dir_key", 9) != 0).withColumn("status", F.when(n("dir_key", 4) == 0, "other").otherwise(F.col("status")))
    before = before.unionByName(papers.where(n("dir_key", 3) == 0).withColumn("dir_key", F.concat(F.lit("gone"), "dir_key")))
    held = files.where((n("key", 5) != 0) | (F.col("name") == "v1"))
    path = F.concat_ws("/", "key", "name").alias("path")
    recheck.update(spark, root, before, held, held.select(path))
    recheck.update(spark, root, papers, files, files.select(path))
    return recheck.stored_problems(spark, root).select("key", "msg")
