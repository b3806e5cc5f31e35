"""Posting lists of the search index: one row for a gram and a batch of records, complete for every field."""

from vellum.operators import search_index
from vellum.sources import snapshots

DDL = "key string, doi string, arxiv string, author string, title string, year string, venue string, abstract string"


def test_a_row_holds_all_keys_of_a_gram(spark, tmp_path):
    root, said = str(tmp_path / "i"), ["same words", "", "ab", "abc", "\U0001f642\U0001f642 abab", "same again"]
    rows = [(f"k{i}", None, None, None, said[i % 6], "1999", None, "" if i % 5 else said[i % 6] + "xyz") for i in range(60)]
    search_index.update(spark, root, spark.createDataFrame(rows, DDL).coalesce(1))
    part = snapshots.snapshot(spark, root).parts[0][1]
    lists = spark.read.parquet(f"{root}/{part}/postings").collect()
    of = {r["n"]: r["key"] for r in spark.createDataFrame(rows, DDL).select("key", search_index._key_number(search_index.F.col("key")).alias("n")).collect()}
    got = sorted((r["gram"], of[k]) for r in lists for k in r["keys"])
    texts = {r[0]: [t for t in r if t] for r in rows}
    theirs = sorted((search_index.gram_number(g), k) for k, ts in texts.items() for g in {t[i : i + 3] for t in ts for i in range(len(t) - 2)})
    assert got == theirs and len(lists) < len(got) / 2
