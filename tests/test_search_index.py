"""The search index against a scan of all records."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import search, search_index

DDL = "key string, doi string, arxiv string, author string, title string, year string, venue string, abstract string"
ROWS = [
    ("gross_1963", "10.1000/ABC", None, r"Gro{\\ss}, K.".replace("\\\\", "\\"), "A Test of Grams", "1963", "Journal", "about gross things"),
    ("mueller_2001", None, "2101.00001", "M\u00fcller, A.", "Another test", "2001", None, None),
    ("empty", None, None, None, None, None, None, None),
    ("long_1999", "", "math/0101001", "Doe, J. and Roe, R.", "x" * 5000 + " needle " + "y" * 50, "1999", "Grams", "\U0001f642 needles\nand lines"),
]
TERMS = [["gross"], ["Gro\u00df", "1963"], ["m\u00fcller"], ["MUELLER", "test"], ["test"], ["needle", "grams"], ["10.1000/abc"], ["math/01"], ["19"], ["a"], ["te", "test"], [], [""], ["no such thing"], ["1999"], ["199"], ["needles\nand"], ["xxxx needle"], ["\U0001f642 nee"]]


def same(spark, root, records, some):
    for terms in some:
        theirs = [(r["key"], r["score"]) for r in search.search(records, terms).select("key", "score").collect()]
        assert [tuple(r) for r in search_index.search(spark, root, terms).collect()] == theirs, terms


def test_equal_to_a_scan_through_changes(spark, tmp_path):
    root, records = str(tmp_path / "i"), spark.createDataFrame(ROWS, DDL)
    assert search_index.search(spark, root, ["gross"]).collect() == []
    assert search_index.update(spark, root, records) == 1
    same(spark, root, records, TERMS)
    assert len(search_index.search(spark, root, ["test"], 1).collect()) == 1
    changed = records.where("key in ('gross_1963', 'empty')").withColumns({"title": F.lit("M\u00fcller grams and needle"), "abstract": F.lit(None).cast("string"), "author": F.lit("Test")})
    assert search_index.update(spark, root, changed, spark.createDataFrame([("long_1999",), ("none",)], "key string")) == 2
    now = records.where("key = 'mueller_2001'").unionByName(changed)
    same(spark, root, now, TERMS[2:7])
    assert search_index.rebuild(spark, root, now) == 3
    same(spark, root, now, TERMS[4:6])


def test_only_buckets_of_postings_are_read(spark, tmp_path):
    root = str(tmp_path / "i")
    search_index.update(spark, root, spark.createDataFrame(ROWS, DDL))
    plan = search_index.candidates(spark, root, ["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "/fields" not in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan
    assert search_index.candidates(spark, root, ["ne", "x"]) is None


@pytest.mark.parametrize("terms", [["test"], ["grams", "needle"], ["none"]])
def test_best_k_fetches_texts_of_k_only(spark, terms):
    records = spark.createDataFrame(ROWS, DDL)
    whole = search.search(records, terms).collect()
    for k in (1, 2, 10):
        assert search.search(records, terms, k).collect() == whole[:k]
    plan = search.search(records, terms, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 1" in plan
