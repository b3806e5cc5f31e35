"""Bases with more new rows than keys."""

from vellum.operators import records


def test_rows_beyond_the_free_keys_stay(spark):
    new = spark.createDataFrame([("doe_1999", i) for i in range(40)] + [("roe_2000", 0)], "base string, ord long")
    taken = spark.createDataFrame([("doe_1999",), ("doe_1999c",)], "key string")
    got = {(r["base"], r["ord"]): r["key"] for r in records.free_keys(new, taken).collect()}
    free = ["doe_1999" + c for c in "abdefghijklmnopqrstuvwxyz"]
    assert [got["doe_1999", i] for i in range(40)] == free + [None] * 15 and got["roe_2000", 0] == "roe_2000" and len(got) == 41
