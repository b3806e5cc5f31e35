"""A hit's line decodes its title and parses its authors once."""

from pyspark.sql import functions as F
from vellum.operators import search
from vellum.session import ship_package


def test_line_is_made_from_columns_of_a_generator(spark):
    ship_package(spark)
    text = {n: F.lit(None).cast("string") for n in ("venue", "doi", "arxiv", "abstract")}
    made = {"author": F.lit("Doe, J"), "year": F.lit("2001"), "title": F.concat(F.lit("A {\\'e}t"), F.repeat(F.lit("x"), 200)), "status": F.lit("clean"), "holdings": F.lit("none"), "versions": F.create_map(F.lit("a"), F.struct(F.lit(False).alias("deprecated"))), "score": F.lit(1.0)}
    lines = search.hit_report(spark.range(2).select(F.col("id").cast("string").alias("key")).withColumns(made | text)).select("key", "line")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 2
    got = sorted(r["line"] for r in lines.collect())
    assert len(got[0]) == search.LINE and got[0].startswith("0  Doe (2001)  A ét") and got[0].endswith("x…  [none]")
