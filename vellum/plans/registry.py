"""Where queries over the supplied tables and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rows_of(spark: SparkSession, sf_dir: str, select: str, *tables: str) -> DataFrame:
    """A select over supplied tables, in SQL that Spark and DuckDB both read."""
    return spark.sql(
        "with " + ", ".join(f"{t} as (select * from {{{t}}})" for t in tables) + " " + select.replace("{", "{{").replace("}", "}}"),
        **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables},
    )
