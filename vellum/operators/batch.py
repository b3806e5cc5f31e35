"""Repeats inside a batch, whose order decides what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import cut


def first_holders(batch: DataFrame) -> DataFrame:
    """(ord, first) for rows of batch (ord, asks, holds) that repeat a row created before them; first is the least such ord.

    Rows are taken by rising ord, which is unique.  A row is created unless an
    earlier created row holds an identifier that it asks for; then its own holds
    count for those after it.  A row with no holds creates nothing.  Null arrays
    are empty.

    This is a fixpoint over the graph of identifiers: in each round a row is
    settled as soon as no unsettled earlier row holds what it asks for, so rounds
    are as many as the longest chain of rows that hang on each other, and only
    rows in such chains are looked at again.  Rows meet by identifier through
    least ords, never in pairs.
    """
    ids = lambda c: F.filter(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), lambda x: x.isNotNull())
    todo = cut(batch.select("ord", ids("asks").alias("asks"), ids("holds").alias("holds")), "batch")
    asked = todo.select("ord", F.explode("asks").alias("id"))
    none = F.lit(None).cast(todo.schema["ord"].dataType)
    made = todo.select(F.explode("holds").alias("id"), "ord").where("false")
    while not todo.isEmpty():
        marks = todo.select(F.explode("holds").alias("id"), F.col("ord").alias("waits"), none.alias("made")).unionByName(made.select("id", none.alias("waits"), F.col("ord").alias("made")))
        marks = marks.groupBy("id").agg(F.min("waits").alias("waits"), F.min("made").alias("made"))
        met = todo.select("ord", F.explode("asks").alias("id")).join(marks, "id")
        met = met.groupBy("ord").agg(F.bool_or(F.coalesce(F.col("made") < F.col("ord"), F.lit(False))).alias("repeats"), F.bool_or(F.coalesce(F.col("waits") < F.col("ord"), F.lit(False))).alias("waits"))
        judged = cut(todo.join(met, "ord", "left"), "batch-round")
        repeats, waits = F.coalesce("repeats", F.lit(False)), F.coalesce("waits", F.lit(False))
        fresh = judged.where(~repeats & ~waits).select(F.explode("holds").alias("id"), "ord")
        made = cut(made.unionByName(fresh).groupBy("id").agg(F.min("ord").alias("ord")), "batch-made")
        todo = judged.where(~repeats & waits).select("ord", "asks", "holds")
    held = made.select("id", F.col("ord").alias("first"))
    return asked.join(held, "id").where(F.col("first") < F.col("ord")).groupBy("ord").agg(F.min("first").alias("first"))


def identifiers(doi, arxiv_id):
    """An array of a DOI in small letters and an arXiv id, each with its kind; empty ones are left out."""
    given = lambda kind, c: F.concat(F.lit(kind), F.nullif(c, F.lit("")))
    return F.filter(F.array(given("doi:", F.lower(doi)), given("arxiv:", arxiv_id)), lambda x: x.isNotNull())
