"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.schema import EVENT


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def outcomes(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and mean duration by window, command and outcome; rows later than `late` are left out of closed windows."""
    timed = events.withColumn("at", F.to_timestamp("when", "yyyy-MM-dd'T'HH:mm:ss")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "command", "outcome").agg(F.count("*").alias("events"), F.avg("duration_ms").alias("mean_ms"))


def last_outcomes(events: DataFrame) -> DataFrame:
    """(ref, last, command, outcome, events) of each reference over all its events: state by key, whatever order they arrive in.

    Of events at the same time the larger command and outcome counts; a null
    reference is one of its own.
    """
    said = F.struct("when", "command", "outcome")
    return events.groupBy("ref").agg(F.max(said).alias("x"), F.count("*").alias("events")).select("ref", F.col("x.when").alias("last"), "x.command", "x.outcome", "events")
