"""Records that arrive as files, committed to a store batch by batch, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.schema import RECORD, RECORD_FIELDS
from vellum.sources import snapshots


def inbox_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """RECORD rows of JSON lines that come into a folder, with the time and the name of their file."""
    rows = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_a_batch).json(path)
    return rows.select(*RECORD_FIELDS, F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))


def newest_of(rows: DataFrame) -> DataFrame:
    """RECORD rows of rows with at and file, one a key: that of the latest file, of the last name among equal times, and of the largest text in one file; null keys go."""
    order = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("file"), F.desc(F.to_json(F.struct(*RECORD_FIELDS))))
    return rows.where("key is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*RECORD_FIELDS)


def committed(rows: DataFrame, root: str, checkpoint: str, name: str = "inbox") -> StreamingQuery:
    """Start a query that commits what inbox_stream() brings, until nothing is left.

    The store's manifest holds the number of the last batch of `name`, so a
    batch that is run again after a failure, on this checkpoint, changes
    nothing.  A batch counts over whatever others have committed before it.
    """

    def put(batch: DataFrame, number: int) -> None:
        while True:
            try:
                snapshots.commit(batch.sparkSession, root, newest_of(batch), batch=(name, number))
                return
            except snapshots.CommitConflict:  # another writer came between: this batch goes on top
                continue

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
