"""Cleaning a text collection for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, lines, near, packing, toxicity
from vellum.llm.keyed import unwrapped, wrapped
from vellum.session import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold by a model learned from the labelled training fold.

    Null and empty texts score low and stay; repeated rows share one fate; a
    column of docs may have any name.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(wrapped(docs, "text"), model, "toxicity").where(F.col("toxicity") < toxicity.THRESHOLD)
    return unwrapped(scored, docs.columns, text=F.col("text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that consists of them goes, and n_chars follows the text.

    Null and empty texts lose nothing and stay.  Of equal lines the one of the
    smallest doc_id and line number stays, and null doc_ids come last; repeated
    rows lose the same lines.
    """
    out = lines.dedup_lines(wrapped(docs, "text")).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") == 0, F.col("row")["n_chars"]).otherwise(F.length("text"))
    return unwrapped(out, docs.columns, text=F.col("text"), n_chars=n_chars)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of five-word similarity 0.8 or more; the others go.

    SimHash fingerprints within three bits propose first, MinHash bands what
    these don't reach, and exact shingle sets decide.
    Null and empty texts are one group; a null doc_id comes last, and of rows
    without a doc_id of their own one of each text stays.
    """
    return near.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps no benchmark item; null and empty texts overlap none, repeated rows share one fate."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents laid into training windows; a null text is empty, and each row is a document of its own."""
    return packing.pack_documents(docs, keep_memo=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
