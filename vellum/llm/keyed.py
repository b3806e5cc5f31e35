"""Joining documents with facts that concern only some of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.session import cut

SLOTS = 1 << 18
NO_ID = (1 << 63) - 1
HOT_KEYS = 2000
LEAST_HOT = 100


def wrapped(docs: DataFrame, *replaced: str) -> DataFrame:
    """(row, doc_id, text): the columns of docs but `replaced` as one struct, so that their names meet none of an operator's own."""
    kept = [c for c in docs.columns if c.lower() not in replaced]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))


def unwrapped(rows: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """The columns of docs again, from rows of wrapped(docs, ...); those of `made` have new values."""
    return rows.select(*((made[c.lower()] if c.lower() in made else F.col("row")[c]).alias(c) for c in columns))


def doc_key(column: str = "doc_id") -> Column:
    """doc_id as a join key and an order; a null one stands after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def own_keys(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, and row or nothing) with k and t, which together name a document and give its place in the order.

    k is doc_key().  t is zero where no other row has the doc_id; rows with a
    null or shared doc_id get a hash of their text, so that equal rows are one
    document and different texts are not.
    """
    shared = docs.where("doc_id is not null").groupBy(doc_key().alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k", F.lit(True).alias("shared"))
    shared = cut(shared, "shared-ids")
    rows = docs.withColumn("k", doc_key())
    rows = rows.withColumn("shared", F.lit(None).cast("boolean")) if shared.isEmpty() else join_some(rows, shared, "k")
    own = F.when(F.col("doc_id").isNull() | F.col("shared").isNotNull(), F.xxhash64(F.col("text"), F.lit(11))).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("t", own).drop("shared")


def _slot(*keys: Column) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(SLOTS * 64))
    return F.floor(h / 64).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def maybe(rows: DataFrame, facts: DataFrame, *key: str) -> DataFrame:
    """rows with may: false where facts certainly lacks their key.

    A bit set of at most SLOTS * 64 bits is broadcast.  Its size is fixed; when
    it fills up, more rows may, and joins that follow stay right.
    """
    slot, bit = _slot(*map(F.col, key))
    bits = facts.select(slot.alias("_slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.join(F.broadcast(bits), slot == F.col("_slot"), "left")
    return marked.withColumn("may", F.coalesce(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop("_slot", "_bits")


def join_some(docs: DataFrame, facts: DataFrame, *key: str) -> DataFrame:
    """docs left-joined with facts on the columns key, where facts has a row for few of the keys.

    Only rows that may have a fact are shuffled; the others pass with nulls.
    """
    marked = maybe(docs, facts, *key)
    rest = [f for f in facts.schema.fields if f.name not in key]
    some = marked.where("may").drop("may").join(facts.hint("merge"), list(key), "left")
    none = marked.where("not may").drop("may").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))
    return some.select(*none.columns).unionByName(none)


def join_hot(rows: DataFrame, facts: DataFrame, key: list[str], total: int, some: bool = False) -> DataFrame:
    """rows joined with facts (key, n and more; unique keys), where n is how many of the `total` rows hold the key.

    At most HOT_KEYS keys can hold total / HOT_KEYS rows or more each, so the
    facts of those go out by broadcast and their rows stay where they are; the
    others are shuffled.  With `some`, only those that may meet a fact are.
    """
    least = max(LEAST_HOT, total // HOT_KEYS + 1)
    hot, rest = facts.where(F.col("n") >= least).drop("n"), facts.where(F.col("n") < least).drop("n")
    near = rows.join(F.broadcast(hot), key)
    far = maybe(rows, rest, *key).where("may").drop("may") if some else rows
    return near.unionByName(far.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest.hint("merge"), key))
