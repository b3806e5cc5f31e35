"""Resampling documents towards a target distribution by importance weights.

A document's features are its words and pairs of neighbouring words, hashed
into a fixed number of buckets.  The log ratio of a bucket's share in target
and raw texts is its gain; all gains stand in one small array, and a document's
weight is the mean gain of its features.  Weights with Gumbel noise are drawn
without replacement by taking the highest.

Ranks come from a radix sort that Spark carries out pass by pass, least
significant digit of the composite key first.  Rows lie in blocks of equal
size by their present place.  A pass counts digits inside each block, keeping
the order; prefix sums over (digit, block) turn the counts into offsets, an
offset and the place among equal digits of the block give each row its next
place, and one exchange moves narrow rows there.  After the last pass the place
is the final rank, with no single task or driver ever holding the order.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut, ship_package

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
DIGIT_BITS = 11
LARGEST_BLOCK = 1 << 20
LEAST_BLOCK = 1 << 12
STEP = 100_000
# ASCII letters in lower case and digits stay, other ASCII characters part words, bytes of other characters stay
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ROW = "doc_id long, n_words long, n_features long, weight long, score long"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def buckets_of(words: list[bytes], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all words and of all pairs of neighbours, repeats included, a bounded number of words at a time."""
    for at in range(0, len(words), STEP):
        part = words[max(0, at - 1) : at + STEP]
        one = list(map(zlib.crc32, part))
        two = map(zlib.crc32, [b" " + w for w in part[1:]], one)  # the checksum of a pair goes on from its first word's
        found = np.fromiter((*one, *two), np.int64, 2 * len(part) - 1) % buckets
        yield found[1:] if at else found  # the word before is there for its pair alone


def _counted(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for found in buckets_of(words_of(text), buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket in the column text of all rows; their number is fixed, so the driver may hold them."""
    ship_package(texts.sparkSession)
    rows = texts.select(F.col("text").cast("string")).mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in rows:
        total[r["bucket"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of a bucket's share in target and raw texts."""
    s, t = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the document's number; a null one is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weight_of(words: list[bytes], gain: np.ndarray) -> tuple[int, int]:
    """(features, floored mean gain) of a text; one without features weighs nothing."""
    n = max(0, 2 * len(words) - 1)
    return n, sum(int(gain[found].sum()) for found in buckets_of(words, len(gain))) // n if n else 0


def weights(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs (doc_id, text), in thousandths."""
    ship_package(docs.sparkSession)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight", "score")])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n, weight = weight_of(words, gain)
                out.append((doc_id, len(words), n, weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(weigh, _ROW)


def digit_of(values: np.ndarray, low: int, shift: int, bits: int, falls: bool) -> np.ndarray:
    """The digit of values - low at a place of the number; of its complement if the key falls."""
    apart = values.astype(np.int64).view(np.uint64) - np.array(low, np.int64).view(np.uint64)  # without a sign, also where the difference is no int64
    digit = (apart >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int32)
    return (1 << bits) - 1 - digit if falls else digit


def counting_sort(block: np.ndarray, place: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, among): rows by block and digit, those of one digit in the order of place, and how many of the same digit come before each."""
    order = np.lexsort((place, block))
    order = order[np.lexsort((digit[order], block[order]))]  # stable
    b, d = block[order], digit[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    return order, np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))


def _counting(names: list[str], key: str, low: int, shift: int, bits: int, falls: bool):
    """One pass inside the blocks of a partition."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            digit = digit_of(rows[key].to_numpy(), low, shift, bits, falls)
            order, among = counting_sort(rows["_block"].to_numpy(), rows["_place"].to_numpy(), digit)
            out = rows.select([*names, "_block"]).take(pa.array(order))
            out = out.append_column("_digit", pa.array(digit[order])).append_column("_among", pa.array(among))
            yield from out.combine_chunks().to_batches(50_000)

    return sort


def radix_sorted(rows: DataFrame, keys: list[tuple[str, bool]], bits: int = DIGIT_BITS, largest: int = LARGEST_BLOCK) -> DataFrame:
    """rows with place: 0, 1, 2... by keys, pairs of a long column and whether it falls, the most significant first.

    Nulls are not allowed in keys.  Rows equal in all keys have places next to
    each other in no given order.  Only digits in which the rows differ get a
    pass.  A block has `largest` rows at most, however many rows there are.
    """
    ship_package(rows.sparkSession)
    names, split = rows.columns, F.call_function("shiftright", F.col("_at"), F.lit(33))
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()), "radix-rows")
    bounds = rows.agg(F.count("*").alias("n"), *(f(k).alias(f"{f.__name__}_{k}") for k, _ in keys for f in (F.min, F.max))).first()
    total = bounds["n"]
    if not total:
        return rows.select(*names, F.lit(0).cast("long").alias("place"))
    blocks = max(-(-total // largest), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_BLOCK)))
    size = -(-total // blocks)
    # first places: the rows of each writing task in its order, the tasks in turn
    counts = rows.groupBy(split.alias("_block")).agg(F.count("*").alias("_n")).select(F.lit(0).alias("_digit"), "_block", "_n")
    first = rows.withColumn("_block", split).join(_prefix_sums(counts).drop("_digit"), "_block")
    placed = first.select(*names, (F.col("_offset") + F.col("_at") - F.call_function("shiftleft", F.col("_block"), F.lit(33))).alias("_place"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_at").schema.fields)
    for key, falls in reversed(keys):
        low, high = bounds[f"min_{key}"], bounds[f"max_{key}"]
        for shift in range(0, (high - low).bit_length(), bits):
            dealt = placed.withColumn("_block", F.floor(F.col("_place") / size).cast("int")).repartitionById(blocks, "_block")
            counted = cut(dealt.mapInArrow(_counting(names, key, low, shift, bits, falls), f"{types}, _block int, _digit int, _among long"), "radix-pass")
            offsets = _prefix_sums(counted.groupBy("_digit", "_block").agg(F.count("*").alias("_n")))
            placed = counted.join(offsets, ["_digit", "_block"]).select(*names, (F.col("_offset") + F.col("_among")).alias("_place"))
    return placed.withColumnRenamed("_place", "place")


def _prefix_sums(counts: DataFrame) -> DataFrame:
    """(_digit, _block, _offset): the sum of _n over smaller digits, and over smaller blocks of the same digit.

    Digits are few, so their totals are summed up in one small table; blocks
    are summed within their digit.
    """
    counts = cut(counts.select("_digit", "_block", "_n"), "radix-counts")
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    digits = counts.groupBy("_digit").agg(F.sum("_n").alias("_all")).select("_digit", before.alias("_base"))
    own = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
    return counts.withColumn("_own", own).join(F.broadcast(digits), "_digit").select("_digit", "_block", (F.col("_base") + F.col("_own")).alias("_offset"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text) by its likeness to target (text).

    rank counts the drawn documents from 1, the highest score first and the
    smaller doc_id of equal scores; it is null for those that are not drawn.  Of
    rows with least_words words or more, percent in a hundred are drawn, rounded
    down.  A null text is empty.  A null doc_id has the noise of an empty number
    and comes last among equal scores; repeated rows are rows of their own with
    ranks next to each other.  Without target texts all gains are those of
    smoothing alone; an empty docs gives an empty result.
    """
    rated = cut(weights(docs, gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)), seed), "resample-weights")
    able = rated.where(F.col("n_words") >= least_words).withColumns({"_none": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce("doc_id", F.lit(0))})
    ranked = radix_sorted(able, [("score", True), ("_none", False), ("_id", False), ("n_features", False)])
    drawn = percent * able.count() // 100
    kept = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    return ranked.select(*kept, rank).unionByName(rated.where(F.col("n_words") < least_words).select(*kept, F.lit(None).cast("long").alias("rank")))


def op11_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)
