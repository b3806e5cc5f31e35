"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint's bits are the majority of its shingles' hash bits.  Equal
fingerprints collapse to one.  Bits are cut into r + 2 blocks; two fingerprints
within radius r differ in r of them at most and agree on the other two, so each
is dealt to the buckets of its pairs of blocks, whose keys have 24 bits or more.  Inside a bucket the fingerprints stand vertically, one bit
plane a row, 64 of them to a machine word; a probe is compared with all of
them at once by adding mismatch planes into carry-save counters, and words
whose every lane is beyond the radius are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import components, forest
from vellum.llm.keyed import maybe
from vellum.session import cut, ship_package

RADIUS = 3
SHINGLE = 5
CHUNK = 2048
LARGE_BUCKETS = 50_000
SEED = 42
_ZERO, _ALL = np.uint64(0), ~np.uint64(0)


def fingerprint(text: str | None, shingle: int, seed: int = SEED, step: int = 50_000) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles; repeats count; without words zero."""
    data = b" ".join((text or "").encode("utf-8", "replace").lower().split())
    if not data:
        return 0
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate([[0], ends + 1]).tolist()
    stops = np.concatenate([ends, [len(data)]]).tolist()
    stops = stops[shingle - 1 :] or stops[-1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(stops), step):
        h = b"".join([digest(data[a:b], seed) for a, b in zip(starts[at : at + step], stops[at : at + step])])
        bits = np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each input row, fp as a signed long."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(hashed, "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 fingerprints to a word."""
    lanes = -len(fps) % 64
    bits = np.unpackbits(np.pad(fps, (0, lanes)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(planes: np.ndarray, probe: np.ndarray, word: np.ndarray, radius: int, group: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(comparison, lane) where lane of planes[:, word] is within radius of probe.

    Each comparison sets one probe against the 64 lanes of one word.  Mismatch
    planes go lane by lane into carry-save counters (ones, twos, ... and a
    saturated plane); after each group of planes the comparisons in which every
    lane has passed the radius are dropped.
    """
    width = max(2, (radius + 1).bit_length())
    alive = np.arange(len(probe))
    counters, over = np.zeros((width, len(alive)), np.uint64), np.zeros(len(alive), np.uint64)
    for b in range(64):
        carry = planes[b, word] ^ (_ZERO - (probe >> np.uint64(b) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % group == group - 1:
            above, equal = over.copy(), np.full(len(alive), _ALL)
            for k in reversed(range(width)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            keep = above != _ALL
            alive, probe, word, counters, over, above = alive[keep], probe[keep], word[keep], counters[:, keep], over[keep], above[keep]
    lanes = np.unpackbits((~above).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    return alive[at], lane


def compare_units(unit: np.ndarray, right: np.ndarray, fp: np.ndarray, radius: int, step: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links inside units of work, given by rows grouped by unit.

    A unit with rows on its right sets its left rows against those; another one
    sets its rows against each other.
    """
    _, unit = np.unique(unit, return_inverse=True)
    two = np.bincount(unit, right) > 0
    is_lane, is_probe = (right == 1) | ~two[unit], right == 0
    lane_unit, lane_fp = unit[is_lane], fp[is_lane]
    sizes = np.bincount(lane_unit, minlength=len(two))
    words = -(-sizes // 64)
    base = np.cumsum(words) - words
    order = np.argsort(lane_unit, kind="stable")
    slot = base[lane_unit[order]] * 64 + np.arange(len(order)) - (np.cumsum(sizes) - sizes)[lane_unit[order]]
    slots, used = np.zeros(int(words.sum()) * 64, np.uint64), np.zeros(int(words.sum()) * 64, bool)
    slots[slot], used[slot] = lane_fp[order], True
    planes = planes_of(slots)
    probe_unit, probe = unit[is_probe], fp[is_probe]
    n = words[probe_unit]
    ends = np.cumsum(n)
    us, vs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = 0
    while first < len(probe):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + step, "right")))
        k = n[first:last]
        who = np.repeat(np.arange(first, last), k)
        word = np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k) + base[probe_unit[who]]
        at, lane = within(planes, probe[who], word, radius)
        spot = word[at] * 64 + lane
        at, spot = at[used[spot]], spot[used[spot]]
        us, vs = forest(np.concatenate([us, probe[who[at]].view(np.int64)]), np.concatenate([vs, slots[spot].view(np.int64)]))
        first = last
    return us, vs


def _compare(radius: int, held: int = 50_000):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            if len(rest) > held:
                whole = int(np.flatnonzero((rest[:, :2] != rest[-1, :2]).any(1))[-1:].sum()) + 1 if (rest[0, :2] != rest[-1, :2]).any() else 0
                if whole:
                    yield links_in(rest[:whole])
                    rest = rest[whole:]
        if len(rest):
            yield links_in(rest)

    def links_in(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
        u, v = compare_units(np.cumsum(starts), rows[:, 2], np.ascontiguousarray(rows[:, 3]).view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    return compare


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, spare: int = 2) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (fp) within radius of each other, directly or in steps.

    Fingerprints share a bucket if they agree on `spare` of radius + spare blocks.
    Buckets over `chunk` fingerprints are cut into chunks, and each pair of
    chunks is a unit of work of its own, so no task holds a whole hot bucket.
    The list of these buckets is broadcast; chunks grow where it would pass
    LARGE_BUCKETS rows.
    """
    blocks = radius + spare
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), spare)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)))
    dealt = distinct.select("fp", F.explode(keys).alias("bucket"))
    sizes = cut(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "fingerprint-buckets")
    chunk = max(chunk, sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // LARGE_BUCKETS + 1)
    large = sizes.where(F.col("n") > chunk).select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    work = maybe(dealt, sizes, "bucket").where("may").join(F.broadcast(large), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    work = work.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.least("own", "other") * F.col("chunks").cast("long") + F.greatest("own", "other")
    work = work.select("bucket", pair.alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("right"), "fp")
    return work.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text).

    component_id is the smallest doc_id that is reachable over fingerprints
    within the radius.  A null or empty text has fingerprint zero and links like
    any other.  Rows with a null doc_id get the component of their fingerprint's
    group, which is null if no member has a doc_id.  Repeated rows stay rows.
    """
    own = cut(fingerprints(docs, shingle), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(distinct.select("fp"), radius))
    classes = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, 3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
