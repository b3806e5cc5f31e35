"""Documents whose sets of word shingles are similar: SimHash groups, then MinHash bands propose, exact sets decide.

Equal texts collapse to one.  The fingerprints of the others are linked within
three bits by simhash.links(), and texts of connected fingerprints share a
bucket.  Three bits reach nearly equal texts only, so least hashes of a text's
shingles under ROWS * BANDS functions make BANDS more buckets; two texts of
similarity s share one of these with probability 1 - (1 - s ** ROWS) ** BANDS,
0.999997 at 0.8.  Each text is first verified against the least text of its
SimHash group, then, if it is not connected with the leaders of all its
buckets, against one leader after another, then against all others.  Buckets whose texts are then not all connected are
dealt to units of work, chunk against chunk, where texts that are not connected
yet are compared in the first band they share; a unit gives the links that join
parts, never its pairs.  So a large group of near copies costs a comparison or
two a text and no pair that a band proposes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.keyed import join_some, own_keys, wrapped
from vellum.llm.rolling import Spans, mix
from vellum.llm.simhash import fingerprint, links
from vellum.session import cut, ship_package

SHINGLE = 5
BANDS = 24
ROWS = 4
SALTS = 64
TURNS = 3
CHUNK = 512
_SIGNED = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
_FACTORS, _SHIFTS = np.random.default_rng(77).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal(text: str | None) -> bytes:
    """Lower-cased (A-Z) words with single spaces."""
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def shingle_set(data: bytes, size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The distinct shingles of normal() text; all words if there are fewer than `size`."""
    words = data.split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a: set, b: set, least: tuple[int, int]) -> bool:
    """Whether the Jaccard similarity is at least least[0] / least[1]; two empty sets are alike."""
    both = len(a & b)
    return both * least[1] >= (len(a) + len(b) - both) * least[0]


def shingle_hashes(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of normal() text, which isn't empty, in order."""
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    end = end[size - 1 :] if len(end) >= size else end[-1:]
    return np.unique(Spans(raw).hash(begin[: len(end)], end))


def signature(data: bytes, size: int = SHINGLE, step: int = 2048) -> tuple[int, list[int]]:
    """Number of distinct shingles, and the band keys."""
    if not data:
        return 0, []
    h = shingle_hashes(data, size)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), step):
        least = np.minimum(least, (h[at : at + step] * _FACTORS + _SHIFTS).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return len(h), key.view(np.int64).tolist()


def _sign(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = normal(text)
                n, bands = signature(data, size)
                fp = fingerprint(text, size)
                out.append((k, t, xxhash.xxh3_64_intdigest(data) - (1 << 63), n, fp - (fp >> 63 << 64), bands))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SIGNED, strict=True)], schema=_SIGNED)

    return sign


def _verify(size: int, least: tuple[int, int]):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, set()
        for batch in batches:
            out = []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != now:
                    now, held = u, shingle_set(normal(a), size)
                if alike(held, shingle_set(normal(b), size), least):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], schema=schema)

    return verify


def _linked(pairs: DataFrame, texts: DataFrame, size: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose texts (x, text) are alike; a u of many pairs is dealt to several tasks."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    lead = dealt.select("u", "salt").distinct().join(texts.select(F.col("x").alias("u"), F.col("text").alias("a")), "u")
    joined = dealt.join(texts.select(F.col("x").alias("v"), F.col("text").alias("b")), "v").join(lead, ["u", "salt"])
    return cut(joined.select("u", "v", "a", "b").mapInArrow(_verify(size, least), "u long, v long"), "near-links")


def unit_links(band: int, left: list[tuple], right: list[tuple], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (u, v) that join parts, between rows (x, part, shingle hashes, keys of all buckets) of left and right, or of left alone.

    Only pairs whose first common band this is are compared: the others are
    met elsewhere, or connected.
    """
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while (b := root.get(a, a)) != a:
            root[a] = root.get(b, b)
            a = b
        return a

    others = right or left
    sizes, parts, keys = np.array([len(r[2]) for r in others]), np.array([r[1] for r in others]), np.array([r[3] for r in others])
    out = []
    for i, (x, part, h, own) in enumerate(left):
        equal = keys == np.array(own)
        meet = equal.any(1) & (keys[np.arange(len(keys)), equal.argmax(1)] == band) & (parts != part)
        meet &= (np.minimum(sizes, len(h)) + 1) * least[1] >= np.maximum(sizes, len(h)) * least[0]
        if not right:
            meet[: i + 1] = False
        for j in np.flatnonzero(meet).tolist():
            a, b = find(part), find(others[j][1])
            if a != b:
                both = len(np.intersect1d(h, others[j][2], assume_unique=True))
                if both * least[1] >= (len(h) + len(others[j][2]) - both) * least[0]:
                    root[max(a, b)] = min(a, b)
                    out.append((x, others[j][0]))
    return out


def _units(size: int, least: tuple[int, int]):
    """Links of units; rows come sorted by band and unit, the left ones first, and one unit is held."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None and (found := unit_links(key[0], *sides, least)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

        for batch in batches:
            for band, pair, right, x, part, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (band, pair):
                    yield from done()
                    key, sides = (band, pair), ([], [])
                data = normal(text)
                sides[right].append((x, part, shingle_hashes(data, size), [group, *signature(data, size)[1]]))
        yield from done()

    return compare


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are not connected yet."""
    for c in ("u", "v"):
        pairs = pairs.join(parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), c, "left").withColumn(f"{c}_part", F.coalesce(f"{c}_part", c))
    return pairs.where("u_part <> v_part").select("u", "v")


def simhash_groups(fps: DataFrame) -> DataFrame:
    """(fp, group) of the distinct fingerprints (fp) that others within three bits connect; the others have no row."""
    return components(links(fps)).select(F.col("node").alias("fp"), F.col("component").alias("group"))


def near_copies(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """keyed_copies() of docs (doc_id, text)."""
    return keyed_copies(own_keys(docs.select("doc_id", F.col("text").cast("string").alias("text"))), size, least)


def keyed_copies(keyed: DataFrame, size: int = SHINGLE, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """(k, t, first_k, first_t) of documents of own_keys() that are not the first of their group.

    A group is what pairs of similarity least[0] / least[1] or more connect,
    directly or in steps.  Null and empty texts are one group.
    """
    ship_package(keyed.sparkSession)
    rows = keyed.select("k", "t", "text")
    signed = cut(rows.mapInArrow(_sign(size), "k long, t long, x long, n long, fp long, bands array<long>"), "near-signed")
    grouped = simhash_groups(signed.where("n > 0").select("fp").distinct())
    distinct = signed.groupBy("x").agg(F.min(F.struct("k", "t")).alias("me"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    distinct = distinct.join(grouped, "fp", "left").withColumn("group", F.xxhash64(F.coalesce("group", "fp"), F.lit(13)))
    buckets = F.when(F.col("n") > 0, F.concat(F.array("group"), "bands"))
    dealt = cut(distinct.select("x", "me", "n", "group", F.posexplode_outer(buckets).alias("at", "band")), "near-bands")
    leads = dealt.where("band is not null").groupBy("band").agg(F.min("x").alias("u"), F.max("x").alias("_last")).where("u <> _last").select("band", "u")
    met = cut(dealt.join(leads, "band"), "near-met")
    some = met.groupBy("x").agg(F.first("me").alias("me"), F.first("group").alias("group")).select("me.k", "me.t", "x", "group")
    texts = cut(join_some(rows, some, "k", "t").where("x is not null").dropDuplicates(["x"]).select("x", "group", "text"), "near-texts")
    led = met.where("u <> x").select("u", F.col("x").alias("v")).distinct()
    tried = cut(met.where("at = 0 and u <> x").select("u", F.col("x").alias("v")), "near-tried")
    found = _linked(tried, texts, size, least)
    parts = components(found)
    for turn in range(TURNS):
        left = _apart(led, parts).join(tried, ["u", "v"], "left_anti")
        pairs = left if turn == TURNS - 1 else left.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
        pairs = cut(pairs, "near-tried")
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs)
        found = found.unionByName(_linked(pairs, texts, size, least))
        parts = components(found)
    met = met.join(parts.withColumnRenamed("node", "x"), "x", "left").select("band", "x", "n", F.coalesce("component", "x").alias("part"))
    sizes = met.groupBy("band").agg(F.min("part").alias("_a"), F.max("part").alias("_b"), F.count("*").alias("_m")).where("_a <> _b").select("band", F.ceil(F.col("_m") / CHUNK).cast("int").alias("chunks"))
    open_ = cut(met.join(sizes, "band").select("band", "x", "part", "chunks"), "near-open")
    if not open_.isEmpty():
        own = F.pmod(F.xxhash64("x", F.lit(5)), F.col("chunks")).cast("int")
        dealt = open_.join(texts, "x").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        pair = F.least("own", "other") * F.col("chunks").cast("long") + F.greatest("own", "other")
        units = dealt.select("band", pair.alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("right"), "x", "part", "group", "text")
        more = units.repartition("band", "pair").sortWithinPartitions("band", "pair", "right").mapInArrow(_units(size, least), "u long, v long")
        parts = components(found.unionByName(cut(more, "near-more")))
    named = signed.select("k", "t", "x").join(parts.withColumnRenamed("node", "x"), "x", "left").withColumn("part", F.coalesce("component", "x"))
    first = named.groupBy("part").agg(F.min(F.struct("k", "t")).alias("first"), F.max(F.struct("k", "t")).alias("_last")).where("first <> _last").select("part", "first")
    gone = named.join(first, "part").where(F.struct("k", "t") > F.col("first"))
    return cut(gone.select("k", "t", F.col("first.k").alias("first_k"), F.col("first.t").alias("first_t")).distinct(), "near-copies")


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs without those of near_copies(); of equal rows, with a null doc_id or a shared one, one stays."""
    keyed = own_keys(wrapped(docs))
    gone = keyed_copies(keyed, size, least).select("k", "t", F.lit(True).alias("gone"))
    kept = join_some(keyed, gone, "k", "t").where("gone is null").select("row", "k", "t")
    out = kept.where("t = 0").unionByName(kept.where("t <> 0").dropDuplicates(["k", "t"]))
    return out.select("row.*")
