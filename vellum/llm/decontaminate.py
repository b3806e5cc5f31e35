"""Benchmark decontamination with spaced seeds.

A mask looks at some of the tokens in a short span and ignores the others, so
a replaced token does no harm where the mask ignores it.  Masked hashes of the
benchmark meet masked hashes of the documents; around every hit the two token
sequences are laid over each other and the overlap is judged by equal tokens.
A benchmark of bounded size is looked up in the tasks that read the documents;
a larger one is joined with them by masked hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.keyed import join_some, own_keys, wrapped
from vellum.session import cut, ship_package

# The two long masks together hit every 13 tokens with 2 or fewer substitutions.
MASKS = ("11101011", "11001111")
SHORT_MASK = "1111"
WINDOW = 13
TOLERANT = 8
SIMILARITY = 0.8
BLOCK_TOKENS = 1_000_000
FILTER_BITS = 23
MATCHES = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_equal long, similarity double"
_MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_tokens", pa.int64()), ("n_equal", pa.int64()), ("similarity", pa.float64())])
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words; ASCII punctuation and white space separate words."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def masked(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every position where its span fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for i in (i for i, c in enumerate(mask) if c == "1"):
        h = (h ^ tokens[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def least_equal(n_item: int) -> tuple[int, int]:
    """Window length and equal tokens that an overlap with an item of n_item tokens needs; under TOLERANT tokens all must be equal."""
    need = min(WINDOW, n_item)
    return need, int(np.ceil(SIMILARITY * need - 1e-9)) if need == WINDOW else need - (need >= TOLERANT)


def best_run(equal: np.ndarray, need: int, least: int) -> tuple[int, int, int] | None:
    """Start, length and equal tokens of the run with most equal tokens, the first of several.

    A run is a longest stretch that is covered by windows of `need` tokens with
    `least` equal ones.
    """
    if len(equal) < need:
        return None
    total = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(total[need:] - total[:-need] >= least)
    if not len(good):
        return None
    cut_at = np.flatnonzero(np.diff(good) > need) + 1
    first, last = np.concatenate([[0], cut_at]), np.concatenate([cut_at, [len(good)]]) - 1
    a, b = good[first], good[last] + need
    i = int(np.argmax(total[b] - total[a]))
    return int(a[i]), int(b[i] - a[i]), int(total[b[i]] - total[a[i]])


def judge(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(document start, item start, tokens, equal ones) of the best run of an item laid over a document at `diagonal`."""
    first, last = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if last <= first:
        return None
    found = best_run(doc[diagonal + first : diagonal + last] == item[first:last], *least_equal(len(item)))
    return found and (diagonal + first + found[0], first + found[0], found[1], found[2])


def seeds_of_item(tokens: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(mask number, hashes) of an item; one of fewer tokens than the short mask has none and must be the whole document."""
    if len(tokens) >= WINDOW:
        return [(i, masked(tokens, m)) for i, m in enumerate(MASKS)]
    return [(len(MASKS), masked(tokens, SHORT_MASK))] if len(tokens) >= len(SHORT_MASK) else []


def whole_hash(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), len(tokens)) - (1 << 63)


def better(a: tuple, b: tuple | None) -> bool:
    """Of two overlaps (document start, item start, tokens, equal ones): more equal tokens, then the earlier one."""
    return b is None or (-a[3], a[0], a[1]) < (-b[3], b[0], b[1])


class SeedIndex:
    """Masked hashes of benchmark items, sorted, with a bit filter in front."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.tokens = [tokens_of(t) for _, t in items]
        self.short: dict[int, list[int]] = {}
        parts: dict[int, list] = {}
        for i, t in enumerate(self.tokens):
            for mask, h in seeds_of_item(t):
                parts.setdefault(mask, []).append((i, h))
            if 0 < len(t) < len(SHORT_MASK):
                self.short.setdefault(whole_hash(t), []).append(i)
        self.tables = []
        for mask, found in sorted(parts.items()):
            h = np.concatenate([x for _, x in found])
            item = np.repeat([i for i, _ in found], [len(x) for _, x in found])
            at = np.concatenate([np.arange(len(x)) for _, x in found])
            order = np.argsort(h, kind="stable")
            self.tables.append(((*MASKS, SHORT_MASK)[mask], h[order], item[order], at[order], bit_filter(h)))

    def candidates(self, tokens: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of every hit; the diagonal is the token of the document under the item's first."""
        out: set[tuple[int, int]] = set()
        for mask, hashes, item, at, bits in self.tables:
            h = masked(tokens, mask)
            where = passing(h, bits)
            if not len(where):
                continue
            low, high = np.searchsorted(hashes, h[where], "left"), np.searchsorted(hashes, h[where], "right")
            for p, a, b in zip(where[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                out.update(zip(item[a:b].tolist(), (p - at[a:b]).tolist(), strict=True))
        if 0 < len(tokens) < len(SHORT_MASK):
            out.update((i, 0) for i in self.short.get(whole_hash(tokens), ()) if len(self.tokens[i]) == len(tokens))
        return out


def bit_filter(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    top = h >> np.uint64(64 - FILTER_BITS)
    return np.flatnonzero(bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1)


def overlaps_of(index: SeedIndex, text: str | None) -> list[tuple]:
    """The best overlap of a text with each item, in the order of items."""
    tokens = tokens_of(text)
    best: dict[int, tuple] = {}
    for item, diagonal in sorted(index.candidates(tokens)):
        if (found := judge(tokens, index.tokens[item], diagonal)) and better(found, best.get(item)):
            best[item] = found
    return [(index.ids[i], d, s, n, e, e / n) for i, (d, s, n, e) in sorted(best.items())]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _index(benchmark: DataFrame, block_tokens: int):
    """A broadcast seed index of the benchmark if it has block_tokens tokens at most, else None."""
    items = _items(benchmark)
    if items.agg(F.coalesce(F.sum(F.floor(F.octet_length("text") / 2) + 1), F.lit(0))).first()[0] > block_tokens:  # no text has more tokens
        return None
    rows = items.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    return benchmark.sparkSession.sparkContext.broadcast(SeedIndex(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_SEED = pa.schema([("mask", pa.int32()), ("h", pa.int64()), ("item", pa.int64()), ("at", pa.int32())])
_HIT = pa.schema([("mask", pa.int32()), ("h", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("pos", pa.int32())])
_SLICE = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("item", pa.int64()), ("start", pa.int64()), ("tokens", pa.list_(pa.int64()))])
_RUN = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("item", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_tokens", pa.int64()), ("n_equal", pa.int64())])
WHOLE = len(MASKS) + 1


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = tokens_of(text)
            for mask, h in seeds_of_item(tokens):
                out += [(mask, x, item, p) for p, x in enumerate(h.view(np.int64).tolist())]
            if 0 < len(tokens) < len(SHORT_MASK):
                out.append((WHOLE, whole_hash(tokens), item, 0))
        if out:
            yield _batch(out, _SEED)


def _doc_seeds(shared):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = tokens_of(text)
                for i, mask in enumerate((*MASKS, SHORT_MASK)):
                    h = masked(tokens, mask)
                    where = passing(h, shared.value)
                    out += [(i, x, k, t, p) for p, x in zip(where.tolist(), h[where].view(np.int64).tolist(), strict=True)]
                if 0 < len(tokens) < len(SHORT_MASK):
                    out.append((WHOLE, whole_hash(tokens), k, t, 0))
                if len(out) > 50_000:
                    yield _batch(out, _HIT)
                    out = []
            if out:
                yield _batch(out, _HIT)

    return hits


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of a document that lie under an item, for each candidate."""
    for batch in batches:
        out, size = [], 0
        for k, t, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = tokens_of(text)
            for w in wanted:
                if len(SHORT_MASK) > w["n"] != len(tokens):
                    continue
                start = max(0, w["diagonal"])
                out.append((k, t, w["item"], w["diagonal"], tokens[start : max(start, w["diagonal"] + w["n"])].view(np.int64).tolist()))
                size += w["n"]
                if size > 200_000:
                    yield _batch(out, _SLICE)
                    out, size = [], 0
        if out:
            yield _batch(out, _SLICE)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for k, t, item, diagonal, tokens, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start = max(0, diagonal)
            if found := judge(np.array(tokens, np.int64).view(np.uint64), tokens_of(text), diagonal - start):
                out.append((k, t, item, found[0] + start, *found[1:]))
        if out:
            yield _batch(out, _RUN)


def _joined(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlaps (k, t, item_id, ...) of documents (k, t, text) with a benchmark of any size: seeds are joined by hash, overlaps judged on slices.

    Rows of equal k and t have one text; their hits are one from the join of
    seeds on, and their overlaps one at the end, so texts aren't shuffled to
    make them distinct.
    """
    spark = texts.sparkSession
    counted = F.pandas_udf(lambda s: s.map(lambda t: len(tokens_of(t))), "int")
    items = cut(_items(benchmark).select("item_id", "text", counted("text").alias("n"), F.monotonically_increasing_id().alias("item")), "benchmark-items")
    seeds = cut(items.select("item", "text").mapInArrow(_item_seeds, "mask int, h long, item long, at int"), "benchmark-seeds")
    words = seeds.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("b")).groupBy(F.shiftright("b", 3).cast("int").alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("b", F.lit(8)).cast("int"))).alias("bits"))
    table = words.toArrow()  # a byte for each of 2 ** (FILTER_BITS - 3) places at most, however large the benchmark
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    bits[table.column(0).to_numpy()] = table.column(1).to_numpy()
    hits = texts.mapInArrow(_doc_seeds(spark.sparkContext.broadcast(bits)), "mask int, h long, k long, t long, pos int")
    met = hits.join(seeds, ["mask", "h"]).select("k", "t", "item", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    met = met.join(items.select("item", "n"), "item")
    wanted = met.select("k", "t", F.struct("item", "diagonal", "n").alias("w")).groupBy("k", "t").agg(F.collect_list("w").alias("wanted"))
    cuts = join_some(texts, wanted, "k", "t").where("wanted is not null").select("k", "t", "text", "wanted").mapInArrow(_slices, "k long, t long, item long, start long, tokens array<long>")
    runs = cuts.join(items.select("item", F.col("text").alias("item_text")), "item").select("k", "t", "item", "start", "tokens", "item_text")
    runs = runs.mapInArrow(_judge, "k long, t long, item long, doc_start long, item_start long, n_tokens long, n_equal long")
    best = F.min_by(F.struct("doc_start", "item_start", "n_tokens", "n_equal"), F.struct(-F.col("n_equal"), "doc_start", "item_start"))
    return cut(runs.groupBy("k", "t", "item").agg(best.alias("b")).join(items.select("item", "item_id"), "item").select("k", "t", "item_id", "b.*"), "overlaps")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """MATCHES: one row for each document row and benchmark item that overlap, with their best run.

    A run is a longest stretch of tokens covered by windows of WINDOW tokens of
    which SIMILARITY or more are equal at equal places; the best one has most
    equal tokens.  An item of TOLERANT to WINDOW - 1 tokens must occur whole
    with one substitution at most, a shorter one without any, and one of fewer
    tokens than the short mask must be all that the document says.  Null and
    empty texts match nothing.  Each row of docs stands for itself, repeated ones
    too; other columns are ignored.  An empty table on either side gives no
    rows.  A benchmark over block_tokens tokens is joined, not broadcast.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = _index(benchmark, block_tokens)
    if shared is None:
        keyed = own_keys(rows)
        out = keyed.select("doc_id", "k", "t").join(_joined(keyed.select("k", "t", "text"), benchmark), ["k", "t"])
        return out.select("doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal", (F.col("n_equal") / F.col("n_tokens")).alias("similarity"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in overlaps_of(shared.value, t)]
            if found:
                yield _batch(found, _MATCHES)

    return rows.mapInArrow(match, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs, with all their columns, whose text overlaps no benchmark item; null texts stay."""
    ship_package(docs.sparkSession)
    shared = _index(benchmark, block_tokens)
    if shared is None:
        rows = own_keys(wrapped(docs))
        found = _joined(rows.select("k", "t", "text"), benchmark)
        kept = join_some(rows, found.select("k", "t", F.lit(True).alias("found")).distinct(), "k", "t").where("found is null")
        return kept.select("row.*")
    clean = F.pandas_udf(lambda s: s.map(lambda t: not overlaps_of(shared.value, t)).astype(bool), "boolean")
    return docs.where(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def op1_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_overlaps(docs, benchmark)
