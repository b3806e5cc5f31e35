"""Repeated byte strings by column-wise suffix sorting of many documents.

Every window of `size` bytes has an anchor, its least-hashed gram, and the
windows that share an anchor make a segment.  Equal windows have equal grams at
equal places, so only segments with a common anchor hash can share a window,
and they line up at the anchor.  Segments of equal bytes repeat entirely; they
lie side by side in byte order and one of them goes on.  The different segments
of an anchor are sorted by inserting one symbol per segment each round, from
the last column to the first: a round reads the order, the common prefixes and
the transform symbols of the round before from a sequential file, deals the
suffixes out by their transform symbol, as in an extension step of the
collection's Burrows-Wheeler transform, takes the least prefix between new
neighbours, and writes the next file.  A window whose suffix shares `size`
bytes with a neighbour is repeated.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.keyed import join_hot, join_some, own_keys
from vellum.llm.rolling import Spans, minimisers, runs
from vellum.session import cut, ship_package

SIZE = 200
GRAM = 32
STEP_BYTES = 500_000
SORT_SEGMENTS = 8_000
SPLITS = 4
_PICKED = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("at", pa.int32()), ("known", pa.bool_())])
_PICKED_DDL = "k long, t long, start long, n int, anchor long, at int, known boolean"
_CUT = pa.schema([("anchor", pa.int64()), ("split", pa.bool_()), ("k", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("at", pa.int32()), ("known", pa.bool_()), ("segment", pa.binary())])
_FOUND = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])


def segments(docs: list[tuple[int, int, bytes, int]], size: int, gram: int) -> tuple[dict[str, np.ndarray], bytes]:
    """Segments of documents (k, number of the first byte, bytes, t): anchor, content hash, k, t, start, windows n, anchor's place, and place in the bytes that come with them."""
    docs = [d for d in docs if len(d[2]) >= size]
    if not docs:
        return {}, b""
    raw = np.frombuffer(b"".join(d[2] for d in docs), np.uint8)
    counts = np.array([len(d[2]) for d in docs])
    first = np.cumsum(counts) - counts
    one = Spans(raw, 0)
    begin = np.arange(len(raw) - gram + 1)
    value, at = minimisers(one.hash(begin, begin + gram), size - gram + 1)
    windows = np.concatenate([np.arange(a, a + n - size + 1) for a, n in zip(first, counts, strict=True)])
    owner = np.repeat(np.arange(len(docs)), counts - size + 1)
    start, length = runs(at[windows], owner)
    where = windows[start]
    end = where + length + size - 1
    ks, offsets, ts = (np.array([d[i] for d in docs], np.int64) for i in (0, 1, 3))
    o = owner[start]
    return {"anchor": value[where], "content": one.hash(where, end).view(np.int64), "k": ks[o], "t": ts[o], "start": offsets[o] + where - first[o], "n": length, "at": at[where] - where, "from": where, "to": end}, raw.tobytes()


def _segment(size: int, gram: int):
    def settle(docs: list[tuple[int, int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        """Every segment with its anchor; of segments with equal bytes all are known to repeat (anchor null), and one of them also goes on."""
        s, data = segments(docs, size, gram)
        if s:
            order = np.lexsort((s["start"], s["t"], s["k"], s["content"]))
            s = {c: v[order] for c, v in s.items()}
            first, n = runs(s["content"])
            twice, on = np.zeros(len(order), bool), np.ones(len(order), bool)
            for a, m in zip(first[n > 1].tolist(), n[n > 1].tolist(), strict=True):
                head = data[s["from"][a] : s["to"][a]]
                same = np.array([data[f:e] == head for f, e in zip(s["from"][a : a + m].tolist(), s["to"][a : a + m].tolist(), strict=True)])
                if same.sum() > 1:
                    twice[a : a + m] = same
                    on[a : a + m] = ~same
                    on[a] = True
            rows = np.concatenate([np.flatnonzero(twice), np.flatnonzero(on)])
            anchor = pa.array(s["anchor"][rows], mask=np.arange(len(rows)) < twice.sum())
            made = {"known": pa.array(twice[rows]), "anchor": anchor} | {f.name: pa.array(s[f.name][rows].astype(f.type.to_pandas_dtype())) for f in _PICKED if f.name not in ("known", "anchor")}
            yield pa.RecordBatch.from_arrays([made[c] for c in _PICKED.names], schema=_PICKED)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                for k, t, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = (text or "").encode("utf-8", "replace")
                    for a in range(0, max(1, len(data) - size + 1), STEP_BYTES):
                        docs.append((k, a, data[a : a + STEP_BYTES + size - 1], t))
                        held += len(docs[-1][2])
                        if held >= STEP_BYTES // 2:
                            yield from settle(docs)
                            docs, held = [], 0
        yield from settle(docs)

    return segment


def contexts(part: bytes, at: int, size: int, gram: int) -> list[int]:
    """Keys of which two segments with a common window share one: hashes of the anchor with its surroundings, cut SPLITS ways.

    A window holds size - gram bytes besides the anchor, so many to its left and
    the others to its right.
    """
    rest = size - gram
    step = max(1, rest // SPLITS)
    out = []
    for i, left in enumerate(range(0, rest + 1, step)):
        right = max(0, rest - step - left)
        if at >= left and at + gram + right <= len(part):
            out.append(xxhash.xxh64_intdigest(part[at - left : at + gram + right], i) - (1 << 63))
    return out


def _cut_out(size: int, gram: int):
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for k, t, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8", "replace")
                for w in wanted or ():
                    part = data[w["start"] : w["start"] + w["n"] + size - 1]
                    for key in contexts(part, w["at"], size, gram) if w["hot"] else [w["anchor"]]:
                        out.append((key, w["hot"], k, t, w["start"], w["at"], w["known"], part))
                        held += len(part)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CUT, strict=True)], schema=_CUT)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CUT, strict=True)], schema=_CUT)

    return cut_out


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for arrays of ranges, with a sparse table."""
    width = high - low + 1
    level = np.frexp(width.astype(float))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, k = values, 0
    top = int(level.max(initial=0))
    while True:
        here = level == k
        out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
        if k == top:
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


class Rounds:
    """The sequential file of a round: order, common prefixes and transform symbols (0: no symbol before), read once and replaced."""

    def __init__(self, folder: str | None):
        self.folder, self.n = folder, 0
        self.now = tempfile.TemporaryFile(dir=folder)

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.now.seek(0)
        return tuple(np.frombuffer(self.now.read(self.n * np.dtype(kind).itemsize), kind) for kind in (np.int32, np.int32, np.uint16))

    def write(self, order: np.ndarray, common: np.ndarray, transform: np.ndarray) -> None:
        self.now.seek(0)
        for block, kind in ((order, np.int32), (common, np.int32), (transform, np.uint16)):
            self.now.write(block.astype(kind, copy=False).tobytes())
        self.n = len(order)

    def close(self) -> None:
        self.now.close()


def repeated_starts(parts: list[bytes], at: list[int], size: int, folder: str | None = None) -> list[np.ndarray]:
    """For byte strings lined up at their anchors `at`: the starts whose next `size` bytes also start in another one at the same distance from its anchor."""
    length = np.array([len(p) for p in parts])
    left, right = np.array(at), length - np.array(at)
    most = int(left.max())
    columns = most + int(right.max())
    begin = most - left
    last = begin + length - 1
    joining = np.argsort(-last, kind="stable").astype(np.int32)
    joined, hits = 0, []
    state, text = Rounds(folder), tempfile.TemporaryFile(dir=folder)
    with contextlib.closing(state), text:
        symbols = np.zeros((columns, len(parts)), np.uint8)
        for i, p in enumerate(parts):
            symbols[begin[i] : begin[i] + len(p), i] = np.frombuffer(p, np.uint8)
        text.write(symbols[::-1].tobytes())  # columns in the order of the rounds
        del symbols
        text.seek(0)
        following = np.frombuffer(text.read(len(parts)), np.uint8)
        for c in range(columns - 1, -1, -1):
            column, following = following, np.frombuffer(text.read(len(parts)), np.uint8) if c else np.zeros(len(parts), np.uint8)
            order, common, transform = state.read()
            n = joined + int(np.searchsorted(-last[joining[joined:]], -c, "right"))
            if n > joined:  # strings that end here have an empty suffix: they stand first and share nothing
                fresh = joining[joined:n]
                common = np.concatenate([np.zeros(len(fresh), np.int32), common])
                common[len(fresh) : len(fresh) + 1] = 0
                order, transform = np.concatenate([fresh, order]), np.concatenate([column[fresh].astype(np.uint16) + 1, transform])
                joined = n
            keep = np.flatnonzero(transform)
            if len(keep) < len(order):  # a string whose first symbol has been inserted leaves; neighbours meet over the gap
                common = _range_least(common, np.concatenate([[0], keep[:-1] + 1]), keep) if len(keep) else common[:0]
                order, transform = order[keep], transform[keep]
            by = np.argsort(transform, kind="stable")
            same = transform[by][1:] == transform[by][:-1]
            least = np.zeros(len(by), np.int32)
            pairs = np.flatnonzero(same)
            if len(pairs):
                least[pairs + 1] = 1 + _range_least(common, by[pairs] + 1, by[pairs + 1])
            order = order[by]
            state.write(order, least, np.where(begin[order] < c, following[order].astype(np.uint16) + 1, 0))
            long_ = np.flatnonzero(least >= size)
            if len(long_):
                found = np.unique(order[np.concatenate([long_, long_ - 1])])
                hits.append((found, np.full(len(found), c)))
    if not hits:
        return [np.zeros(0, np.int64) for _ in parts]
    who, where = (np.concatenate(x) for x in zip(*hits, strict=True))
    by = np.lexsort((where, who))
    who, where = who[by], where[by] - begin[who[by]]
    edge = np.searchsorted(who, np.arange(len(parts) + 1))
    return [where[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _sort(size: int):
    def found_in(rows: list[list]) -> list[tuple]:
        out = []
        if len(rows) > 1:
            for (_, _, k, t, start, _, known, _), hits in zip(rows, repeated_starts([r[7] for r in rows], [r[5] for r in rows], size), strict=True):
                if not known and len(hits):
                    first, n = runs(hits - np.arange(len(hits)))
                    out += [(k, t, start + int(a), int(m)) for a, m in zip(hits[first], n, strict=True)]
        return out

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor, then by bytes: equal ones repeat whole and one goes on; an anchor that was split is sorted on its own, as others may hold the same segment."""
        rows: list[list] = []  # whole anchors with different segments
        group: list[list] = []  # the different segments of the present anchor
        out: list[tuple] = []

        def close() -> None:
            nonlocal rows, group
            if len(group) > 1:
                if group[0][1]:
                    out.extend(found_in(group))
                else:
                    rows += group
                    if len(rows) >= SORT_SEGMENTS:
                        out.extend(found_in(rows))
                        rows = []
            group = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = list(row)
                if group and row[0] != group[0][0]:
                    close()
                if group and row[7] == group[-1][7]:
                    for r in (group[-1], row):
                        if not r[6]:
                            out.append((r[2], r[3], r[4], len(r[7]) - size + 1))
                    group[-1][6] = True
                else:
                    group.append(row)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)
                out.clear()
        close()
        out.extend(found_in(rows))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return sort


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = SORT_SEGMENTS) -> DataFrame:
    """(k, t, spans): for each document with repeats, spans (start, n) of windows that also start elsewhere; k and t are those of own_keys().

    Anchors of over `hot` segments are split by what surrounds them.
    """
    ship_package(docs.sparkSession)
    texts = own_keys(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("k", "t", "text")
    parts = cut(texts.mapInArrow(_segment(size, gram), _PICKED_DDL), "segments")
    open_ = parts.where("anchor is not null")
    shared = open_.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumn("hot", F.col("n") > hot)
    met = join_hot(open_, shared, ["anchor"], open_.count(), some=True)
    wanted = met.groupBy("k", "t").agg(F.collect_list(F.struct("anchor", "start", "n", "at", "known", "hot")).alias("wanted"))
    strings = join_some(texts, wanted, "k", "t").where("wanted is not null").select("k", "t", "text", "wanted")
    strings = strings.mapInArrow(_cut_out(size, gram), "anchor long, split boolean, k long, t long, start long, at int, known boolean, segment binary")
    found = strings.repartition("anchor").sortWithinPartitions("anchor", "segment").mapInArrow(_sort(size), "k long, t long, start long, n int")
    every = parts.where("anchor is null").select("k", "t", "start", "n").unionByName(found)
    return cut(every.groupBy("k", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "byte-repeats")


def _apply(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = (text or "").encode("utf-8", "replace")
                    removed = pieces = 0
                    kept = data
                    if spans:
                        edge = np.zeros(len(data) + 1, np.int64)
                        lo = np.minimum([s["start"] for s in spans], len(data))
                        hi = np.minimum([s["start"] + s["n"] + size - 1 for s in spans], len(data))
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, hi, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed, pieces = int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    out.append((doc_id, len(data), removed, pieces, kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return apply


def dedup_bytes(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's UTF-8 bytes without those that a repeated window covers.

    A window of `size` bytes is repeated if the same bytes also start anywhere
    else, in this document or another; every occurrence goes, the first too.
    Windows are judged on the input and never cross documents.  A null text has
    no bytes; one shorter than `size` stays whole.  What is kept may end inside
    a character, so it is binary.  Rows of equal doc_id and text lose the same byte
    numbers, and their windows repeat each other; different texts of a null or
    shared doc_id are documents of their own.  Other columns are ignored; an
    empty table gives no rows.
    """
    found = repeats(docs, size, gram)
    rows = own_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    joined = join_some(rows, found, "k", "t").select("doc_id", "text", "spans")
    return joined.mapInArrow(_apply(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_query(docs: DataFrame) -> DataFrame:
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
