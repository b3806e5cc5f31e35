"""Repeated word windows by super-k-mer partitioning.

Each window of `size` words has a minimiser, the least hash among its short
word groups.  Consecutive windows with one minimiser form a super-k-mer, which
travels as one string to the bucket of that minimiser; equal windows therefore
meet in one bucket.  There all windows are sorted, equal neighbours are
compared byte by byte, and every occurrence but the earliest is a repeat.
Super-k-mers that repeat inside a task are settled there, and one of them goes.

A minimiser can be hot: some word group with a small hash stands in a large
share of the texts.  A sample tells which are; windows with one of those travel
alone, to the bucket of their own hash.  That is a rule on a window's words
alone, so equal windows still meet, whatever the sample says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.keyed import join_some, own_keys
from vellum.llm.rolling import INDEX_BITS, Spans, minimisers, mix, runs
from vellum.session import cut, ship_package

SIZE = 20
GROUP = 3
STEP_BYTES = 2_000_000
STEP_WORDS = 500_000
BUCKET_BYTES = 12_000_000
BUCKET_LIMIT = 24_000_000
HOT_BYTES = 6_000_000
MOST_HOT = 1_000_000
SAMPLED = 32
PIECE = 60_000
PART_BYTES = 32_000_000
MOST_PARTS = 100_000
_SENT = pa.schema([("bucket", pa.int64()), ("meta", pa.binary()), ("packed", pa.binary())])
_META = np.dtype([("k", "<i8"), ("t", "<i8"), ("start", "<i8"), ("n", "<i4")])
_FOUND = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def super_kmers(docs: list[tuple[int, int, list[bytes], int]], size: int, group: int, hot: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(minimiser, k, t, start, windows, words) for documents (k, number of the first word, words, t).

    A window whose minimiser is one of `hot` (sorted) stands alone, with its own hash in place of the minimiser.
    """
    docs = [d for d in docs if len(d[2]) >= size]
    if not docs:
        return
    data = b" ".join(w for d in docs for w in d[2])
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    spans = Spans(raw)
    word = spans.hash(begin, end)
    grams = sum(np.roll(word, -i) * np.uint64(2 * i + 3) for i in range(group))
    value, at = minimisers(mix(grams)[: len(word) - group + 1], size - group + 1)
    if hot is not None and len(hot):
        alone = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value)
        value[alone] = (spans.hash(begin[alone], end[alone + size - 1]) >> np.uint64(INDEX_BITS)).astype(np.int64)
        at[alone] = -1 - alone  # no two of them make a run
    counts = np.array([len(d[2]) for d in docs])
    first = np.cumsum(counts) - counts
    windows = np.concatenate([np.arange(a, a + n - size + 1) for a, n in zip(first, counts, strict=True)])
    owner = np.repeat(np.arange(len(docs)), counts - size + 1)
    start, length = runs(at[windows], owner)
    where = windows[start]
    for m, o, w, n, a, b in zip(value[where].tolist(), owner[start].tolist(), where.tolist(), length.tolist(), begin[where].tolist(), end[where + length + size - 2].tolist(), strict=True):
        yield m, docs[o][0], docs[o][3], docs[o][1] + w - int(first[o]), n, data[a:b]


def _steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[int, int, list[bytes], int]]]:
    """The documents (k, t, text) of some batches as super_kmers() takes them, a step's worth at a time; long ones in pieces."""
    docs, held, many = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for k, t, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = words_of(text)
                step = STEP_BYTES // 8
                for cut_at in range(0, max(1, len(words) - size + 1), step):
                    docs.append((k, cut_at, words[cut_at : cut_at + step + size - 1], t))
                    held += sum(map(len, docs[-1][2]))
                    many += len(docs[-1][2])
                    if held >= STEP_BYTES or many >= STEP_WORDS:  # with a last piece, under the places that minimisers() can number
                        yield docs
                        docs, held, many = [], 0, 0
    yield docs


def _weigh(size: int, group: int):
    schema = pa.schema([("m", pa.int64()), ("bytes", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _steps(batches, size):
            distinct = {packed: m for m, *_, packed in super_kmers(docs, size, group)}
            m, at = np.unique(np.array(list(distinct.values()), np.int64), return_inverse=True)
            n = np.bincount(at, np.array([len(x) for x in distinct], np.int64), len(m)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return weigh


def hot_minimisers(texts: DataFrame, size: int, group: int, least: int, sampled: int = SAMPLED) -> np.ndarray:
    """Minimisers of about `least` bytes of super-k-mers or more in texts (k, t, text), told from one of `sampled` pieces of PIECE characters.

    A task counts equal super-k-mers of a step once, as they are sent once.
    What is told decides where windows meet, not which are repeats.
    """
    last = F.floor(F.length("text") / PIECE).cast("int")
    chosen = F.filter(F.sequence(F.lit(0), last), lambda i: F.pmod(F.xxhash64("k", "t", i, F.lit(13)), F.lit(sampled)) == 0)
    pieces = texts.where("text is not null").select("k", "t", "text", F.explode(chosen).alias("i"))
    pieces = pieces.select("k", "t", F.substring(F.col("text"), F.col("i") * PIECE + 1, F.lit(PIECE)).alias("text"))
    weights = pieces.mapInArrow(_weigh(size, group), "m long, bytes long").groupBy("m").agg(F.sum("bytes").alias("bytes"))
    return np.sort(weights.where(F.col("bytes") * sampled >= least).select("m").toArrow().column(0).to_numpy())


def _send(size: int, group: int, buckets: int, hot=None):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    def settle(docs: list[tuple[int, int, list[bytes], int]], press: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}
        known: list[tuple] = []
        for m, k, t, start, n, packed in super_kmers(docs, size, group, hot.value if hot else None):
            old = first.get(packed)
            if old is None or (k, t, start) < old[1:4]:
                first[packed] = (m, k, t, start, n)
                if old:
                    known.append(old[1:])
            elif (k, t, start) != old[1:4]:
                known.append((k, t, start, n))
        parts: dict[int, tuple[list, list]] = {}
        for packed, (m, *meta) in first.items():
            metas, texts = parts.setdefault(m % buckets, ([], []))
            metas.append(tuple(meta))
            texts.append(packed)
        rows = [(b, np.array(metas, _META).tobytes(), press.compress(b"\n".join(texts))) for b, (metas, texts) in parts.items()]
        if known:
            rows.append((int(known[0][0]) % buckets, np.array(known, _META).tobytes(), None))
        for at in range(0, len(rows), 2000):
            yield batch_of(rows[at : at + 2000])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for docs in _steps(batches, size):
            yield from settle(docs, press)

    return send


def later_windows(metas: list[np.ndarray], texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """All windows of some super-k-mers in their order: k, t, start, the super-k-mer's number, and whether its words also occur earlier among them."""
    hashes, k, t, start, begin, end = [], [], [], [], [], []
    base = 0
    for meta, text in zip(metas, texts, strict=True):
        raw = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        b, e = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        n = meta["n"].astype(np.int64)
        words = n + size - 1
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        word = np.repeat(np.cumsum(words) - words, n) + inside
        wb, we = b[word], e[word + size - 1]
        hashes.append(Spans(raw).hash(wb, we))
        k.append(np.repeat(meta["k"], n))
        t.append(np.repeat(meta["t"], n))
        start.append(np.repeat(meta["start"], n) + inside)
        begin.append(wb + base)
        end.append(we + base)
        base += len(raw) + 1
    h, k, t, start, begin, end = map(np.concatenate, (hashes, k, t, start, begin, end))
    owner = np.repeat(np.arange(sum(map(len, metas))), np.concatenate([m["n"] for m in metas]))
    order = np.lexsort((start, t, k, h))
    at, n = runs(h[order])
    later = np.zeros(len(order), bool)
    if (n > 1).any():
        data = b"\n".join(texts)
        for a, m in zip(at[n > 1].tolist(), n[n > 1].tolist(), strict=True):
            seen: dict[bytes, tuple] = {}
            for i in order[a : a + m].tolist():
                me = (k[i], t[i], start[i])
                if seen.setdefault(data[begin[i] : end[i]], me) != me:
                    later[i] = True
    return k, t, start, owner, later


def spans_of(k: np.ndarray, t: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(k, t, start, windows) of windows, neighbours as one."""
    if not len(k):
        return []
    order = np.lexsort((start, t, k))
    k, t, start = k[order], t[order], start[order]
    at, n = runs(k, t, start - np.arange(len(start)))
    return list(zip(k[at].tolist(), t[at].tolist(), start[at].tolist(), n.tolist(), strict=True))


class Bucket:
    """The super-k-mers of a bucket.  When many are held, repeats are told and super-k-mers without a first window go, so that a hot bucket stays small."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.most = size, limit, limit
        self.metas: list[np.ndarray] = []
        self.texts: list[bytes] = []
        self.held = 0

    def add(self, meta: np.ndarray, text: bytes) -> list[tuple[int, int, int, int]]:
        self.metas.append(meta)
        self.texts.append(text)
        self.held += len(text)
        return self.thin() if self.held > self.most else []

    def thin(self) -> list[tuple[int, int, int, int]]:
        k, t, start, owner, later = later_windows(self.metas, self.texts, self.size)
        meta, text = np.concatenate(self.metas), b"\n".join(self.texts).split(b"\n")
        keep = np.unique(owner[~later])
        self.metas, self.texts = [meta[keep]], [b"\n".join([text[i] for i in keep.tolist()])]
        self.held = len(self.texts[0])
        self.most = max(self.limit, 2 * self.held)
        return spans_of(k[later], t[later], start[later])

    def close(self) -> list[tuple[int, int, int, int]]:
        out = []
        if self.metas:
            k, t, start, _, later = later_windows(self.metas, self.texts, self.size)
            out = spans_of(k[later], t[later], start[later])
        self.metas, self.texts, self.held, self.most = [], [], 0, self.limit
        return out


def _count(size: int, limit: int = BUCKET_LIMIT):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_FOUND)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        now, here = None, Bucket(size, limit)
        for batch in batches:
            out = []
            for bucket, meta, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                meta = np.frombuffer(meta, _META)
                if packed is None:
                    out += meta.tolist()
                    continue
                if bucket != now:
                    out += here.close()
                    now = bucket
                out += here.add(meta, open_.decompress(packed))
            if out:
                yield batch_of(out)
        if out := here.close():
            yield batch_of(out)

    return count


def repeats(docs: DataFrame, size: int = SIZE, group: int = GROUP, hot_bytes: int = HOT_BYTES, sampled: int = SAMPLED) -> DataFrame:
    """(k, t, spans): for each document with repeats, spans (start, n) of windows that also start earlier; k and t are those of own_keys().

    Windows of a minimiser with hot_bytes or more are dealt one by one.  At most
    about MOST_HOT minimisers are, so that a table of 8 MB is broadcast at any
    size; past 2 TB of text hot_bytes grows with the input for that.
    """
    ship_package(docs.sparkSession)
    texts = own_keys(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("k", "t", "text")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, 4 * total // BUCKET_BYTES)
    hot = hot_minimisers(texts, size, group, max(hot_bytes, 3 * total // MOST_HOT), sampled)  # super-k-mers overlap: about three times the text
    shared = docs.sparkSession.sparkContext.broadcast(hot) if len(hot) else None
    sent = texts.mapInArrow(_send(size, group, buckets, shared), "bucket long, meta binary, packed binary")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTS, total // PART_BYTES))  # a task reads no more as the input grows
    found = sent.repartition(int(parts), "bucket").sortWithinPartitions("bucket").mapInArrow(_count(size), "k long, t long, start long, n long")
    return cut(found.groupBy("k", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "word-repeats")


def _apply(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = words_of(text)
                    n = len(words)
                    if spans:
                        edge = np.zeros(n + 1, np.int64)
                        for s in spans:
                            edge[min(n, s["start"])] += 1
                            edge[min(n, s["start"] + s["n"] + size - 1)] -= 1
                        keep = np.cumsum(edge[:-1]) == 0
                        words = [w for w, x in zip(words, keep.tolist(), strict=True) if x]
                    out.append((doc_id, n, n - len(words), b" ".join(words).decode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return apply


def dedup_substrings(docs: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each document without words that a repeated window covers.

    Words are runs of bytes other than ASCII white space.  A window is repeated
    if its words also start earlier: in a smaller doc_id, or further left in the
    same document.  Windows are judged on the input.  A null text has no words;
    documents of fewer than `size` words keep all of theirs.  Null doc_ids come
    last.  Rows of equal doc_id and text are one document: a window counts once at
    a place, and all its rows lose the same word numbers; different texts of a
    null or shared doc_id are documents of their own.  Other columns are ignored;
    an empty table gives no rows.
    """
    found = repeats(docs, size, group)
    rows = own_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    joined = join_some(rows, found, "k", "t").select("doc_id", "text", "spans")
    return joined.mapInArrow(_apply(size), "doc_id long, n_words long, n_removed long, text string")


def op5_query(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
