"""Line deduplication over a collection by a deletion-neighbourhood join.

Words are the letters of the edit distance.  Two lines are alike within one
edit exactly if a variant of one, itself or itself less one word, equals a
variant of the other in the same place.  Variants of lines that cannot have a
partner need not be made: within one edit, two lines share half of their
words as a beginning or an end, so lines whose beginnings and ends occur in no
other line are left out first.  The other lines are numbered in their order,
and a variant row is a hash, a place and that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.keyed import join_hot, join_some, maybe, own_keys, wrapped
from vellum.llm.rolling import Spans, inverse_powers, mix, powers
from vellum.session import cut, ship_package

LEAST_WORDS = 5
STEP_CHARS = 500_000
STEP_VARIANTS = 200_000
SALTS = 32
_ONE_SPACE = bytes(32 if c in b"\t\x0b\x0c\r" else c for c in range(256))
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("line", pa.int32()), ("anchors", pa.list_(pa.int64()))])
_VARIANTS = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("variant", pa.int64()), ("words", pa.string())])


def words_of(line: str) -> list[bytes]:
    return line.lower().encode("utf-8", "replace").split()


class Lines:
    """All lines of a text in lower case with single spaces, and hashes of runs of their words."""

    def __init__(self, text: str):
        raw = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_ONE_SPACE), np.uint8)
        blank, feed = raw == 32, raw == 10
        edge = np.append(True, (blank | feed)[:-1]) if len(raw) else feed
        raw = raw[~(blank & edge)]  # the first space of a run stays, none at the beginning of a line
        ends = np.append(raw[1:] == 10, True) if len(raw) else blank
        raw = raw[~((raw == 32) & ends)]
        self.data = raw.tobytes()
        feeds = np.flatnonzero(raw == 10)
        self.begin, self.end = np.append(0, feeds + 1), np.append(feeds, len(raw))
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        first, last = np.append(0, gaps + 1), np.append(gaps, len(raw))
        real = last > first
        word = Spans(raw).hash(first[real], last[real]) if real.any() else np.zeros(0, np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(word * powers(1, len(word))))
        self.start = np.searchsorted(first[real], self.begin)
        self.n = np.searchsorted(first[real], self.end) - self.start

    def down(self, at: np.ndarray) -> np.ndarray:
        return inverse_powers(1, at, len(self.sums) + 1)

    def run(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[start + n] - self.sums[start]) * self.down(start)

    def digests(self, which: np.ndarray) -> np.ndarray:
        d = self.data
        found = [xxhash.xxh3_128_digest(d[a:b]) for a, b in zip(self.begin[which].tolist(), self.end[which].tolist(), strict=True)]
        return np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)

    def anchors(self, which: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of beginnings and ends that a partner must share one of, if the longer line has `least` words; and where each line's begin."""
        s, n = self.start[which], self.n[which]
        own, longer = _half(n), _half(n + 1)
        takes = np.stack([n >= least, (n + 1 >= least) & ((own != longer) | (n < least))], 1)
        size = np.stack([own, longer], 1)
        ends = np.stack([self.run(s[:, None], size), self.run((s + n)[:, None] - size, size)], 2)
        side = np.arange(2, dtype=np.uint64)
        keys = mix(ends + mix((2 * size[:, :, None]).astype(np.uint64) + side))
        many = np.repeat(takes[:, :, None], 2, 2).reshape(len(s), 4)
        return keys.reshape(len(s), 4)[many].view(np.int64), np.append(0, np.cumsum(many.sum(1)))

    def variants(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, place and hash of every variant: the whole line (-1), and where it has `least` words the line without word 0, 1, ..."""
        many = np.where(self.n >= least, self.n, 0)
        line = np.repeat(np.arange(len(self.n)), many)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
        s, e = self.start[line], self.start[line] + self.n[line]
        less = (self.sums[s + pos] - self.sums[s]) * self.down(s) + (self.sums[e] - self.sums[s + pos + 1]) * self.down(s + 1)
        less = mix(less + mix((self.n[line] - 1).astype(np.uint64)))
        whole = mix(self.run(self.start, self.n) + mix(self.n.astype(np.uint64)))
        out = np.append(np.arange(len(self.n)), line), np.append(np.full(len(self.n), -1), pos), np.append(whole, less).view(np.int64)
        return out


def _half(n: np.ndarray) -> np.ndarray:
    """Words of a beginning or an end that lines of n words within one edit share: the largest power of two in half of n - 1."""
    return 1 << (np.frexp((np.maximum(2, n - 1) // 2).astype(float))[1] - 1)


def anchors_of(words: list[bytes], least: int = 0) -> list[int]:
    return Lines(b" ".join(words).decode()).anchors(np.array([0]), least)[0].tolist()


def variants_of(words: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Positions and hashes: the whole line (-1), then without word 0, 1, ..."""
    _, pos, h = Lines(b" ".join(words).decode()).variants(0)
    return pos.tolist(), h


def one_edit(a: str, b: str) -> bool:
    """Whether one word at most must be added, taken or replaced to make a of b."""
    x, y = a.split(" "), b.split(" ")
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _split(least: int):
    def lines(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        found = Lines("\n".join(text for _, _, text in rows))
        per_doc = np.array([text.count("\n") + 1 for _, _, text in rows])
        which = np.flatnonzero(found.n)
        owner = np.repeat(np.arange(len(rows)), per_doc)[which]
        number = which - (np.cumsum(per_doc) - per_doc)[owner]
        h = found.digests(which)
        anchors, edge = found.anchors(which, least)
        k, t = (np.array([r[i] for r in rows], np.int64)[owner] for i in (0, 1))
        lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(anchors))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(k), pa.array(t), pa.array(number.astype(np.int32)), lists], schema=_LINES)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    held.append((k, t, text))
                    size += len(text)
                if size >= STEP_CHARS:
                    yield lines(held)
                    held, size = [], 0
        if held:
            yield lines(held)

    return split


def _vary(least: int):
    def vary(wanted: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        """A line of very many words makes its variants in one go, others together."""
        lines = Lines("\n".join(line for _, line in wanted))
        line, pos, h = lines.variants(least)
        ids = np.array([i for i, _ in wanted])[line]
        texts = [lines.data[a:b].decode("utf-8", "replace") for a, b in zip(lines.begin.tolist(), lines.end.tolist(), strict=True)]
        for a in range(0, len(ids), STEP_VARIANTS):
            b = min(len(ids), a + STEP_VARIANTS)
            words = pa.array(texts[a:b] + [None] * (b - max(a, min(b, len(texts)))), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(pos[a:b].astype(np.int32)), pa.array(h[a:b]), words], schema=_VARIANTS)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = (text or "").split("\n") if wanted else []
                for w in wanted or ():
                    held.append((w["id"], lines[w["line"]]))
                    size += len(held[-1][1])
                    if size >= STEP_CHARS:
                        yield from vary(held)
                        held, size = [], 0
        if held:
            yield from vary(held)

    return all_of


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = [pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        out = []
        for text, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, gone = (text or "").split("\n"), set(lines or ())
            out.append((text if not gone else "\n".join(p for i, p in enumerate(parts) if i not in gone), 0 if text is None else len(parts), len(gone)))
        made = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(schema)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", "text", "n_lines", "n_removed"])


def _candidates(seen: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, k, t, line, h1, h2) of the distinct lines that may have a partner; ids rise in the order of first occurrences."""
    spread = seen.select("h1", "h2", F.explode("anchors").alias("anchor"))
    counts = spread.groupBy("anchor").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("n"))
    shared = counts.where("a <> b").select("anchor", "n")
    chosen = join_hot(spread, shared, ["anchor"], 2 * seen.count(), some=True).select("h1", "h2").distinct()
    wanted = lines.join(chosen, ["h1", "h2"], "left_semi").select("first.*", "h1", "h2")
    ordered = wanted.repartitionByRange("k", "t", "line").sortWithinPartitions("k", "t", "line")
    return cut(ordered.withColumn("id", F.monotonically_increasing_id()), "line-candidates")


def _near(texts: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """(id) of candidates that are within one edit of an earlier one."""
    wanted = candidates.groupBy("k", "t").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    found = join_some(texts, wanted, "k", "t").where("wanted is not null").select("text", "wanted")
    variants = cut(found.mapInArrow(_vary(least), "id long, pos int, variant long, words string"), "line-variants")
    total = variants.count()
    less, whole = variants.where("pos >= 0").select("variant", "pos", "id"), variants.where("pos < 0").select("variant", F.col("id").alias("w"))
    same = less.groupBy("variant", "pos").agg(F.min("id").alias("before"), F.max("id").alias("last"), F.count("*").alias("n")).where("before <> last").drop("last")
    pairs = join_hot(less, same, ["variant", "pos"], total, some=True).where("before < id").select("id", "before")
    hits = maybe(less, whole, "variant").where("may").select("variant", "id")
    met = whole.join(hits.groupBy("variant").agg(F.min("id").alias("least"), F.count("*").alias("n")), "variant")
    pairs = pairs.unionByName(met.where("least < w").select(F.col("w").alias("id"), F.col("least").alias("before")))
    pairs = pairs.unionByName(join_hot(hits, met.drop("least"), ["variant"], total).where("w < id").select("id", F.col("w").alias("before")))
    pairs = cut(pairs.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "line-pairs")
    words = variants.where("pos < 0").select("id", "words")
    lead = pairs.select("before", "salt").distinct().join(words.select(F.col("id").alias("before"), F.col("words").alias("theirs")), "before")  # an earliest line with many partners is dealt to several tasks
    alike = F.pandas_udf(lambda a, b: a.combine(b, one_edit).astype(bool), "boolean")
    return pairs.join(words, "id").join(lead, ["before", "salt"]).where(alike("words", "theirs")).select("id").distinct()


def removed_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(k, t, lines): the numbers of the lines to take out of each document that loses any; k and t are those of own_keys()."""
    ship_package(docs.sparkSession)
    texts = own_keys(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("k", "t", "text")
    seen = cut(texts.mapInArrow(_split(least), "h1 long, h2 long, k long, t long, line int, anchors array<long>"), "lines")
    lines = cut(seen.groupBy("h1", "h2").agg(F.min(F.struct("k", "t", "line")).alias("first"), F.count("*").alias("n")), "lines-distinct")
    candidates = _candidates(seen, lines)
    near = candidates.join(_near(texts, candidates, least), "id").select("h1", "h2", F.lit(True).alias("near"))
    marked = cut(lines.join(near, ["h1", "h2"], "left").where("n > 1 or near"), "lines-marked")
    gone = join_hot(seen.drop("anchors"), marked, ["h1", "h2"], seen.count(), some=True).where(F.col("near").isNotNull() | (F.struct("k", "t", "line") > F.col("first")))
    return cut(gone.groupBy("k", "t").agg(F.sort_array(F.collect_set("line")).alias("lines")), "lines-gone")


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated lines taken out of text, and the columns n_lines and n_removed.

    Lines are split at line feeds and compared by lower-case words.  A line goes
    if it occurred before, or if a line that first occurred before its own first
    occurrence is within one word of it and the longer of the two has `least`
    words or more; before means a smaller doc_id, then a smaller line number,
    and null doc_ids come last.  Lines without words stay.  Null texts stay null with 0 lines.
    Rows of equal doc_id and text are one document and lose the same line
    numbers; different texts of a null or shared doc_id are documents of their own.
    Columns of docs named n_lines or n_removed are replaced; any other name may occur.
    """
    rows = own_keys(wrapped(docs, "text", "n_lines", "n_removed"))
    joined = join_some(rows, removed_lines(docs, least), "k", "t").select("row", "text", "lines")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_drop, schema).select("row.*", "text", "n_lines", "n_removed")


def op9_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
