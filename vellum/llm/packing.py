"""Packing documents into training windows by best-fit decreasing.

A segment tree indexed by remaining capacity answers "which open window is the
tightest that still takes this piece".  Overlong documents are first cut into
full windows, so only remainders compete.  Blocks of documents are packed
where they are read: nothing is shuffled, and memory holds one block.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.tokens import GROUP_BYTES, MEMO_PIECES, default_path, encoded, encoder
from vellum.session import ship_package

WINDOW = 2048
BLOCK_TOKENS = 1_000_000
SMALL_MEMO = 150_000
SMALL_GROUP = 3_000_000
LEAST_CUT = 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class CapacityTree:
    """How many open windows there are by remaining capacity 0..limit."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int = 1) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity >= need that some window has, or -1."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: Iterable[int], window: int) -> list[list[int]]:
    """Windows as lists of indexes into lengths, each 1..window.

    Ties go to the piece that comes first and to the window opened last.
    """
    lengths = list(lengths)
    tree, by_room, windows = CapacityTree(window), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.tightest(lengths[i])
        if room < 0:
            w, room = len(windows), window
            windows.append([])
        else:
            w = by_room[room].pop()
            tree.add(room, -1)
        windows[w].append(i)
        if left := room - lengths[i]:
            by_room.setdefault(left, []).append(w)
            tree.add(left)
    return windows


def close_gaps(windows: list[list[tuple[int, int, int]]], window: int, least: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Fill gaps of `least` or more with cut pieces (document, start, length) of the emptiest windows.

    At most one window then stays open; it is laid out as sequences whose
    lengths are powers of two, which need no padding.
    """
    sized = sorted(([sum(p[2] for p in w), w] for w in windows), key=lambda x: -x[0])
    closed = [w for n, w in sized if window - n < least]
    loose = deque(x for x in sized if window - x[0] >= least)
    while len(loose) > 1:
        target, source = loose[0], loose[-1]
        d, s, n = source[1].pop()
        k = min(n, window - target[0])
        target[1].append((d, s, k))
        if k < n:
            source[1].append((d, s + k, n - k))
        target[0] += k
        source[0] -= k
        if target[0] == window:
            closed.append(loose.popleft()[1])
        if not source[0]:
            loose.pop()
    for total, left in loose:
        for bit in reversed(range(total.bit_length())):
            part, size = [], total & 1 << bit
            while size:
                d, s, n = left.pop()
                k = min(n, size)
                part.append((d, s, k))
                size -= k
                if k < n:
                    left.append((d, s + k, n - k))
            closed += [part] if part else []
    return closed


def pack_block(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every id once."""
    full = [[(d, s, window)] for d, n in enumerate(lengths) for s in range(0, n - window + 1, window)]
    rest = [(d, n // window * window, n % window) for d, n in enumerate(lengths) if n % window]
    return full + close_gaps([[rest[i] for i in w] for w in best_fit_decreasing([p[2] for p in rest], window)], window)


def _packer(path: str, end_id: int, window: int, block_tokens: int, keep_memo: bool = True):
    end = np.array([end_id], "<u4").tobytes()

    def emit(docs: list[tuple[int | None, bytes]], base: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(b) // 4 for _, b in docs]
        sequences = pack_block(lengths, window)
        rows = []
        for q, pieces in enumerate(sequences):
            at = 0
            for d, s, n in pieces:
                rows.append((docs[d][0], s, n, docs[d][1][4 * s : 4 * (s + n)], lengths[d], base + q, at))
                at += n
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW), len(sequences)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        enc.memo_pieces = MEMO_PIECES if keep_memo else SMALL_MEMO
        base = TaskContext.get().partitionId() << 40
        docs: list[tuple[int | None, bytes]] = []
        held = 0
        for doc_id, ids in encoded(batches, enc, GROUP_BYTES if keep_memo else SMALL_GROUP):
            docs.append((doc_id, ids.tobytes() + end))
            held += len(ids) + 1
            if held >= block_tokens:
                out, n = emit(docs, base)
                base, docs, held = base + n, [], 0
                yield out
        if not keep_memo:
            enc.forget()
        if docs:
            yield emit(docs, base)[0]
        if not keep_memo:
            pa.default_memory_pool().release_unused()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, keep_memo: bool = True) -> DataFrame:
    """Pieces of documents (doc_id, text) laid into windows: SCHEMA, ids as little-endian uint32.

    A document is its ids and end_id.  A null text counts as empty, so it is one
    end id.  Each input row is a document of its own, repeated and null doc_ids
    too; other columns are ignored.  An empty table gives no rows.  A sequence is
    filled from offset 0 without gaps and padded by its reader to `window`,
    unless its length is a power of two.  keep_memo keeps many encoded pieces, for
    a worker's next task too; without it fewer bytes are encoded at once as well, and
    other stages have that memory.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_packer(tokenizer or default_path(), end_id, window, block_tokens, keep_memo), SCHEMA)


def op4_query(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
