"""Token ids in Arrow files of fixed-size-list batches.

A shard holds a run of documents in ascending doc_id order.  Their ids stand
back to back in rows of one length, with a mask beside each; the last row is
padded and masked.  Every batch but the last has the same number of rows, so
row r lies in batch r // ROWS and a memory map gives it without a copy.  Masks
are bytes, but few differ: a row points at one of the masks in the file's
dictionary, all ones or that of the padded row.  An index file beside each
shard has a row for each document.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.tokens import default_path, encoded, encoder
from vellum.session import cut, scratch_path, ship_package

LENGTH = 2048
ROWS = 64
MANIFEST = "shard long, path string, docs long, tokens long"
_MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://"))


def shard_schema(vocabulary: int, length: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])


class ShardWriter:
    """Writes one shard and its index; they appear under their names only when whole."""

    def __init__(self, folder: str, shard: int, vocabulary: int, length: int, rows: int):
        self.fs, root = _filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.name, self.part = f"{root}/shard-{shard:08d}", f"{root}/.{uuid.uuid4().hex}"
        self.schema, self.length, self.rows = shard_schema(vocabulary, length), length, rows
        self.kind = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.sinks = [self.fs.open_output_stream(f"{self.part}-{x}") for x in ("tokens", "index")]
        self.tokens, self.index = pa.ipc.new_file(self.sinks[0], self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)), pa.ipc.new_file(self.sinks[1], _INDEX)
        self.held: list[np.ndarray] = []
        self.entries: list[tuple] = []
        self.n_held = self.n = self.docs = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.entries.append((doc_id, self.n, len(ids)))
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        self.n_held += len(ids)
        self.docs += 1
        if self.n_held >= self.rows * self.length:
            self._flush(False)
        if len(self.entries) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        whole = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        size = self.rows * self.length
        for at in range(0, len(whole) if last else len(whole) // size * size, size):
            ids, masks = whole[at : at + size], np.ones((1, self.length), np.uint8)
            pad = -len(ids) % self.length
            kind = np.zeros((len(ids) + pad) // self.length, np.int8)
            if pad:
                ids, masks, kind[-1] = np.pad(ids, (0, pad)), np.append(masks, [np.arange(self.length) < self.length - pad], 0).astype(np.uint8), 1
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.DictionaryArray.from_arrays(pa.array(kind), pa.FixedSizeListArray.from_arrays(pa.array(masks.ravel()), self.length))]
            self.tokens.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        rest = whole[len(whole) // size * size :]
        self.held, self.n_held = ([] if last else [rest]), (0 if last else len(rest))

    def _flush_index(self) -> None:
        if self.entries:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.entries, strict=True)], schema=_INDEX))
        self.entries = []

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self._flush_index()
        for w, sink in ((self.tokens, self.sinks[0]), (self.index, self.sinks[1])):
            w.close()
            sink.close()
        for x in ("tokens", "index"):
            self.fs.move(f"{self.part}-{x}", f"{self.name}.{x}.arrow")
        return self.name, self.docs, self.n


class Shard:
    """Random access to a written shard; a local one is memory-mapped."""

    def __init__(self, name: str, uri: str):
        self.fs, _ = _filesystem(uri)
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.files = [pa.memory_map(f"{name}.{x}.arrow") if local else self.fs.open_input_file(f"{name}.{x}.arrow") for x in ("tokens", "index")]
        self.tokens, self.index = (pa.ipc.open_file(f) for f in self.files)
        self.length = self.tokens.schema.field("ids").type.list_size
        self._batch: tuple[int, np.ndarray] = (-1, np.zeros(0))
        self.per_batch = self.tokens.get_batch(0).num_rows if self.tokens.num_record_batches else 0

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (1 for an id, 0 for padding) of sequence r, as views of the file's bytes."""
        batch = self.tokens.get_batch(r // self.per_batch)
        masks = batch.column(1)
        at = r % self.per_batch
        ids, mask = (lists.values.slice(i * self.length, self.length) for lists, i in ((batch.column(0), at), (masks.dictionary, masks.indices[at].as_py())))
        return ids.to_numpy(), mask.to_numpy()

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids start..start+n of the shard, wherever its rows end."""
        size, out = self.per_batch * self.length, []
        while n:
            b = start // size
            if self._batch[0] != b:
                self._batch = (b, self.tokens.get_batch(b).column(0).values.to_numpy())
            part = self._batch[1][start - b * size : start - b * size + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for b in range(self.index.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.index.get_batch(b).columns), strict=True)

    def close(self) -> None:
        for f in self.files:
            f.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Encode documents (doc_id, text) into shards under folder; returns the manifest with each shard's first id.

    Documents stand in ascending doc_id order across shards, null doc_ids
    first, equal ones by text.  A null text is empty, so only its end id is
    written.  Other columns are ignored.  An empty table writes no shard and
    gives an empty manifest.  A task that is run again writes the same shard.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(path), None
        shard = TaskContext.get().partitionId()
        for doc_id, ids in encoded(batches, enc):
            out = out or ShardWriter(folder, shard, max(enc.vocabulary, end_id + 1), length, rows)
            out.add(doc_id, np.append(ids, np.uint32(end_id)))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, (shard, *out.close()), strict=True))], schema=_MANIFEST)

    rows_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows_.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut(ordered.mapInArrow(write, MANIFEST), "tokens-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    return manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document of the shards: doc_id, start (over all shards), n_tokens, ids_crc32."""
    ship_package(manifest.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, out = Shard(path, folder), []
                for doc_id, start, n in shard.documents():
                    out.append((doc_id, first + start, n, zlib.crc32(shard.ids(start, n).astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                shard.close()

    spread = manifest.select("path", "first").repartition(manifest.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_query(docs: DataFrame) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "arrow-tokens")
    return read_tokens(write_tokens(docs, folder), folder)
