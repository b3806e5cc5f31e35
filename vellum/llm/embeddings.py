"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by sign flips and fast Hadamard transforms; its hash is the
nearest of the 2d signed unit vectors.  A table joins two such hashes and the
label to a bucket.  A vector lives in its own bucket of each table and also
visits the buckets that it nearly fell into.  All pairs that meet are verified
by their cosine in double precision.  Pairs are counted where they first meet,
never listed: a bucket gives each of its vectors a number of links and the
least vector that it is connected with there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.components import components, forest
from vellum.llm.keyed import maybe
from vellum.llm.rolling import runs
from vellum.session import cut, ship_package

COSINE = 0.93
LEAST_TABLES = 4
PROBES = 2
CHUNK = 1024
LARGE_BUCKETS = 50_000
FLUSH_PAIRS = 400_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, in n log n steps."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, table: int, probes: int, seed: int = 11) -> np.ndarray:
    """For each row the `probes` likeliest buckets of a table, its own first."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    best = []
    for part in (0, 1):
        r = padded
        for turn in range(3):
            signs = np.random.default_rng([seed, table, part, turn, d]).choice([-1.0, 1.0], d)
            r = hadamard(r * signs) / np.sqrt(d)
        top = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :3]
        value = np.take_along_axis(r, top, 1)
        best.append((2 * top + (value < 0), np.abs(value)))
    (a, u), (b, v) = best
    score = (u[:, :, None] + v[:, None, :]).reshape(len(x), -1)
    code = (a[:, :, None] * (2 * d) + b[:, None, :]).reshape(len(x), -1)
    order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(code, order, 1)


def tables_for(dims: int) -> int:
    """Tables that find pairs at the bound in vectors of a length: one more for each doubling beyond 64, as hashes part more pairs there."""
    return max(LEAST_TABLES, (dims - 1).bit_length() - 2)


def _mix(label: np.ndarray, table: int, code: np.ndarray) -> np.ndarray:
    h = (label.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(table)) * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(27)).view(np.int64)


def _hash(tables: int | None, probes: int, names: list[str]):
    """Adds buckets to rows with label_hash and vector: for each table the own one, then those to visit."""
    at, by = names.index("vector"), names.index("label_hash")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(at).offsets.to_numpy())
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                for first in range(0, len(rows), 2000):
                    part = batch.take(pa.array(rows[first : first + 2000]))
                    unit = _unit(part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                    label = part.column(by).to_numpy()
                    buckets = np.concatenate([_mix(label[:, None], t, codes(unit, t, probes)) for t in range(tables or tables_for(int(d)))], 1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, buckets.shape[1], dtype=np.int32)), pa.array(buckets.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*names, "buckets"])

    return hashed


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length one; the largest component is taken out first, so that squares stay finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def first_meeting(x: np.ndarray, y: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs with buckets x and y (pair, table, own and probes) meet for the first time in this table and bucket.

    They meet in the own bucket of either that the other lives in or visits; the
    first place is that of the lowest table and, in it, of the smaller bucket.
    """
    in_x, in_y = (x[:, :, :1] == y).any(2), (y[:, :, :1] == x).any(2)
    i = np.arange(len(x))
    earlier = ((in_x | in_y) & (np.arange(x.shape[1]) < table[:, None])).any(1)
    low = np.where(in_x, x[:, :, 0], np.iinfo(np.int64).max)[i, table]
    other = np.where(in_y, y[:, :, 0], np.iinfo(np.int64).max)[i, table]
    return ~earlier & (bucket == np.minimum(low, other))


def _verify(cosine: float, probes: int):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, residents before visitors; a unit's residents are held, the others stream by."""
        key, home, held = None, None, []
        a_ids, b_ids, a_m, b_m, size = [], [], [], [], 0

        def meet(rows: tuple, inside: bool) -> None:
            nonlocal size
            ids, m, x, buckets = rows
            for at in range(0, len(ids), CHUNK):
                near, to = np.nonzero(x[at : at + CHUNK] @ home[2].T >= cosine)
                near += at
                if inside:
                    near, to = near[near > to], to[near > to]
                if len(near):
                    n = np.full(len(near), key[3])
                    new = first_meeting(buckets[near], home[3][to], n, np.full(len(near), key[0]))
                    near, to = near[new], to[new]
                    for out, v in ((a_ids, ids[near]), (b_ids, home[0][to]), (a_m, m[near]), (b_m, home[1][to])):
                        out.append(v)
                    size += len(near)

        def flush() -> pa.RecordBatch:
            nonlocal size
            a, b, ma, mb = map(np.concatenate, (a_ids, b_ids, a_m, b_m))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            links = np.bincount(at, np.concatenate([mb, ma])).astype(np.int64)
            least = ids.copy()
            node, root = forest(a, b)
            least[np.searchsorted(ids, node)] = root
            for out in (a_ids, b_ids, a_m, b_m):
                out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(least)], schema=schema)

        def gather() -> None:
            nonlocal home, held
            if held:
                home, held = tuple(map(np.concatenate, zip(*held, strict=True))), []
                meet(home, True)

        for batch in batches:
            bucket, chunk, table, resident, ids, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            vectors, buckets = batch.column(6), batch.column(7)
            dims = np.diff(vectors.offsets.to_numpy())
            numbers, edge = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            visited, place = buckets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(buckets.offsets.to_numpy()))])
            for first, n in zip(*(x.tolist() for x in runs(bucket, chunk, dims, resident)), strict=True):
                here = (bucket[first], chunk[first], dims[first], table[first])
                x = _unit(numbers[edge[first] : edge[first + n]].reshape(n, -1))
                rows = (ids[first : first + n], m[first : first + n], x, visited[place[first] : place[first + n]].reshape(n, -1, probes))
                if key != here:
                    gather()
                    key, home = here, None
                if resident[first]:
                    held.append(rows)
                else:
                    gather()
                    if home is not None:
                        meet(rows, False)
                if size > FLUSH_PAIRS:
                    yield flush()
        gather()
        if size:
            yield flush()

    return verify


def links_of(kinds: DataFrame, cosine: float = COSINE, probes: int = PROBES, chunk: int = CHUNK) -> DataFrame:
    """(id, links, least), several rows an id: how many vectors it links with, and an id that it is connected with.

    kinds: id, m (rows that hold this vector), vector, buckets.  A bucket with
    over `chunk` residents is cut into chunks of residents, each a unit of work
    that the others visit.  The list of these buckets is broadcast; chunks grow
    where it would pass LARGE_BUCKETS rows.
    """
    spread = kinds.select(F.posexplode("buckets").alias("slot", "bucket"), "id", "m", "vector", "buckets").withColumn("visits", F.col("slot") % probes != 0)
    sizes = cut(spread.groupBy("bucket").agg(F.count_if(~F.col("visits")).alias("homes"), F.count("*").alias("n")).where("homes > 0 and n > 1").select("bucket", "homes"), "bucket-sizes")
    chunk = max(chunk, (sizes.agg(F.coalesce(F.sum("homes"), F.lit(0))).first()[0]) // LARGE_BUCKETS + 1)
    large = sizes.where(F.col("homes") > chunk).select("bucket", F.ceil(F.col("homes") / chunk).cast("int").alias("chunks"))
    rows = maybe(spread, sizes, "bucket").where("may").join(F.broadcast(large), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.when(F.col("visits"), F.col("chunks") - 1).otherwise(F.col("home")))))
    resident = (~F.col("visits") & (F.col("home") == F.col("chunk"))).alias("resident")
    work = rows.select("bucket", "chunk", F.floor(F.col("slot") / probes).cast("int").alias("table"), resident, "id", "m", "vector", "buckets")
    ordered = work.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", F.size("vector"), F.desc("resident"))
    return ordered.mapInArrow(_verify(cosine, probes), "id long, links long, least long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int = PROBES, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and the cosine in
    double precision is at least `cosine`, as far as hashing finds the pair;
    equal vectors always link.  A vector that is null, empty, zero or has a null
    or non-finite component, or whose label is null, links with nothing: no
    links, its own component.  Vectors of different length do not link.
    Repeated rows are vectors of their own, and so are different vectors under
    one vec_id: each row has the links of its vector.  Rows without a vec_id
    are never kept.  Other columns are ignored; an empty table gives no rows.
    """
    ship_package(embeddings.sparkSession)
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # cosines are in double precision either way
    numbers = F.transform("embedding", lambda x: x.cast(kind))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), numbers.alias("vector"))
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("vector", F.when(F.col("valid"), F.transform("vector", lambda x: (x + F.lit(0.0)).cast(kind))))
    rows = rows.withColumn("h1", F.xxhash64("label", "vector", F.lit(1))).withColumn("h2", F.xxhash64(F.lit(2), "vector", "label"))
    classes = rows.where("valid").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "first", "m", F.xxhash64("label").alias("label_hash"), "vector")
    hashed = T.StructType([*classes.schema.fields, T.StructField("buckets", T.ArrayType(T.LongType()))])
    kinds = cut(classes.mapInArrow(_hash(tables, probes, classes.columns), hashed), "vectors")
    found = cut(links_of(kinds.select("id", "m", "vector", "buckets"), cosine, probes, chunk), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("others"))
    parts = components(found.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))).withColumnRenamed("node", "id")
    facts = kinds.select("id", "h1", "h2", "first", "m").join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = facts.where("others is not null").groupBy("component").agg(F.min("first").alias("smallest"))
    facts = facts.join(smallest, "component", "left")
    facts = facts.select("h1", "h2", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("smallest", "first").alias("component_id"))
    valid = rows.where("valid").select("vec_id", "h1", "h2")
    linked = valid.join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
