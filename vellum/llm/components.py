"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.keyed import join_hot
from vellum.session import cut, ship_package

MOST_ROUNDS = 60
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node that u, v connect to the least node of its part, by repeated minima."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task, edges become a forest with fewer and shorter paths; a bounded number is held."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u, v = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((u, v)))
        if len(u) > 500_000:
            u, v = forest(u, v)
        if len(u) > 250_000:
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGES)
            u, v = u[:0], v[:0]
    if len(u):
        u, v = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (u long, v long) reaches.

    Large-star and small-star rounds (Kiveris et al., 2014) until every node
    points at the least one of its part and no such node points further.
    Nodes without an edge to another node are not in the result; self-loops and
    repeated edges change nothing; an empty table gives an empty result.
    """
    ship_package(edges.sparkSession)
    clean = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut(clean.mapInArrow(_local, "u long, v long").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        nodes = now.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        state = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if(F.expr("up > 1 or up = 1 and least = 0")).alias("open")).first()
        if not state["open"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        stars = _star(_star(now, False, 2 * state["n"]), True, state["n"])
        now = cut(stars.mapInArrow(_local, "u long, v long").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def _star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """u, v with u > v.  Large: greater neighbours link to the least; small: lesser ones and the node do."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    joined = join_hot(both, least, ["u"], total)
    if small:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()
