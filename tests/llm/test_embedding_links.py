"""Links of embeddings against all pairs: counts, components, recall at the bound, repeated ids, large buckets."""

import numpy as np
import pytest

from vellum.llm import embeddings


def plain(ids, x, labels):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= embeddings.COSINE) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    part = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(part, np.where(near, part[None, :], len(x)).min(1))
        if (new == part).all():
            break
        part = new
    return near, [min(ids[part == p]) for p in part]


@pytest.mark.parametrize("chunk", [embeddings.CHUNK, 4])
def test_counts_and_components(spark, chunk):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([c + rng.normal(size=(int(n), 32)) * 0.08 for c, n in zip(centres, rng.integers(1, 40, 12), strict=True)] + [centres[:3], centres[:3]])
    labels = rng.integers(0, 2, len(x))
    ids = rng.permutation(len(x)) + 5
    df = spark.createDataFrame([(int(i), [float(v) for v in row], int(n)) for i, row, n in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, chunk=chunk).collect()}
    near, component = plain(ids, x, labels)
    assert [got[i]["n_links"] for i in ids] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in ids] == component


def test_recall_at_the_bound(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=(1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = embeddings.COSINE + 0.001
    x = np.concatenate([u, c * u + np.sqrt(1 - c * c) * w])
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert sum(r["n_links"] for r in embeddings.op7_query(df).collect()) >= 2 * 0.92 * len(u)


def test_different_vectors_of_one_id(spark):
    a, b = np.eye(16)[0], np.eye(16)[1]
    rows = [(7, a, 1), (7, b, 1), (8, a + 0.05 * b, 1), (9, b + 0.05 * a, 1)]
    df = spark.createDataFrame([(i, [float(v) for v in x], n) for i, x, n in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.op7_query(df).collect())
    assert got == [(7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]


def test_very_large_components(spark):
    df = spark.createDataFrame([(1, [3e38, 3e38]), (2, [3e38, 3e38 * 0.9]), (3, [1e-40, 0.0])], "vec_id long, embedding array<double>").selectExpr("*", "'x' as label")
    assert sorted((r["vec_id"], r["n_links"]) for r in embeddings.op7_query(df).collect()) == [(1, 1), (2, 1), (3, 0)]
