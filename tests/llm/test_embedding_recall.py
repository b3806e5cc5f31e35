"""Recall at the bound by the length of the vectors, and vectors of several lengths in one table."""

import numpy as np
import pytest

from vellum.llm import embeddings


def pairs_at_the_bound(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(n, dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = embeddings.COSINE + 1e-4
    return u, c * u + np.sqrt(1 - c * c) * w


@pytest.mark.parametrize("dims", [16, 64, 100, 256, 768])
def test_recall_of_the_codes(dims):
    """Pairs of cosine 0.93 that meet in some table: one's own bucket is among those of the other."""
    u, v = pairs_at_the_bound(2000, dims)
    met = np.zeros(len(u), bool)
    for t in range(embeddings.tables_for(dims)):
        a, b = (embeddings.codes(x, t, embeddings.PROBES) for x in (u, v))
        met |= (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)
    assert met.mean() >= 0.93


def test_lengths_side_by_side(spark):
    rows, n = [], 0
    for dims in (8, 300, 64):
        for a, b in zip(*pairs_at_the_bound(60, dims, dims), strict=True):
            rows += [(n, [float(x) for x in a], 1), (n + 1, [float(x) for x in b], 1)]
            n += 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    for at in (0, 120, 240):
        assert sum(got[i] for i in range(at, at + 120)) >= 0.9 * 120
