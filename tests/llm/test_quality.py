"""The quality classifier: its solver against plain ones, held-out rows, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import quality


def hinge(w, x, y, c):
    return 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()


def test_dual_coordinate_descent_reaches_the_least_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    y = np.where(x @ rng.normal(size=8) + rng.normal(size=60) > 0, 1.0, -1.0)
    c = np.where(y > 0, 0.3, 1.2)
    rows, values = [np.arange(8)] * 60, list(x)
    w = quality.fit_hinge(rows, values, y, c, 8, epochs=3000)
    plain, best = np.zeros(8), np.inf
    for t in range(1, 40_000):  # subgradient descent
        inside = y * (x @ plain) < 1
        plain -= (plain - ((c * y)[inside, None] * x[inside]).sum(0)) / t
        best = min(best, hinge(plain, x, y, c))
    assert hinge(w, x, y, c) <= best * 1.001


def test_log_ratios_by_hand():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([0, 2])]
    got = quality.log_ratios(rows, np.array([True, False, False]), 4)
    assert got == pytest.approx(np.log([(2 / 6) / (3 / 8), (2 / 6) / (1 / 8), (1 / 6) / (3 / 8), (1 / 6) / (1 / 8)]))


def test_held_out_rows(spark):
    from vellum.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    out = queries()["op12_quality"](spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    tried = [r for r in rows if r["held_out"] and r["quality"] is not None]
    good = [r for r in tried if r["quality"] == 1]
    bad = [r for r in tried if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.8 * len(bad)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_odd_inputs(spark, docs):
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (4, 0), (4, 1), (5, 1), (6, 0), (9, None), (None, 1)], "doc_id long, quality int"))
    rated = quality.score(docs.withColumn("score", F.lit("mine")), model, "score")
    rows = {r["doc_id"]: r["score"] for r in rated.collect()}
    assert rated.count() == docs.count() and all(0 <= s <= 1 for s in rows.values())
    assert rows[2] == rows[3] and rows[9] == rows[10]  # null as empty, repeated rows alike
    assert {"k", "h1", "spans", "slot"} <= set(rated.columns)


@pytest.mark.parametrize("labels, high", [([], 0.5), ([(1, 1), (4, 1)], 0.5), ([(1, 0), (4, 0)], None)])
def test_without_both_classes(spark, docs, none, labels, high):
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = {r["score"] for r in quality.score(docs, model, "score").collect()}
    assert len(scores) == 1 and ((scores.pop() >= 0.5) == (high is not None))
    assert quality.op12_query(none, spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []


def test_long_text():
    text = "A long line of words, again; " * 200_000
    assert len(quality.features_of(text)) < 200
