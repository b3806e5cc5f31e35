"""Quality scores by a support vector machine on naive Bayes features.

A text's features say which n-grams occur in it: words with their marks, pairs
of neighbours, runs of word shapes (which letters are large, which marks stand
where), and the same for what makes up a share of a text.  Each is hashed to
one of a fixed number of buckets.  The log ratio of a bucket's smoothed counts
in good and bad texts scales its indicator; a linear model with hinge loss is
then fitted on the scaled indicators by dual coordinate descent, and drawn
towards its own mean weight.  A logistic curve over margins of rows that a fit
did not see turns margins into probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import ship_package

SAMPLE_ROWS = 12_000
BUCKETS = 1 << 18
THRESHOLD = 0.3
FOLDS = 5
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
BLEND = 0.25  # how far weights are drawn towards their mean
SHARES = (0.02, 0.1, 0.4)
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256))
_MARK = ~np.isin(np.arange(256), np.frombuffer(b"aA0 ", np.uint8))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id) -> F.Column:
    """The fold that no label is learned from; a null doc_id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def shapes_of(data: bytes) -> list[bytes]:
    """The words of a text as shapes: letters, digits and marks, a run of one kind once (of a mark, twice)."""
    kinds = np.frombuffer(data.translate(_SHAPE), np.uint8)
    kept = np.ones(len(kinds), bool)
    kept[1:] = kinds[1:] != kinds[:-1]
    kept[2:] |= _MARK[kinds[2:]] & (kinds[2:] != kinds[:-2])
    kept[1:2] |= _MARK[kinds[1:2]]
    return kinds[kept].tobytes().split()


def _checksums(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, parts), np.uint64, len(parts))


def _joined(*parts: np.ndarray | int) -> np.ndarray:
    """One number from several, in their order."""
    h = np.zeros(1, np.uint64)
    for x in parts:
        h = (h ^ np.asarray(x, np.uint64)) * _ODD
        h ^= h >> np.uint64(29)
    return h


def features_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The distinct buckets of a text's n-grams.  Bucket 0 is that of every text."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    w, s = _checksums(words), _checksums(shapes_of(data))
    pairs = np.fromiter(map(zlib.crc32, [b" " + x for x in words[1:]], w.tolist()), np.uint64, max(0, len(words) - 1))
    seen, n = np.unique(np.concatenate([_joined(0, w), _joined(1, s), _joined(2, s[:-1], s[1:]), _joined(3, s[:-2], s[1:-1], s[2:])]), return_counts=True)
    often = [_joined(4 + k, seen[(n > 1) & (n >= share * len(s))]) for k, share in enumerate(SHARES)]
    size = _joined(9, len(words).bit_length(), 4 * len(seen) // max(1, len(words)))
    found = np.concatenate([seen, _joined(8, pairs), *often, size])
    return np.append(np.unique((found % np.uint64(buckets - 1)).astype(np.int64) + 1), 0)


@dataclass
class QualityModel:
    """weights of the plain indicators (log-count ratios included), divided by the root of how many a text has."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    slope: float = 1.0
    offset: float = 0.0


def log_ratios(rows: list[np.ndarray], good: np.ndarray, buckets: int) -> np.ndarray:
    """ln of the smoothed shares of each bucket in good and bad rows, one to the other."""
    p, q = (SMOOTHING + np.bincount(np.concatenate(_where(rows, kind)), minlength=buckets) for kind in (good, ~good))
    return np.log((p / p.sum()) / (q / q.sum()))


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, buckets: int, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights of least norm and hinge loss, by dual coordinate descent (Hsieh et al., 2008).

    Each row has one dual variable between zero and its cost; a step sets it to
    the best value with all others fixed and moves the weights along.
    """
    w, dual = np.zeros(buckets), np.zeros(len(rows))
    norms = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            if not norms[i]:
                continue
            slack = signs[i] * float(w[rows[i]] @ values[i]) - 1
            step = min(max(dual[i] - slack / norms[i], 0.0), costs[i]) - dual[i]
            if step:
                dual[i] += step
                w[rows[i]] += step * signs[i] * values[i]
                worst = max(worst, abs(step) * norms[i])
        if worst < 1e-3:
            break
    return w


def _fit(rows: list[np.ndarray], good: np.ndarray, buckets: int) -> np.ndarray:
    ratio = log_ratios(rows, good, buckets)
    ratio[0] = 1.0
    values = [ratio[r] / np.sqrt(len(r)) for r in rows]
    share = max(1e-6, min(1 - 1e-6, good.mean()))
    costs = COST * np.where(good, 0.5 / share, 0.5 / (1 - share))
    w = fit_hinge(rows, values, np.where(good, 1.0, -1.0), costs, buckets)
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    return ((1 - BLEND) * mean + BLEND * w) * ratio


def margins(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([float(weights[r].sum()) / np.sqrt(len(r)) for r in rows])


def fit_curve(m: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps; targets are smoothed by the class sizes."""
    n1, n0 = good.sum(), (~good).sum()
    y = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([m, np.ones(len(m))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += step * min(1, 5 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(w[1])


def learn(rows: list[np.ndarray], good: np.ndarray, buckets: int = BUCKETS, parts: int = 5) -> QualityModel:
    """A model from feature rows and their labels.

    The curve is fitted on margins of rows that their fit left out.  With one
    class only, or without rows, the model gives one half plus what the classes'
    share says.
    """
    good = np.asarray(good, bool)
    if not len(rows) or good.all() or not good.any():
        n1 = int(good.sum())
        return QualityModel(np.zeros(buckets, np.float32), 1.0, float(np.log((n1 + 1) / (len(rows) - n1 + 1))))
    part = np.random.default_rng(11).permutation(len(rows)) % parts
    m, tried = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for p in range(2 if len(rows) > 4000 else parts):
        apart = part == p
        if good[~apart].any() and not good[~apart].all():
            m[apart] = margins(_fit(_where(rows, ~apart), good[~apart], buckets), _where(rows, apart))
            tried |= apart
    slope, offset = fit_curve(m[tried], good[tried])
    return QualityModel(_fit(rows, good, buckets).astype(np.float32), slope, offset)


def _where(rows: list[np.ndarray], kept: np.ndarray) -> list[np.ndarray]:
    return [r for r, k in zip(rows, kept.tolist(), strict=True) if k]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> QualityModel:
    """Learn from about sample_rows labelled rows at most, none of them held out.

    Conflicting or repeated labels of a doc_id count as their smallest, and of
    equal texts one counts, with the smallest label.  The labels of the sample
    are broadcast (their number is bounded by sample_rows) and the sample's
    features come to the driver.
    """
    ship_package(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality")).where(~held_out(F.col("doc_id")))
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t, buckets).astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["features", "quality"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("quality").alias("quality"))
    sample = rows.mapInArrow(found, "features array<int>, quality int").toArrow().combine_chunks()
    features = sample["features"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    edges, flat = features.offsets.to_numpy(), features.values.to_numpy()
    listed = [flat[a:b].astype(np.int64) for a, b in pairwise(edges.tolist())]
    order = sorted(range(len(listed)), key=lambda i: (len(listed[i]), zlib.crc32(listed[i].tobytes())))  # the same fit whatever the order of arrival
    good = sample["quality"].to_numpy() >= 1
    return learn([listed[i] for i in order], good[order] if len(order) else good, buckets)


def score_text(weights: np.ndarray, slope: float, offset: float, text: str | None) -> float:
    found = features_of(text, len(weights))
    z = slope * float(weights[found].sum(dtype=np.float64)) / np.sqrt(len(found)) + offset
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: QualityModel, column: str = "quality") -> DataFrame:
    """docs with one more column, the probability that a row is good.

    Only text is looked at; a null text scores as an empty one.  A column of
    that name in docs is replaced.  Repeated rows score alike.
    """
    ship_package(docs.sparkSession)
    weights, slope, offset = docs.sparkSession.sparkContext.broadcast(model.weights), model.slope, model.offset  # a fixed number of weights
    rated = F.pandas_udf(lambda s: s.__class__([score_text(weights.value, slope, offset, t) for t in s.where(s.notna(), None)], dtype="float64"), "double")
    return docs.withColumn(column, rated(F.col("text").cast("string")))


def op12_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rated = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
