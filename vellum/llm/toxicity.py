"""Toxicity scores by weak supervision.

Terms that mark labelled toxic rows are mined from the training fold: whole
words, and word beginnings that make up a share of a text.  They are dealt
into many lexicon voters, and pattern voters look at how much of a text, of
its every other word, or how many terms at once they cover.  Labels choose the
voters and give the share of the toxic class, nothing else: a generative label
model, fitted by expectation maximisation on the votes alone, estimates how
each voter behaves under either class and how voters move together beyond what
the class explains; correlated voters share their say.  Its posterior labels
train a logistic regression, and that linear classifier scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import ship_package

SAMPLE_ROWS = 12_000
TERMS = 384
CANDIDATES = 20_000
VOTERS = 24
LEAST_SUPPORT = 5
LEAST_SHARE = 0.01
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7)
RATE = 0.01
RATES = (0.006, 0.012)
MOST_SAY = 4.0
_SPACE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACE).split()


def _frequent(counts: Counter[bytes], total: int) -> set[bytes]:
    return {b + b"%" for b, n in counts.items() if n >= 2 and n >= RATE * total}


def terms_of(text: str | None) -> set[bytes]:
    """Distinct lower-case words, and beginnings (in bytes, with a percent sign) of two words or more and of a share of RATE."""
    words = words_of(text)
    counts, starts = Counter(words), Counter()
    for w, c in counts.items():
        for n in BEGINNINGS:
            if len(w) >= n:
                starts[w[:n]] += c
    return counts.keys() | _frequent(starts, len(words))


def found_in(text: str | None, index: dict[bytes, int]) -> tuple[list[int], tuple[float, float, float]]:
    """Terms of the index in a text, and the share of its words that they cover: of all, and of every other word."""
    words = words_of(text)
    if not words:
        return [], (0.0, 0.0, 0.0)
    starts, hits, covered = Counter(), set(), set()
    for w, c in Counter(words).items():
        if w in index:
            hits.add(index[w])
            covered.add(w)
        for n in BEGINNINGS:
            if len(w) >= n and w[:n] + b"%" in index:
                starts[w[:n]] += c
                covered.add(w)
    hits.update(index[b] for b in _frequent(starts, len(words)))
    even, odd = (sum(w in covered for w in part) for part in (words[::2], words[1::2])) if covered else (0, 0)
    return sorted(hits), ((even + odd) / len(words), even / len(words[::2]), odd / max(1, len(words) // 2))


def held_out(doc_id) -> F.Column:
    """The fold that no label is learned from; a null doc_id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


@dataclass
class ToxicityModel:
    terms: list[bytes] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    rate_weights: list[float] = field(default_factory=lambda: [0.0] * len(RATES))
    bias: float = -3.0
    disagreement: float = 0.0
    accuracies: list[float] = field(default_factory=list)
    correlations: list[list[float]] = field(default_factory=list)


def _counts(kept: set[bytes] | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms_of(text)
                seen.update(found if kept is None else found & kept)
                if len(seen) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return count


def _hits(terms: list[bytes]):
    index = {t: i for i, t in enumerate(terms)}

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [found_in(x, index) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.list_(pa.int32())), pa.array([r for _, r in rows], pa.list_(pa.float64())), batch.column(1)], names=["hits", "rates", "toxic"])

    return hit


def votes_of(x: np.ndarray, rates: np.ndarray, voters: int = VOTERS) -> np.ndarray:
    """Votes 1 (toxic), 0 (abstains), -1 (clean) of the voters on rows of term hits and covered shares.

    Lexicon voters hold every voters-th term and speak only when one occurs.
    Pattern voters look at several terms at once or at the share of words that
    terms cover, in the text and in every other word, and may also vote clean.
    """
    k = min(voters, max(1, x.shape[1]))
    lexicons = [(x[:, j::k].any(1)).astype(np.int8) for j in range(k)]
    n = x.sum(1)
    patterns = [np.where(n >= 2, 1, np.where(n == 0, -1, 0)), *(np.where(r >= RATES[-1], 1, np.where(r < RATES[0], -1, 0)) for r in rates.T)]
    return np.stack([*lexicons, *patterns], 1).astype(np.int8)


def label_model(votes: np.ndarray, share: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class, each voter's accuracy where it votes, and residual correlations.

    Expectation maximisation from the votes alone.  `share` is the class prior,
    the same for all rows; it starts from the belief that voters are better
    than chance.  A voter that abstains says nothing, so a row that only one
    language's lexicons speak on is judged by those alone.
    """
    n, m = votes.shape
    base = np.log(share / (1 - share))
    balance = votes.sum(1)
    q = 1 / (1 + np.exp(-(base + 2 * np.clip(balance, -3, 3))))
    states = {v: (votes == v).astype(float) for v in (-1, 1)}
    corr = np.eye(m)
    for _ in range(rounds):
        p = {v: ((q @ s + 0.5) / (q.sum() + 1.5), ((1 - q) @ s + 0.5) / ((1 - q).sum() + 1.5)) for v, s in states.items()}
        mean = [p[1][c] - p[-1][c] for c in (0, 1)]
        rest = votes - np.outer(q, mean[0]) - np.outer(1 - q, mean[1])
        scale = rest.std(0) + 1e-9
        corr = (rest / scale).T @ (rest / scale) / n
        say = 1 / np.sqrt(np.maximum(1, np.clip(corr, 0, 1).sum(1)))
        said = sum(s * np.clip(np.log(p[v][0] / p[v][1]), -MOST_SAY, MOST_SAY) for v, s in states.items())
        q = 1 / (1 + np.exp(-np.clip(base + said @ say, -30, 30)))
    spoke = np.maximum(1e-9, (votes != 0).sum(0))
    accuracy = ((votes == 1) * q[:, None] + (votes == -1) * (1 - q[:, None])).sum(0) / spoke
    return q, accuracy, corr


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.3, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    a = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (q - p) - penalty * w)
        w += step * min(1, 5 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1])


def distinct_terms(ranked: list[tuple[float, bytes]], least: float, most: int) -> list[bytes]:
    """The strongest terms; of a word and its beginnings, or of nested beginnings, only the strongest one."""
    kept: list[bytes] = []
    held: set[bytes] = set()
    inside: set[bytes] = set()
    for s, t in ranked:
        if s < least or len(kept) == most:
            break
        base = t.removesuffix(b"%")
        parts = {base[:n] for n in BEGINNINGS if n <= len(base)}
        if not parts & held and not (t != base and base in inside):
            kept.append(t)
            if t != base:
                held.add(base)
                inside |= parts
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> ToxicityModel:
    """Learn from about sample_rows labelled rows at most, none of them held out.

    Conflicting or repeated labels of a doc_id count as their largest.  Labels
    rank the terms and give the class prior; rows are then labelled by the
    voters.  `disagreement` is the share of rows whose posterior and label
    differ.  Without labelled rows of both classes the model has no terms and
    scores low.
    """
    ship_package(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id")))
    count = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not count["t"] or count["t"] == count["n"]:
        return ToxicityModel()
    share = min(1.0, sample_rows / count["n"])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).persist()
    try:
        n_toxic = rows.where("toxic = 1").count()
        n_clean = rows.count() - n_toxic
        if not n_toxic or not n_clean:
            return ToxicityModel()
        total = lambda part, kept: part.select("text").mapInArrow(_counts(kept), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
        found = total(rows.where("toxic = 1"), None).where(F.col("n") >= max(LEAST_SUPPORT, LEAST_SHARE * n_toxic)).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()
        toxic = {bytes(r["term"]): r["n"] for r in found}
        clean = {bytes(r["term"]): r["n"] for r in total(rows.where("toxic = 0"), set(toxic)).collect()}

        def strength(t: bytes) -> float:
            a, b = toxic[t] + 0.5, clean.get(t, 0) + 0.5
            return np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1)) - 1.28 * np.sqrt(1 / a + 1 / b)

        least = np.log(THRESHOLD / (1 - THRESHOLD)) + np.log(n_clean / n_toxic)  # alone, a term must make a row toxic
        best = distinct_terms(sorted(((strength(t), t) for t in toxic), key=lambda x: (-x[0], len(x[1]), x[1])), least, terms)
        if not best:
            return ToxicityModel()
        sample = rows.mapInArrow(_hits(best), "hits array<int>, rates array<double>, toxic int").toPandas()
    finally:
        rows.unpersist()
    x, rates = np.zeros((len(sample), len(best)), np.float32), np.array(sample["rates"].tolist()).reshape(-1, 3)
    for i, hits in enumerate(sample["hits"]):
        x[i, hits] = 1
    share = n_toxic / (n_toxic + n_clean)
    q, accuracy, corr = label_model(votes_of(x, rates), share)
    weights, bias = fit_linear(np.hstack([x, rates[:, :1] >= np.array(RATES)]), q)
    apart = float(np.mean((q >= 0.5) != (sample["toxic"].to_numpy() == 1)))
    return ToxicityModel(best, [float(w) for w in weights[: len(best)]], [float(w) for w in weights[len(best) :]], bias, apart, [float(a) for a in accuracy], corr.round(4).tolist())


def score_texts(model: ToxicityModel, texts: list[str | None]) -> list[float]:
    index = {t: i for i, t in enumerate(model.terms)}
    z = []
    for t in texts:
        hits, rates = found_in(t, index)
        z.append(model.bias + sum(model.weights[i] for i in hits) + sum(w for w, r in zip(model.rate_weights, RATES, strict=True) if rates[0] >= r))
    return [float(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for v in z]


def score(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """docs with one more column, the probability that a row is toxic.

    Only text is looked at; a null or empty text gets the score of no terms.  A
    column of that name in docs is replaced.  Repeated rows score alike.
    """
    ship_package(docs.sparkSession)
    rated = F.pandas_udf(lambda s: s.__class__(score_texts(model, s.where(s.notna(), None).tolist())), "double")
    return docs.withColumn(column, rated(F.col("text").cast("string")))


def op3_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rated = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def crc_fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
