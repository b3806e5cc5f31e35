"""Windows of a word group that stands everywhere are dealt over many buckets, with the same repeats."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import substring
from vellum.session import clear_scratch


def _texts():
    """Texts of rare words around one phrase, some of them repeated in part."""
    rng = np.random.default_rng(3)
    texts = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 60)]
        for at in (5, 25, 45):
            words[at : at + 3] = ["in", "the", "end"]
        texts.append(words)
    for i in rng.choice(140, 30, replace=False).tolist():
        texts[i + 7][:40] = texts[i][20:60]
    return [" ".join(w) for w in texts]


def _brute(texts, size):
    seen, want = set(), set()
    for k, text in enumerate(texts):
        words = text.split()
        for a in range(len(words) - size + 1):
            w = tuple(words[a : a + size])
            if w in seen:
                want.add((k, a))
            seen.add(w)
    return want


def _phrase_minimiser(texts):
    """The minimiser of most super-k-mers."""
    docs = [(k, 0, t.encode().split(), 0) for k, t in enumerate(texts)]
    return Counter(m for m, *_ in substring.super_kmers(docs, 20, 3)).most_common(1)[0]


def test_hot_windows_stand_alone():
    texts = _texts()
    docs = [(k, 0, t.encode().split(), 0) for k, t in enumerate(texts)]
    m, n = _phrase_minimiser(texts)
    plain, split = list(substring.super_kmers(docs, 20, 3)), list(substring.super_kmers(docs, 20, 3, np.array([m - 1, m, m + 10**9])))
    assert sum(x[4] for x in plain) == sum(x[4] for x in split)
    assert {x for x in plain if x[0] != m} <= set(split) and not any(x[0] == m for x in split)
    words = lambda x: x[5].split()
    where = {}
    for x in split:
        for a in range(x[4]):
            where.setdefault(tuple(words(x)[a : a + 20]), set()).add(x[0])
    assert all(len(v) == 1 for v in where.values())  # equal windows meet in one bucket
    assert max(Counter(x[0] for x in split).values()) <= 5 < n  # windows of at most a few copies


@pytest.mark.parametrize("hot_bytes", [500, 10**12])
def test_same_repeats(spark, hot_bytes):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["k"], a) for r in substring.repeats(docs, hot_bytes=hot_bytes, sampled=1).collect() for s in r["spans"] for a in range(s["start"], s["start"] + s["n"])}
    assert got == _brute(texts, 20) and len(got) > 300
    clear_scratch(spark)


def test_hot_minimisers_are_told(spark):
    texts = _texts()
    m, _ = _phrase_minimiser(texts)
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)] + [(1000, 0, None), (1001, 0, ""), (1002, 0, "few words")], "k long, t long, text string")
    told = substring.hot_minimisers(rows, 20, 3, 5000, 1)
    assert m in told and len(told) < 5
    assert not len(substring.hot_minimisers(rows, 20, 3, 10**9, 1)) and not len(substring.hot_minimisers(rows.limit(0), 20, 3, 1, 1))


def test_all_hot():
    """Every minimiser hot: all windows travel alone, and the same are told."""
    texts = _texts()[:40]
    docs = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([0] * 40, pa.int64()), pa.array(texts)], names=["k", "t", "text"])
    hot = np.unique([m for m, *_ in substring.super_kmers([(k, 0, t.encode().split(), 0) for k, t in enumerate(texts)], 20, 3)])
    shared = type("Shared", (), {"value": hot})
    sent = pa.Table.from_batches(substring._send(20, 3, 50, shared)(iter([docs]))).sort_by("bucket")
    found = [r for b in substring._count(20)(iter(sent.to_batches())) for r in b.to_pylist()]
    assert {(r["k"], a) for r in found for a in range(r["start"], r["start"] + r["n"])} == _brute(texts, 20)
