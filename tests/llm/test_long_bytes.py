"""Byte repeats against counting all windows: texts beyond a step, hot anchors, bytes that hold zeros."""

from collections import Counter

import numpy as np

from vellum.llm import suffix


def plain_gone(data: dict, size: int) -> dict:
    """Removed bytes of each text: windows are numbered by rank doubling over all texts, so long texts cost little."""
    keys = list(data)
    whole = np.concatenate([np.append(np.frombuffer(data[k], np.uint8).astype(np.int64) + 1, -1 - i) for i, k in enumerate(keys)])
    rank, have = np.unique(whole, return_inverse=True)[1], 1
    while have < size:
        step = min(have, size - have)
        pair = np.stack([rank, np.append(rank[step:], np.full(step, -1))], 1)
        rank, have = np.unique(pair, axis=0, return_inverse=True)[1].ravel(), have + step
    many = np.bincount(rank)[rank] > 1
    out, at = {}, 0
    for k in keys:
        n = len(data[k])
        edge = np.zeros(n + size + 1, int)
        for a in np.flatnonzero(many[at : at + max(0, n - size + 1)]):
            edge[a] += 1
            edge[a + size] -= 1
        out[k] = (np.cumsum(edge)[:n] > 0).sum()
        at += n + 1
    return out


def removed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, {r["doc_id"]: r["n_removed"] for r in suffix.dedup_bytes(df, **how).collect()}


def test_texts_longer_than_a_step(spark):
    rng = np.random.default_rng(1)
    letters = lambda n: "".join(rng.choice(list("abcdefgh \n"), n))
    long_, other = letters(1_300_000), letters(700_000)
    passage = long_[499_900:500_400]
    rows = [(1, long_[:1_200_000] + long_[30_000:30_450] + long_[1_200_000:]), (2, other[:650_000] + passage + other[650_000:]), (3, long_[900_000:900_199]), (4, "é" * 150 + passage[:230] + "x" + passage[231:]), (5, None)]
    _, got = removed(spark, rows)
    assert got == plain_gone({i: (t or "").encode() for i, t in rows}, suffix.SIZE)
    assert got[1] >= 900 + 500 and got[2] >= 500 and got[3] == 0 and got[4] > 0


def test_hot_anchors_are_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    core = "the common phrase of all"
    rows = []
    for i in range(120):
        a, b = (["".join(rng.choice(list("ab"), 9)) for _ in range(2)] for _ in range(2))
        rows.append((i, a[i % 2][:8] + "." + "xyz"[i % 3] * (i % 7) + core + "uvw"[i % 3] * (i % 5) + b[0]))
    want = plain_gone({i: t.encode() for i, t in rows}, 30)
    for hot in (1, 10**6):
        monkeypatch.setattr(suffix.dedup_bytes, "__defaults__", (30, 8))
        monkeypatch.setattr(suffix.repeats, "__defaults__", (30, 8, hot))
        _, got = removed(spark, rows)
        assert got == want and 0 < sum(v > 0 for v in got.values())


def test_contexts_keep_every_common_window():
    rng = np.random.default_rng(3)
    size, gram = 20, 4
    for _ in range(300):
        core = bytes(rng.integers(97, 100, 60).tolist())
        at = 28
        parts = []
        for _ in range(2):
            a, b = int(rng.integers(10, 26)), int(rng.integers(34, 50))
            p = bytearray(core[a:b])
            q = int(rng.integers(0, len(p)))
            if not at - a <= q < at - a + gram:
                p[q] = 0
            parts.append((bytes(p), at - a))
        (p, i), (q, j) = parts
        common = any(0 <= s - i + j and q[s - i + j :][:size] == p[s : s + size] and s <= i and s + size >= i + gram for s in range(len(p) - size + 1))
        if common:
            assert set(suffix.contexts(p, i, size, gram)) & set(suffix.contexts(q, j, size, gram))


def test_zero_bytes(spark):
    rows = [(1, "a\x00" * 130 + "left"), (2, "right" + "a\x00" * 130), (3, "\x00" * 199), (4, "b" + "\x00" * 200), (5, "\x00" * 200 + "c")]
    _, got = removed(spark, rows)
    assert got == plain_gone({i: t.encode() for i, t in rows}, suffix.SIZE) and Counter(got.values())[0] == 1
