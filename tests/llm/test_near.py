"""Near copies against all pairs."""

import random

import corpus_pipeline
import numpy as np
from vellum.llm import near
from vellum.session import table


def plain_kept(rows):
    sets = [near.shingle_set(near.normal(t)) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near.alike(sets[i], sets[j], (4, 5)):
                part = [part[j] if p == part[i] else p for p in part]
    least = {}
    for (i, _), p in zip(rows, part, strict=True):
        least[p] = min(i, least.get(p, i))
    return sorted(least.values())


def test_copies_of_similarity_08_go(spark):
    rng, rows = random.Random(4), []
    for g in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((12, 60, 200, 900)))]
        for _ in range(4):
            copy = list(base)
            for _ in range(max(1, len(base) * rng.randrange(5) // 200)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "a b"), (901, "A  b"), (902, "a c"), (903, None), (904, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert kept == plain_kept(rows) and len(kept) < len(rows) - 40


def test_rows_without_own_id(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (7, one + " x"), (7, two), (None, one + " y"), (None, "other words"), (None, "other words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in near.drop_near_copies(df).collect()}
    assert got == {(1, one), (7, two), (None, "other words"), (None, None)} and near.drop_near_copies(df).count() == 4
    assert near.drop_near_copies(df.limit(0)).count() == 0


def test_hot_bucket_keeps_every_pair(spark, monkeypatch):
    """All texts in one bucket: pairs that are not alike to its least text are still found."""
    monkeypatch.setattr(near, "signature", lambda data, size=5: (len(near.shingle_set(data)), [1]))
    rows = [(i, " ".join(f"{i % 10}w{j}" for j in range(40)) + f" e{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.drop_near_copies(df).collect()) == list(range(10))


def test_units_of_chunks_find_what_one_unit_finds(spark, monkeypatch):
    """A band of chains on both sides of 0.8, dealt in many chunks; no pair makes a row."""
    monkeypatch.setattr(near, "CHUNK", 7)
    rng, rows = random.Random(6), []
    words = [f"w{i}" for i in range(60)]
    for i in range(90):
        words = list(words)
        if i % 9 == 0:
            words = [f"g{i}_{j}" for j in range(60)]
        words[rng.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near, "signature", lambda data, size=5: (len(near.shingle_set(data)), [1, 2]))
    kept = sorted(r["doc_id"] for r in near.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == plain_kept(rows) and 10 <= len(kept) < 60


def test_units_compare_a_pair_in_its_first_band_only():
    h = np.arange(10, dtype=np.uint64)
    rows = [(1, 1, h, [5, 6]), (2, 2, h, [4, 6]), (3, 3, h, [5, 6]), (4, 3, h + 100, [5, 6])]
    assert near.unit_links(5, rows, [], (4, 5)) == [(1, 3)]
    assert near.unit_links(6, rows, [], (4, 5)) == [(1, 2), (2, 3)]  # 1 and 3 have met in band 5
    assert near.unit_links(6, rows[:1], rows[1:], (4, 5)) == [(1, 2)]


def test_simhash_groups_propose(spark, monkeypatch):
    """No two texts share a band: what SimHash links within three bits is found, and then judged by exact sets."""
    monkeypatch.setattr(near, "signature", lambda data, size=5: (len(near.shingle_set(data)), [hash(data)]))
    base = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(base[: 40 * i] + [f"v{i}"] + base[40 * i + 1 :])) for i in range(8)] + [(20, " ".join(f"u{i}" for i in range(300))), (21, None), (22, "")]
    fps = [near.fingerprint(t, 5) for _, t in rows[:8]]
    assert all(any(bin(f ^ g).count("1") <= 3 for g in fps if g is not f) for f in fps)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.drop_near_copies(df).collect()) == [0, 20, 21]
    # all fingerprints are equal and no sets are alike: SimHash alone decides nothing
    monkeypatch.setattr(near, "fingerprint", lambda text, size: 7)
    odd = spark.createDataFrame([(i, " ".join(f"x{i}_{j}" for j in range(30))) for i in range(20)], "doc_id long, text string")
    assert near.drop_near_copies(odd).count() == 20
