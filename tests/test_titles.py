"""Similar and best titles against all pairs, with words that most titles share dealt over many tasks."""

import random

import pytest

from vellum.operators import records

DDL = "id long, words array<string>"


def jaccard(a, b):
    a, b = set(a or ()), set(b or ())
    return len(a & b) / len(a | b) if a | b else 0.0


def made(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        base = [f"hot{rng.randrange(4)}" for _ in range(rng.randrange(1, 5))] + [f"w{rng.randrange(30)}" for _ in range(rng.randrange(9))]
        rows += [(3 * i, base), (3 * i + 1, base + ["more"] * rng.randrange(3)), (3 * i + 2, base[1:] + [f"x{rng.randrange(5)}"])]
    return [*rows, (9000, []), (9001, None), (9002, ["hot0"]), (9003, ["hot0"])]


@pytest.mark.parametrize(("least", "word_rows"), [(0.8, 4096), (0.8, 7), (0.5, 20)])
def test_against_all_pairs(spark, least, word_rows):
    left, right = made(1), [(i + 1, w) for i, w in made(2)]
    a, b = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)
    got = sorted((r["left_id"], r["right_id"], round(r["similarity"], 9)) for r in records.similar_titles(a, b, least, word_rows).collect())
    theirs = sorted((i, j, round(s, 9)) for i, x in left for j, y in right if (s := jaccard(x, y)) >= least)
    assert got == theirs and len(got) == len({g[:2] for g in got})
    best = {r["id"]: (r["best"], r["similarity"]) for r in records.best_titles(a, b, least, word_rows).collect()}
    assert len(best) == len(left)
    for i, x in left:
        s, j = max(((jaccard(x, y), -j) for j, y in right), default=(0, 0))
        assert best[i] == ((-j, pytest.approx(s)) if s >= least else (None, None))
    assert records.best_titles(a, b.limit(0)).where("best is not null").count() == 0


def test_a_hot_word_is_dealt(spark):
    rows = spark.createDataFrame([(i, ["hot"]) for i in range(100)], DDL)
    pairs = records.similar_titles(rows, rows, 0.8, 16)
    assert pairs.count() == 100 * 100
    assert "part" in pairs._jdf.queryExecution().optimizedPlan().toString()
