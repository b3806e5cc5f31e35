"""Similar titles of many sizes, told by parities before their words are compared, and texts read once."""

import random

import pytest

from vellum.operators import records
from vellum.plans.queries import QUERIES

DDL = "id long, words array<string>"


@pytest.mark.parametrize("least", [0.8, 0.55, 1.0])
def test_near_copies_of_every_size(spark, least):
    rng, rows = random.Random(5), []
    for size in (1, 2, 3, 4, 5, 9, 20, 63, 64, 65, 150, 300):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for edits in range(0, size // 3 + 2):
            rows.append((len(rows), [f"n{rng.randrange(9)}" if i < edits else w for i, w in enumerate(base)] + ["more"] * (edits % 2)))
    made = spark.createDataFrame(rows, DDL)
    sets = [(i, set(w)) for i, w in rows]
    theirs = sorted((i, j, round(s, 9)) for i, x in sets for j, y in sets if (s := len(x & y) / len(x | y)) >= least)
    for left, right in ((made, made), (made, made.select("id", "words"))):
        got = sorted((r[0], r[1], round(r[2], 9)) for r in records.similar_titles(left, right, least, 20).collect())
        assert got == theirs and len(got) >= len(rows)


def test_parities_come_before_words(spark):
    rows = spark.createDataFrame([(1, ["a", "b"])], DDL)
    plan = records.similar_titles(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert 0 < join.index("bit_count") < join.index("array_intersect") and "strategy=merge" in join


@pytest.mark.parametrize("name", ["title_similarity_join", "best_title_match"])
def test_texts_are_read_once(spark, sf, name):
    files = QUERIES[name](spark, sf).inputFiles()
    assert files and not any("documents" in f for f in files)
