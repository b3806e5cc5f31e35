"""Lines against all pairs, short ones too."""

import random

import numpy as np
from vellum.llm import lines


def edits(a, b):
    d = np.arange(len(b) + 1)
    for i, p in enumerate(a):
        e = [i + 1]
        for j, q in enumerate(b):
            e.append(min(d[j] + (p != q), d[j + 1] + 1, e[j] + 1))
        d = np.array(e)
    return d[-1]


def plain(rows):
    """Kept text of each row (k, text), given in their order."""
    first, out = {}, []
    for k, text in rows:
        for i, line in enumerate(text.split("\n")):
            first.setdefault(tuple(line.lower().split()), (k, i))
    near = {x for x in first for y in first if first[y] < first[x] and max(len(x), len(y)) >= lines.LEAST_WORDS and edits(x, y) <= 1}
    for k, text in rows:
        words = [tuple(x.lower().split()) for x in text.split("\n")]
        out.append("\n".join(x for i, (x, w) in enumerate(zip(text.split("\n"), words, strict=True)) if not w or w not in near and first[w] == (k, i)))
    return out


def test_short_lines(spark):
    rows = [(1, "Home\none two three four\n\nread more"), (2, "HOME\n\none two three four five\nread less"), (3, "one two three five\nhome page"), (4, "Read  more\nx"), (5, "a b c d e\nhome"), (6, "a b c e\na b c d")]
    rng = random.Random(8)
    rows += [(10 + i, "\n".join(" ".join(rng.choice("pqr") for _ in range(rng.randrange(8))) for _ in range(12))) for i in range(30)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["text"] for k, _ in rows] == plain(rows)
    assert got[2]["text"] == "\nread less" and got[2]["n_removed"] == 2 and got[4]["text"] == "x" and got[6]["text"] == ""
