"""Rows without a doc_id of their own: other texts are other documents."""

from collections import Counter

import pytest

from vellum.llm import lines, substring, suffix

LONG = "\n".join(f"this is line number {i} of {i * i} here" for i in range(30))
OTHER = "\n".join(f"quite another text {i} with {i * 7} words inside" for i in range(30))
TAIL = "\n".join(OTHER.split("\n")[:20]) + "\nand its end"


@pytest.fixture(params=[None, 7])
def rows(spark, request):
    i = request.param
    return i, spark.createDataFrame([(1, LONG), (i, "x\n" + LONG), (i, OTHER), (i, OTHER), (i, None), (i, "short"), (9 if i else None, TAIL)], "doc_id long, text string")


def test_lines(rows):
    i, df = rows
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect())
    kept = Counter({(1, LONG, 0): 1, (i, "x", 30): 1, (i, None, 0): 1, (i, "short", 0): 1})
    assert not kept - got and got.total() == 7
    if i:
        assert got == kept + Counter({(i, OTHER, 0): 2, (9, "and its end", 20): 1})
    else:
        rest = Counter({(n, got[n]) for n in got - kept})
        assert rest in (Counter([((None, OTHER, 0), 2), ((None, "and its end", 20), 1)]), Counter([((None, "\n".join(OTHER.split("\n")[20:]), 20), 2), ((None, TAIL, 0), 1)]))


def test_words(rows):
    i, df = rows
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.op5_query(df).collect())
    n, m = len(LONG.split()), len(OTHER.split())
    assert got[1, n, 0] == 1 and got[i, n + 1, n] == 1 and got[i, 0, 0] == 1 and got[i, 1, 0] == 1
    shared = len(TAIL.split()) - 3
    both = Counter({(i, m, 0): 2, (9 if i else None, shared + 3, shared): 1})
    assert got.total() == 7 and (not both - got or not i and got[None, m, shared] == 2 and got[None, shared + 3, 0] == 1)


def test_bytes(rows):
    i, df = rows
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.op8_query(df).collect())
    n = len(LONG)
    assert got == Counter({(1, n, n): 1, (i, n + 2, n): 1, (i, len(OTHER), len(OTHER)): 2, (i, 0, 0): 1, (i, 5, 0): 1, (9 if i else None, len(TAIL), len(TAIL) - 11): 1})
