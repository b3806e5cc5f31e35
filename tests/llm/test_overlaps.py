"""Overlaps with a benchmark against laying every item over every place of every document."""

import random

import numpy as np
import pytest

from vellum.llm import decontaminate as d


def plain(docs, items):
    """(doc, item, start, item start, tokens, equal) by trying all diagonals and all windows."""
    out = set()
    for i, text in docs:
        doc = d.tokens_of(text).tolist()
        for j, item_text in items:
            item = d.tokens_of(item_text).tolist()
            n = len(item)
            if not n or n < 4 and doc != item:
                continue
            need = min(13, n)
            least = 11 if n >= 13 else n - (n >= 8)
            best = None
            for g in range(-n + 1, len(doc)):
                at = [x for x in range(n) if 0 <= g + x < len(doc)]
                good = [x for x in at if x + need - 1 in at and sum(doc[g + y] == item[y] for y in range(x, x + need)) >= least]
                covered = sorted({y for x in good for y in range(x, x + need)})
                runs = []
                for y in covered:
                    if runs and runs[-1][-1] == y - 1:
                        runs[-1].append(y)
                    else:
                        runs.append([y])
                for r in runs:
                    e = sum(doc[g + y] == item[y] for y in r)
                    found = (-e, g + r[0], r[0], len(r))
                    best = found if best is None or found < best else best
            if best:
                out.add((i, j, best[1], best[2], best[3], -best[0]))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(j, " ".join(word() for _ in range(n))) for j, n in enumerate((2, 3, 4, 6, 8, 11, 13, 20, 40, 90))]
    items += [(20, items[7][1]), (21, None), (22, ""), (23, items[8][1] + " more")]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items[:10])[1].split()
            a = rng.randrange(len(part))
            part = part[a : a + rng.randrange(1, 60)] if rng.random() < 0.5 else part
            part = [word() if rng.random() < 0.08 else w for w in part]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((i, " ".join(words)))
    ends = [f"q{i}" for i in range(13)]
    items.append((30, " ".join(ends + [f"m{i}" for i in range(174)] + ends)))
    docs += [(70, None), (71, ""), (72, items[0][1]), (73, "x " + items[0][1]), (74, items[1][1].upper() + "!"), (75, " ".join(ends + [f"z{i}" for i in range(174)] + ends)), (76, docs[3][1]), (76, docs[3][1])]
    return docs, items


def test_runs_and_whole_query(spark, tables):
    docs, items = tables
    want = plain(docs, items)
    assert {(75, 30, 0, 0, 15, 13), (72, 0, 0, 0, 2, 2), (74, 1, 0, 0, 3, 3)} <= want and len(want) > 30
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (d.BLOCK_TOKENS, 0):
        rows = d.find_overlaps(df, bench, block).collect()
        assert {(r["doc_id"], r["item_id"], r["doc_start"], r["item_start"], r["n_tokens"], r["n_equal"]) for r in rows} == want
        assert all(abs(r["similarity"] - r["n_equal"] / r["n_tokens"]) < 1e-12 for r in rows)
        assert sum(r["doc_id"] == 76 for r in rows) == 2 * sum(w[0] == 76 for w in want)
        clash = df.selectExpr("*", "1 as k", "2 as t", "'r' as row", "doc_id as may")
        kept = d.decontaminate(clash, bench, block)
        assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in {w[0] for w in want})
        assert d.find_overlaps(df.limit(0), bench, block).count() == 0 and d.find_overlaps(df, bench.limit(0), block).count() == 0


def test_any_two_substitutions_are_seen():
    rng = np.random.default_rng(4)
    item = " ".join(f"a{i}" for i in range(13))
    index = d.SeedIndex([(1, item)])
    for _ in range(60):
        words = item.split()
        for i in rng.choice(13, 2, replace=False):
            words[i] = "other"
        assert d.overlaps_of(index, "before " + " ".join(words))[0][1:5] == (1, 0, 13, 11)
