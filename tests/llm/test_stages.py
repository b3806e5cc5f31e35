"""Stages of the pipeline on rows with nulls, ties, repeats and clashing names, and run() against plain versions stage by stage."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline as p
import numpy as np
import pytest
from llm_fixture import DDL, DOCS

from vellum.llm import decontaminate, lines, near, packing, tokens, toxicity
from vellum.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    names = ("row", "k", "t", "toxicity", "n_removed", "n_lines", "gone", "may", "h1", "found", "wanted")
    rows = [(None, None), (None, "some words of a row without an id"), (20, "tied text of two rows"), (20, "tied text of two rows"), (21, "tied text of two rows")]
    base = spark.createDataFrame(DOCS + [(i, t, None, None, None) for i, t in rows], DDL)
    return base.withColumns({n: F.lit(f"own {n}") for n in names})


def test_odd_rows_pass_every_stage(spark, odd):
    docs = odd
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == odd.columns, name
        kept = out.collect()
        assert all(r[n] == f"own {n}" for r in kept for n in odd.columns if n not in DDL.replace(",", "").split()), name
        assert stage(spark, odd.limit(0), SF).count() == 0
        docs = spark.createDataFrame(kept, odd.schema)
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert (1, DOCS[0][1]) in texts and (2, None) in texts and (20, "tied text of two rows") in texts
    assert not any(i == 21 for i, _ in texts) and len(p.STAGES[-1][1](spark, odd, SF).select("doc_id").distinct().collect()) == len({r[0] for r in DOCS} | {20, 21})


def plain_lines(rows):
    first, out = {}, []
    for k, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if w := tuple(line.lower().split()):
                first.setdefault(w, (k, i))
    variants = defaultdict(list)
    for w in first:
        if len(w) >= lines.LEAST_WORDS - 1:
            for x in [w, *(w[:i] + ("",) + w[i + 1 :] for i in range(len(w))), *(w[:i] + w[i + 1 :] for i in range(len(w)))]:
                variants[x].append(w)
    near_ = set()
    for group in variants.values():
        for w in group:
            if any(first[v] < first[w] and max(len(v), len(w)) >= lines.LEAST_WORDS and lines.one_edit(" ".join(v), " ".join(w)) for v in group if v != w):
                near_.add(w)
    for k, text in rows:
        kept = [x for i, x in enumerate((text or "").split("\n")) if not (w := tuple(x.lower().split())) or w not in near_ and first[w] == (k, i)]
        out.append((k, text if text is None else "\n".join(kept), len((text or "").split("\n")) - len(kept)))
    return out


def test_run_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    rows = [r for r, s in zip(rows, toxicity.score_texts(model, [t for _, t in rows]), strict=True) if s < toxicity.THRESHOLD]
    rows = [(k, t) for k, t, n in plain_lines(rows) if n == 0 or t.strip(" ")]
    sets, kept, group = [near.shingle_set(near.normal(t)) for _, t in rows], [], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near.alike(sets[i], sets[j], (4, 5)):
                group = [group[j] if g == group[i] else g for g in group]
    seen = set()
    for r, g in zip(rows, group, strict=True):
        if g not in seen:
            seen.add(g)
            kept.append(r)
    items = [decontaminate.tokens_of(r["text"]).tolist() for r in table(spark, SF, "benchmark").collect()]

    def overlaps(text):
        doc = decontaminate.tokens_of(text).tolist()
        windows = defaultdict(list)
        for n in range(max(0, len(doc) - 3)):
            windows[tuple(doc[n : n + 4])].append(n)  # 11 equal ones of 13 hold four in a row
        for item in items:
            need, least = decontaminate.least_equal(len(item))
            for g in {n - i for i in range(len(item) - 3) for n in windows.get(tuple(item[i : i + 4]), ())}:
                if decontaminate.judge(np.array(doc, np.uint64), np.array(item, np.uint64), g):
                    return True
        return False

    kept = [r for r in kept if not overlaps(r[1])]
    encode = tokens.Encoder(tokens.default_path())
    ids = {k: np.append(np.frombuffer(b, "<u4"), np.uint32(1)) for (k, _), b in zip(kept, encode.encode([t for _, t in kept]), strict=True)}
    got = defaultdict(dict)
    for r in p.run(spark, SF).collect():
        got[r["doc_id"]][r["start"]] = bytes(r["ids"])
    assert got.keys() == ids.keys()
    assert all(zlib.crc32(b"".join(got[k][s] for s in sorted(got[k]))) == zlib.crc32(ids[k].astype("<u4").tobytes()) for k in ids)
    assert re.match("toxicity", p.STAGES[0][0]) and packing.WINDOW == 2048
