"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    raw, wanted = [0] * 10000, [0] * 10000
    for rows, counts in ((docs, raw), (((None, t) for t in target), wanted)):
        for _, text in rows:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    s, t = sum(raw), sum(wanted)
    gain = [math.floor(1000 * math.log((b + 1) * (s + 10000) / ((a + 1) * (t + 10000)))) for a, b in zip(raw, wanted)]
    out = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = math.floor(sum(gain[bucket(f)] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {}
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        rank.setdefault(r, []).append(i + 1)
    return sorted((*r[:4], rank[r].pop(0) if rank.get(r) else None) for r in out if r[0] is not None) + sorted((*r[:4], rank[r].pop(0) if rank.get(r) else None) for r in out if r[0] is None)


def collected(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(rows, key=key)


def same(spark, docs, target):
    made = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"place": F.lit("x"), "_block": F.lit(0), "score": F.lit("s"), "bucket": F.lit(1)})
    mine = collected(resample.resample(made, spark.createDataFrame([(t,) for t in target], "text string")))
    theirs = sorted(plain(docs, target), key=lambda r: tuple((x is None, x or 0) for x in r))
    assert mine == theirs
    return mine


def test_whole_tables_against_plain(spark, sf):
    from vellum.llm.queries import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    mine = collected(queries()["op11_importance_resampling"](spark, sf))
    assert mine == sorted(plain(docs, target), key=lambda r: tuple((x is None, x or 0) for x in r))
    assert sum(r[4] is not None for r in mine) > 20


def test_nulls_ties_repeats_and_long_texts(spark):
    long = " ".join(f"W{i % 911} \u00e9t\u00e9{i % 7}" for i in range(120_000))
    twenty = " ".join(f"word{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, "One, TWO;three"), (4, long), (5, twenty), (5, twenty), (5, twenty + " more of it"), (None, twenty), (None, twenty), (None, twenty + " tail"), (-9, twenty), (7, "\x00\x7f[]"), (8, twenty + " word0"), (9, "x" * 100_000)]
    docs += [(100 + i, twenty.replace("word1", f"w{i % 5}")) for i in range(60)]
    mine = same(spark, docs, ["word1 word2", None, "One two"])
    assert [r[4] for r in mine if r[4] is not None and r[0] is not None]


def test_empty_tables(spark):
    assert same(spark, [], ["a b"]) == []
    assert same(spark, [(1, "a b")], []) == [(1, 3, -693, resample.noise(1) - 693, None)]  # floor(1000 ln(10003 / 20000))


def test_radix_sort_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-5000, 5000, 6000), rng.choice([-(1 << 63), -3, 0, 9, (1 << 63) - 1], 6000)))]
    rows += [(7, 9, 6000 + i) for i in range(3000)]  # one key holds a third of all rows
    made = spark.createDataFrame(rows, "a long, b long, i long").repartition(7)
    got = sorted((r["place"], r["a"], r["b"], r["i"]) for r in resample.radix_sorted(made, [("a", True), ("b", False), ("i", True)], bits=9, largest=500).collect())
    assert [r[0] for r in got] == list(range(len(rows)))
    assert [r[1:] for r in got] == sorted(rows, key=lambda r: (-r[0], r[1], -r[2]))


def test_steps_of_long_texts_meet():
    words = [b"w%d" % (i % 13) for i in range(2 * resample.STEP + 5)]
    whole = np.concatenate(list(resample.buckets_of(words)))
    pairs = [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(words, words[1:])]
    assert sorted(whole.tolist()) == sorted([zlib.crc32(w) % 10000 for w in words] + pairs)
