"""Spelling variants against a plain version, word by word."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    by = {}
    for w in n:  # a word, and all that it becomes by one deletion
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(key, set()).add(w)
    met = {w: {v for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by.get(key, ()) if one_edit(v, w)} for w in n}
    form = {}
    for w, near in met.items():
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(met[w]), n.get(form[w])) for w in n), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def of(spark, docs):
    made = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(0), "key": F.lit(1)})
    return collected(variants.spelling_groups(made))


def test_whole_table_against_plain(spark):
    from vellum.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    theirs = plain(docs)
    assert collected(queries()["op13_spelling_variants"](spark, sf)) == theirs
    assert sum(r[1] is not None for r in theirs) > 20


def test_chains_ties_repeats_nulls_and_long_words(spark):
    many = lambda w, k: (w + " ") * k
    long = "ab" * 4000
    runs = ["a" * 700, "a" * 701, "a" * 350 + "b" + "a" * 350, "b" + "a" * 700, long, long[:-1], long[:100] + "c" + long[101:], "z" * 65, "z" * 64, "z" * 66]
    docs = [(2000 + i, many(w, 2)) for i, w in enumerate(runs)]
    docs += [(1, many("colours", 400) + many("colour's", 3)), (2, many("colourss", 40) + many("colorss", 2)), (3, many("Colourse", 40)), (4, many("coloursss", 4)), (5, None), (6, ""), (7, "x " * 9), (None, many("\u00c0lphabet", 20) + many("\u00e0lphabet", 2)), (None, many("alphabet", 20))]
    docs += [(8, many("abcdefg", 2)), (8, many("abcdefg", 2)), (9, many("abcdefgh", 1)), (10, many("ABCDEFGH", 21)), (11, "don\u00d7tword don\u00d7tword \u00ffwordings \u0100wordings " * 2)]
    theirs = plain(docs)
    assert of(spark, docs) == theirs
    assert any(r[1] != r[2] and r[1] for r in theirs)  # a chain of two steps at least
    assert any(len(r[0]) > 600 and r[4] for r in theirs)


def test_empty_table(spark):
    assert of(spark, []) == []
    assert of(spark, [(1, None), (2, "short words only")]) == []


def test_dense_words_of_two_letters(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice((7, 8, 9)))) for _ in range(500)}
    docs = [(i, f"{w} " * rng.choice((2, 2, 30, 400))) for i, w in enumerate(sorted(words))]
    theirs = plain(docs)
    assert of(spark, docs) == theirs
    assert max(r[4] for r in theirs) > 10


LETTERS = st.text("abc\u00e9", min_size=7, max_size=14)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.integers(0, 14), st.sampled_from(("insert", "delete", "replace")), st.sampled_from("abcx"), st.dictionaries(st.text("abcx\u00e9", min_size=2, max_size=2), st.integers(1, 3)))
def test_near_words_meet_whatever_the_frequencies(word, at, kind, letter, freq):
    at %= len(word)
    other = word[:at] + {"insert": letter + word[at:], "delete": word[at + 1 :], "replace": letter + word[at + 1 :]}[kind]
    if other == word or len(other) < 7:
        return
    (index_a, probe_a), (index_b, probe_b) = variants.meetings_of(word, freq), variants.meetings_of(other, freq)
    assert set(index_a) & set(probe_b) or set(index_b) & set(probe_a)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 12)), min_size=3, max_size=7, unique_by=lambda x: x[1]))
def test_pivots_have_the_least_sum(grams):
    prefix = [(f, "xx", i) for f, i in grams]
    sums = [f + g for f, i in grams for g, j in grams if j >= i + 2]
    chosen = variants.pivots_of(prefix)
    by = {i: f for f, i in grams}
    assert len(chosen) == 2 and chosen[1] - chosen[0] >= 2 and sum(by[i] for i in chosen) == min(sums)


@pytest.mark.parametrize("text, words", [("Abcdefg abcdefG", {"abcdefg": 2}), ("abcdef", {}), (None, {})])
def test_words(text, words):
    assert variants.words_of(3, text, drop=1 << 40) == words
