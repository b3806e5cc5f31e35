"""Grouping spelling variants: words one edit apart, found by pivotal grams.

Grams are pairs of neighbouring code points, in a global order from rare to
frequent.  A word's prefix is its first grams of that order, one more than two
for each edit; among them dynamic programming chooses disjoint pivots, one more
than the edits, with the least total frequency.  Edits can't touch all pivots,
so a near word holds one of them, and it is in the prefix of the near word or
the same holds with both words exchanged.  Pivots of all words are therefore
looked up among the prefix grams of all others.

Position limits make the meeting sharp.  One edit stands before or behind a
gram that it leaves alone, so either all that comes up to the gram is equal in
both words and the gram is at the same place, or all from the gram on is and
its place moves with the difference in length.  The rest, which holds the edit,
is equal in its first or its last half.  The key of a meeting is the equal part,
the half, the side and the length; what meets is then verified.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.keyed import join_some
from vellum.session import cut, ship_package

EDITS = 1
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
DROP = 31
HELD_WORDS = 200_000
LONG_WORD = 64
MOST_STEPS = 64
LETTERS = "A-Za-zÀ-ÿ"
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


def words_of(doc_id: int | None, text: str | None, least: int = LEAST_LETTERS, drop: int = DROP) -> Counter[str]:
    """Counts of a document's words: runs of letters, A-Z in lower case, some of them with one letter left out.

    A null doc_id is written as nothing in the hash that decides on a letter.
    """
    runs = re.findall(f"[{LETTERS}]{{{least},}}", text or "")
    counts: Counter[str] = Counter()
    for run, n in Counter(b" ".join(r.encode() for r in runs).lower().decode().split(" ") if runs else ()).items():
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        word = run if h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(word) >= least:
            counts[word] += n
    return counts


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """(word, n) of the words of all rows of docs (doc_id, text) with least_count occurrences or more."""
    ship_package(docs.sparkSession)

    def sent(seen: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(words_of(doc_id, text, least, drop))
                if len(seen) > HELD_WORDS:
                    yield sent(seen)
                    seen.clear()
        yield sent(seen)

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def prefix_of(word: str, freq: dict[str, int], edits: int = EDITS) -> list[tuple[int, str, int]]:
    """(frequency, gram, place) of the word's first 2 * edits + 1 grams, with all that equal the last of them."""
    grams = sorted((freq.get(word[i : i + 2], 0), word[i : i + 2], i) for i in range(len(word) - 1))
    last = grams[min(2 * edits, len(grams) - 1)][:2]
    return [g for g in grams if g[:2] <= last]


def pivots_of(prefix: list[tuple[int, str, int]], edits: int = EDITS) -> list[int]:
    """Places of edits + 1 disjoint grams of the prefix with the least total frequency.

    Row k of the table has, for grams in the order of their places, the least
    sum of k grams up to there; a gram follows those that end before it.
    """
    grams = sorted((i, f) for f, _, i in prefix)
    best: list[tuple[int, tuple[int, ...]] | None] = [(0, ())] * (len(grams) + 1)
    before = [max((j + 1 for j in range(max(0, k - 2), k) if grams[j][0] + 2 <= grams[k][0]), default=max(0, k - 2)) for k in range(len(grams))]
    for _ in range(edits + 1):
        row: list[tuple[int, tuple[int, ...]] | None] = [None]
        for k, (place, f) in enumerate(grams):
            rest = best[before[k]]
            taken = None if rest is None else (rest[0] + f, (*rest[1], place))
            row.append(min((x for x in (row[-1], taken) if x is not None), default=None))
        best = row
    return list(best[-1][1]) if best[-1] else []


class _Parts:
    """Hashes of any part of a word, by powers of one base, so that words of any length take time in proportion."""

    powers = [1]

    def __init__(self, word: str):
        h, self.sums = 0, [0]
        for c in word:
            h = (h * _BASE + ord(c)) % _PRIME
            self.sums.append(h)
        while len(self.powers) <= len(word):
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def __call__(self, start: int, end: int) -> int:
        return (self.sums[end] - self.sums[start] * self.powers[end - start]) % _PRIME


def _keys(part: _Parts, n: int, before: bool, place: int, length: int) -> list[int]:
    """Meeting keys of a word of n letters, a gram at `place`, and an edit before or behind it, with indexed words of `length`.

    Half of the indexed word's rest, less one letter, is equal at one end of the
    rest or at the other.
    """
    equal, start, end = (part(place, n), 0, place) if before else (part(0, place + 2), place + 2, n)
    half = (end - start + length - n - 1) // 2
    if half <= 0:
        return [hash((before, length, equal))] if end - start + length - n >= 0 else []
    return [hash((before, length, equal, 0, part(start, start + half))), hash((before, length, equal, 1, part(end - half, end)))]


def meetings_of(word: str, freq: dict[str, int]) -> tuple[list[int], list[int]]:
    """(index keys, probe keys) of a word: of its prefix grams, and of its pivots for words up to an edit longer or shorter.

    An edit that touches the second pivot or comes after it is behind the first;
    any other one is before the second.
    """
    prefix, part, n = prefix_of(word, freq), _Parts(word), len(word)
    index = {k for _, _, i in prefix for before in (False, True) for k in _keys(part, n, before, i, n)}
    first, second = pivots_of(prefix)
    probe = {k for before, i in ((False, first), (True, second)) for d in (-EDITS, 0, EDITS) for k in _keys(part, n, before, i, n + d)}
    return list(index), list(probe)


def _named(word: str) -> str:
    """A short word itself, or a digest of a long one behind a sign that no word has."""
    return word if len(word) <= LONG_WORD else "#" + hashlib.sha256(word.encode()).hexdigest()


def _met(freq: dict[str, int]):
    schema = pa.schema([("name", pa.string()), ("key", pa.int64()), ("probe", pa.bool_())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, probes = [], [], []
        for batch in batches:
            for word in batch.column(0).to_pylist():
                index, probe = meetings_of(word, freq)
                names += [_named(word)] * (len(index) + len(probe))
                keys += index + probe
                probes += [False] * len(index) + [True] * len(probe)
                if len(keys) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(keys, pa.int64()), pa.array(probes)], schema=schema)
                    names, keys, probes = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.int64()), pa.array(probes, pa.bool_())], schema=schema)

    return meet


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each gram occurs; the letters are few (about 8,000 pairs), however many words there are."""
    ship_package(words.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                seen.update({a + b for a, b in pairwise(word)})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])

    return {r["gram"]: r["n"] for r in words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of words (word; distinct, of letters) that differ by one inserted, deleted or replaced code point."""
    freq = gram_counts(words)
    met = cut(words.select("word").mapInArrow(_met(freq), "name string, key long, probe boolean"), "pivots")
    index = met.where("not probe").select("key", F.col("name").alias("right"))
    probe = met.where("probe").select("key", F.col("name").alias("left"))
    whole = ~F.col("left").startswith("#") & ~F.col("right").startswith("#")
    near = F.when(whole, F.levenshtein("left", "right", EDITS) == 1).otherwise(F.col("left") != F.col("right"))
    pairs = probe.join(index, "key").where(near).select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct()
    pairs = cut(pairs, "near-words")
    digests = F.concat(F.lit("#"), F.sha2(F.encode("word", "utf-8"), 256))
    long = words.where(F.length("word") > LONG_WORD).select(digests.alias("name"), F.col("word").alias("full"))
    short = pairs.where(~F.col("a").startswith("#") & ~F.col("b").startswith("#"))
    rest = pairs.where(F.col("a").startswith("#") | F.col("b").startswith("#"))
    for side in ("a", "b"):
        full = long.select(F.col("name").alias(side), "full")
        rest = join_some(rest, full, side).withColumn(side, F.coalesce("full", side)).drop("full")
    rest = rest.where(F.levenshtein("a", "b", EDITS) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return short.unionByName(rest)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chains of forms (word, form) end.  Chains have no circles; each round doubles the steps."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_STEPS.bit_length()):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = cut(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if now.where("_moved").isEmpty():
            break
        now = now.drop("_moved")
    return now.select("word", "root")


def spelling_groups(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text).

    form is the near word of largest n, the first in code-point order of equal
    ones, if it is ratio times as frequent; root is where the forms lead to, the
    word itself without one.  Null and empty texts have no words; repeated rows
    count again; an empty table gives an empty result.
    """
    words = cut(word_counts(docs), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    rated = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    found = rated.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(found, "word", "left")
    fits = F.col("best.near_n") >= ratio * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("best.near_n")).alias("form_n"))
    judged = cut(judged, "spellings")
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_query(docs: DataFrame) -> DataFrame:
    return spelling_groups(docs)
