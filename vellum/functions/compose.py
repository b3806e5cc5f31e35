"""Canonical composition (NFC) of texts as column expressions.

Tables come from Python's Unicode data when a plan is made; tasks look
characters up with translate(), which hashes them, and walk only through the
stretches of a text that may change.  A text without marks and without
characters that decompose for good is returned as it is after one regular
expression.  What a mark is, the JVM's own Unicode version says.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conjoining letters and syllables of Hangul, in the arithmetic of the Unicode standard.
LEADS, VOWELS, TAILS, SYLLABLES = (0x1100, 19), (0x1161, 21), (0x11A7, 28), (0xAC00, 11172)
_INDEX = 0xF0000  # private characters that stand for places in a table
_MARK = r"\p{M}\x{1161}-\x{1175}\x{11a8}-\x{11c2}"  # what may join the character before it
_SPAN = 64  # gaps that ranges of characters are merged over


def _assigned() -> Iterable[str]:
    return map(chr, [*range(0xA0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x30000)])


def ranges(chars: Iterable[str], gap: int = 0) -> str:
    """The inside of a regular expression's class that has chars, and up to gap others between neighbours."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c - out[-1][1] <= gap + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def looked_up(c: Column, table: dict[str, str]) -> Column:
    """What a table of single characters has for the character c; null if it lacks it."""
    place = F.translate(c, "".join(table), "".join(chr(_INDEX + i) for i in range(len(table))))
    values = F.split(F.lit("\n".join(table.values())), "\n")  # one literal, folded when the plan is made
    return F.when(place != c, F.element_at(values, F.ascii(place) - _INDEX + 1))


@cache
def _decompositions() -> dict[str, str]:
    return {c: d for c in _assigned() if (d := unicodedata.normalize("NFD", c)) != c}


@cache
def _classes() -> dict[str, int]:
    return {c: k for c in _assigned() if (k := unicodedata.combining(c))}


@cache
def _pairs() -> dict[str, tuple[str, str]]:
    """Each second character with the first ones that it joins and what they become."""
    out: dict[str, tuple[str, str]] = {}
    for c in _assigned():
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            first, second = (chr(int(p, 16)) for p in parts)
            firsts, wholes = out.get(second, ("", ""))
            out[second] = firsts + first, wholes + c
    return out


def _class_of(c: Column) -> Column:
    table = _classes()
    place = F.translate(c, "".join(table), "".join(chr(_INDEX + k) for k in table.values()))
    return F.when(place != c, F.ascii(place) - _INDEX).otherwise(0)


def _within(code: Column, block: tuple[int, int]) -> Column:
    return code.between(block[0], block[0] + block[1] - 1)


def _syllable(a: Column, b: Column) -> Column:
    """The Hangul syllable of a leading letter and a vowel, or of a syllable without a tail and a tail."""
    x, y = F.ascii(a), F.ascii(b)
    open_one = SYLLABLES[0] + ((x - LEADS[0]) * VOWELS[1] + (y - VOWELS[0])) * TAILS[1]
    closed = x + (y - TAILS[0])
    code = F.when(_within(x, LEADS) & _within(y, VOWELS), open_one).when(_within(x, SYLLABLES) & ((x - SYLLABLES[0]) % TAILS[1] == 0) & _within(y, TAILS) & (y > TAILS[0]), closed)
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def _joined(a: Column, b: Column) -> Column:
    """The one character that a and b compose to; null if none, or if a is empty."""
    pairs = _pairs()
    firsts, wholes = (looked_up(b, {k: v[i] for k, v in pairs.items()}) for i in (0, 1))
    at = F.instr(firsts, a)
    return F.when(a != "", F.coalesce(F.when(at > 0, F.substr(wholes, at, F.lit(1))), _syllable(a, b)))


def _ordered(piece: Column) -> Column:
    """A character, or none at the start of a text, and its marks, the marks by class; those of one class stay in their order."""
    keyed = F.transform(F.split(piece, ""), lambda c, i: F.struct(_class_of(c).alias("k"), i.alias("i"), c.alias("c")))
    return F.when(F.length(piece) > 1, F.array_join(F.transform(F.array_sort(keyed), lambda s: s["c"]), "")).otherwise(piece)


def _recomposed(stretch: Column) -> Column:
    full = F.array_join(F.transform(F.split(stretch, ""), lambda c: F.coalesce(looked_up(c, _decompositions()), c)), "")
    marks = ranges(_classes())
    pieces = F.regexp_extract_all(full, F.lit(rf"([^{marks}][{marks}]*|[{marks}]+)"), F.lit(1))
    state = lambda out, last, tail, k: F.struct(out.alias("out"), last.alias("last"), tail.alias("tail"), k.alias("k"))

    def step(s: Column, c: Column) -> Column:
        seen = F.array(F.struct(c.alias("c"), _class_of(c).alias("k"), _joined(s["last"], c).alias("whole")))

        def use(n: Column) -> Column:
            free = n["whole"].isNotNull() & ((s["tail"] == "") | (s["k"] < n["k"]))
            flushed = state(F.concat(s["out"], s["last"], s["tail"]), n["c"], F.lit(""), F.lit(0))
            return F.when(free, state(s["out"], n["whole"], s["tail"], s["k"])).when(n["k"] == 0, flushed).otherwise(state(s["out"], s["last"], F.concat(s["tail"], n["c"]), n["k"]))

        return F.transform(seen, use)[0]

    empty = state(F.lit(""), F.lit(""), F.lit(""), F.lit(0))
    chars = F.split(F.array_join(F.transform(pieces, _ordered), ""), "")
    return F.aggregate(chars, empty, step, lambda s: F.concat(s["out"], s["last"], s["tail"]))


@cache
def _changing() -> str:
    """Characters that composition may change by themselves, with others near them, and all that may join another."""
    return ranges((c for c in _assigned() if unicodedata.normalize("NFC", c) != c), _SPAN) + _MARK


def composed(text: Column) -> Column:
    """text in Unicode's composed form (NFC); null stays null, and a composed text is left alone.

    A stretch is a character with all marks after it; its cost grows with the
    square of the number of characters in it, which is small in any language.
    """
    changing = _changing()
    stretch = rf"((?:[^{changing}](?![{_MARK}]))++|[\s\S][{_MARK}]*+)"
    parts = F.transform(F.regexp_extract_all(text, F.lit(stretch), F.lit(1)), lambda t: F.when(t.rlike(f"[{changing}]"), _recomposed(t)).otherwise(t))
    return F.when(text.rlike(f"[{changing}]"), F.array_join(parts, "")).otherwise(text)
