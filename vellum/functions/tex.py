"""TeX text as column expressions: decoding, folding, encoding."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import compose

# Accent commands with their combining marks, letter commands, escaped characters.
MARKS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "H": "\u030b", "c": "\u0327", "v": "\u030c", "u": "\u0306"}
LITERALS = {"ss": "ß", "o": "ø", "O": "Ø", "ae": "æ", "AE": "Æ", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł"}
ESCAPES = "&%_#{}"
_LETTERS = [chr(c) for c in range(65, 123) if chr(c).isalpha()]

_GAP = r"[\t\n\f\r ]*"
_ARGUMENT = _GAP + r"(?:\{[A-Za-z]\}|[A-Za-z])"
_TOKEN = "|".join([
    r"\$[^$]*\$", r"---", r"--", rf"\\(?:[`'^\"~=.]|[Hcvu](?![A-Za-z])){_ARGUMENT}", rf"\\(?:{'|'.join(LITERALS)})(?![A-Za-z]){_GAP}", r"\\[A-Za-z]+", r"\\[\s\S]", r"[^$~{}\\-]+", r"[\s\S]",
])


@cache
def _composed() -> dict[str, str]:
    return {k + x: unicodedata.normalize("NFC", x + m) for k, m in MARKS.items() for x in _LETTERS}


def _map(pairs: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\n".join(k + "\t" + v for k, v in pairs.items())), F.lit("\n"), F.lit("\t"))  # one literal, folded when the plan is made


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))


def _accent(t: Column) -> Column:
    letter = F.regexp_extract(t, r"([A-Za-z])\}?\z", 1)
    return F.when(t.rlike(rf"\A\\(?:[`'^\"~=.]|[Hcvu](?![A-Za-z])){_ARGUMENT}\z"), F.try_element_at(_map(_composed()), F.concat(F.substring(t, 2, 1), letter)))


def _word(t: Column) -> Column:
    return F.regexp_extract(t, r"\A\\([A-Za-z]+)", 1)


def _plain(t: Column) -> Column:
    first, rest = F.substring(t, 1, 1), F.substring(t, 2, 1)
    escaped = F.coalesce(_accent(t), F.try_element_at(_map(LITERALS), _word(t)), F.when(rest.isin(*ESCAPES), rest), F.lit(""))
    return F.when(t == "---", "—").when(t == "--", "–").when(t == "~", "\u00a0").when(t.isin("{", "}"), "").when(first == "\\", escaped).otherwise(t)


def decode(text: Column) -> Column:
    """Unicode text of TeX source; texts without a special character are left alone."""
    whole = F.array_join(F.transform(tokens(text), _plain), "")
    return F.when(text.rlike(r"[$~{}\\]|--"), whole).otherwise(text)


def unknown_macros(text: Column) -> Column:
    """Commands that decode drops, in order, repeats kept."""
    name = lambda t: F.coalesce(F.nullif(_word(t), F.lit("")), F.substring(t, 2, 1))
    unknown = lambda t: (F.substring(t, 1, 1) == "\\") & (F.length(t) > 1) & _accent(t).isNull() & ~F.coalesce(_word(t).isin(*LITERALS), F.lit(False)) & ~F.substring(t, 2, 1).isin(*ESCAPES)
    return F.when(F.contains(text, F.lit("\\")), F.transform(F.filter(tokens(text), unknown), name)).otherwise(F.array().cast("array<string>"))


@cache
def _bases() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one character and marks, with that character; those that decompose to several; capital sigma goes to its plain small form.

    Hangul syllables are left to _jamo().
    """
    source, target, several = ["Σ"], ["σ"], {}
    for c in map(chr, [*range(0xA0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)]):
        d = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"] if unicodedata.decomposition(c) else [c]
        if len(d) == 1 and d[0] != c:
            source.append(c)
            target.append("σ" if d[0] == "Σ" else d[0])
        elif len(d) > 1:
            several[c] = "".join(d)
    return "".join(source), "".join(target), several


def _jamo(c: Column) -> Column:
    """The two or three letters that a Hangul syllable is built of, by the arithmetic of the Unicode standard."""
    at = F.ascii(c) - 0xAC00
    letters = lambda first, n: F.array(*(F.lit(chr(first + i)) for i in range(n)))
    part = lambda first, n, i: F.element_at(letters(first, n), (F.floor(i) + 1).cast("int"))
    tail = F.array(F.lit(""), *(F.lit(chr(0x11A8 + i)) for i in range(27)))
    return F.concat(part(0x1100, 19, at / 588), part(0x1161, 21, at % 588 / 28), F.element_at(tail, (at % 28 + 1).cast("int")))


def _decomposed(text: Column) -> Column:
    one, base, several = _bases()
    letter = lambda c: F.when(c.between("\uac00", "\ud7a3"), _jamo(c)).otherwise(F.coalesce(F.try_element_at(_map(several), c), c))
    rare = r"[\x{0900}-\x{0dff}\x{1b00}-\x{1bff}\x{ac00}-\x{d7a3}\x{11000}-\x{11fff}\x{1d100}-\x{1d1ff}]"  # all of them are in here
    whole = lambda plain: F.array_join(F.transform(F.split(plain, ""), letter), "")
    plain = F.when(text.rlike(r"[\x{0900}-\x{10ffff}]") & text.rlike(rare), whole(text)).otherwise(text)
    return F.translate(plain, one, base)


def _lowered(decoded: Column) -> Column:
    plain = F.when(decoded.rlike(r"[^\x00-\x7f]"), F.regexp_replace(_decomposed(decoded), r"\p{Mn}+", "")).otherwise(decoded)
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("ß", "ss"), ("æ", "ae"), ("ø", "o"), ("ł", "l"), ("\u00a0", " ")), F.lower(plain))


def fold(text: Column) -> Column:
    """Decoded text without accents, in lower case, with ß æ ø ł and the hard space spelled plainly; composed characters stand as what they decompose to."""
    return once(decode(text), _lowered)


def once(value: Column, use) -> Column:
    """use(value) with value evaluated a single time, however often the expression holds it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays; zero if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


@cache
def _written() -> dict[str, str]:
    """How TeX writes the single characters that it spells in a way of its own."""
    marked = {whole: _marked(k, x) for k, m in MARKS.items() for x in _LETTERS if len(whole := unicodedata.normalize("NFC", x + m)) == 1}
    return {"–": "--", "—": "---"} | {c: "\\" + c for c in "&%#_"} | marked | {v: f"{{\\{k}}}" for k, v in LITERALS.items()}


def _marked(mark: str, letter: str) -> str:
    return f"{{\\{mark}{{{letter}}}}}" if mark.isalpha() else f"{{\\{mark}{letter}}}"


def _spelled(t: Column) -> Column:
    letter, mark = F.substring(t, 1, 1), compose.looked_up(F.substring(t, 2, 1), {v: k for k, v in MARKS.items()})
    loose = F.when(mark.rlike("[A-Za-z]"), F.concat(F.lit("{\\"), mark, F.lit("{"), letter, F.lit("}}"))).otherwise(F.concat(F.lit("{\\"), mark, letter, F.lit("}")))
    return F.when(F.length(t) == 1, F.coalesce(compose.looked_up(t, _written()), t)).when((F.length(t) == 2) & letter.rlike("[A-Za-z]") & mark.isNotNull(), loose).otherwise(t)


def encode(text: Column) -> Column:
    """TeX source for Unicode text, which is composed first; null stays null.

    A character with its marks is spelled with an accent command if it is an
    ASCII letter with one known mark, and stays as it is with others.
    """
    special = compose.ranges(_written(), 64)
    token = F.lit(rf"((?:[^{special}\p{{Mn}}](?!\p{{Mn}}))++|[\s\S]\p{{Mn}}*+)")
    spelled = lambda c: F.array_join(F.transform(F.regexp_extract_all(c, token, F.lit(1)), lambda t: F.when(t.rlike(rf"[{special}\p{{Mn}}]"), _spelled(t)).otherwise(t)), "")
    return once(text, lambda t: F.when(t.rlike(r"[&%#_]|[^\x00-\x7f]"), spelled(compose.composed(t))).otherwise(t))


def brace_title(title: Column) -> Column:
    """Braces around words with a capital after their first character, outside groups and formulas.

    A word stays bare if a group or formula is open before or after it, or if it
    begins one itself; a closing brace without an opening one counts as nothing.
    """
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("math"))
    walk = lambda s, c: F.struct(
        F.when(c == "{", s["depth"] + 1).when((c == "}") & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
        F.when(c == "$", ~s["math"]).otherwise(s["math"]).alias("math"),
    )
    free = lambda s: (s["depth"] == 0) & ~s["math"]
    braced = lambda s, w, e: F.when(free(s) & free(e) & ~F.substring(w, 1, 1).isin("{", "$") & w.rlike(r"(?s)\A.[\s\S]*\p{Lu}"), F.concat(F.lit("{"), w, F.lit("}"))).otherwise(w)
    marks = lambda w: F.regexp_extract_all(w, F.lit(r"([{}$])"), F.lit(1))
    state = lambda s: F.struct(s["depth"].alias("depth"), s["math"].alias("math"))
    step = lambda s, w: F.transform(F.array(F.aggregate(marks(w), state(s), walk)), lambda e: F.struct(e["depth"].alias("depth"), e["math"].alias("math"), F.concat(s["out"], F.lit(" "), braced(s, w, e)).alias("out")))[0]
    start = F.struct(zero["depth"].alias("depth"), zero["math"].alias("math"), F.lit("").alias("out"))
    whole = F.aggregate(F.split(title, " "), start, step, lambda s: F.substr(s["out"], F.lit(2)))
    return F.when(title.rlike(r"(?s).\p{Lu}"), whole).otherwise(title)


def normalize_pages(pages: Column) -> Column:
    return F.when(F.contains(pages, F.lit("--")), pages).otherwise(F.regexp_replace(pages, r"([0-9])-([0-9])", "$1--$2"))


def truncate(text: Column, most: int) -> Column:
    """Code-point truncation with an ellipsis."""
    if most <= 0:
        return F.lit("")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
