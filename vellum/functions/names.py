"""BibTeX author lists, as expressions.

Separators count outside braces only.  A list is cut into braces and the runs
between them; a state of depth and text walks over these pieces and puts marks
in place of the separators that stand at depth zero, where it is then split.
A closing brace without an opening one counts as nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.tex import once

# Code points that are no characters, for separators.
_AND, _COMMA, _SPACE, _DOT = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_WHITE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}~]"
_NONE = "array<string>"


def _marked(text: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """text with mark(text so far, piece) in place of each piece at depth zero."""
    pieces = F.regexp_extract_all(text, F.lit("([{}]|[^{}]+)"), F.lit(1))
    deeper = lambda d, p: F.when(p == "{", d + 1).when((p == "}") & (d > 0), d - 1).otherwise(d)
    step = lambda s, p: F.struct(deeper(s["depth"], p).alias("depth"), F.concat(s["out"], F.when(s["depth"] == 0, mark(s["out"], p)).otherwise(p)).alias("out"))
    walked = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike("[{}]"), walked).otherwise(mark(F.lit(""), text))


def _parts(author: Column) -> Column:
    """The words of what stands between an author's commas; a full stop ends a word unless a hyphen or nothing follows."""

    def mark(out: Column, piece: Column) -> Column:
        spaced = F.regexp_replace(F.replace(piece, F.lit(","), F.lit(_COMMA)), _WHITE, _SPACE)
        run = F.regexp_replace(spaced, rf"\.(?![-{_COMMA}{_SPACE}]|\z)", "." + _DOT)
        return F.when(piece.isin("{", "}"), F.concat(F.when(out.endswith("."), _DOT).otherwise(""), piece)).otherwise(run)

    words = lambda part: F.filter(F.split(part, f"[{_SPACE}{_DOT}]"), lambda w: w != "")
    return F.transform(F.split(_marked(author, mark), _COMMA), words)


def _name(parts: Column) -> Column:
    """struct<first, von, last, jr> of one author's words, null if there is no name or there are too many commas.

    The last name begins after the last small word of the words before the end;
    without a comma the first name ends before the first small one.
    """
    head = parts[0]
    n, one = F.size(head), F.size(parts) == 1
    small = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i < n) & F.try_element_at(head, i).rlike(r"\A\p{javaLowerCase}"))

    def named(small: Column) -> Column:
        begin, end = F.try_element_at(small, F.lit(1)), F.try_element_at(small, F.lit(-1))
        given = F.when(one, F.coalesce(begin - 1, n - 1)).otherwise(0)
        until = F.when(one, F.coalesce(end, n - 1)).otherwise(F.when(begin == 1, end).otherwise(0))
        some = lambda start, size: F.slice(head, start + 1, F.greatest(size, F.lit(0)))
        first = F.when(one, some(F.lit(0), given)).otherwise(F.try_element_at(parts, F.lit(-1)))
        jr = F.when(F.size(parts) == 3, parts[1]).otherwise(F.array().cast(_NONE))
        text = lambda words, name: F.array_join(words, " ").alias(name)
        return F.struct(text(first, "first"), text(some(given, until - given), "von"), text(some(until, n - until), "last"), text(jr, "jr"))

    return F.when((F.size(parts) <= 3) & (n > 0), once(small, named))


def _listed(authors: Column, use: Callable[[Column], Column]) -> Column:
    """use(an array of struct<text, name> of the authors of a list); null and empty lists have none."""
    ands = lambda _, piece: F.replace(piece, F.lit(" and "), F.lit(_AND))
    texts = F.when(F.coalesce(authors, F.lit("")) == "", F.array().cast(_NONE)).otherwise(F.split(_marked(authors, ands), _AND))
    return once(F.transform(texts, lambda a: F.struct(a.alias("text"), once(_parts(a), _name).alias("name"))), use)


def _error(found: Column) -> Column:
    bad = F.filter(found, lambda a: a["name"].isNull())
    return F.when(F.size(bad) > 0, F.concat(F.lit("not a name: "), F.try_element_at(bad, F.lit(1))["text"]))


def parse_names(authors: Column | str) -> Column:
    """struct<names, error>: the names of an author list, or none and the reason why it can't be read."""
    names = lambda found: F.transform(F.filter(found, lambda _: _error(found).isNull()), lambda a: a["name"])
    return _listed(F.col(authors) if isinstance(authors, str) else authors, lambda found: F.struct(names(found).alias("names"), _error(found).alias("error")))


def name_errors(author: Column, editor: Column) -> Column:
    """struct<author, editor>: why the lists can't be read; null where they can, or are empty."""
    return F.struct(_listed(author, _error).alias("author"), _listed(editor, _error).alias("editor"))


def last_name(authors: Column) -> Column:
    """The decoded last name of the first author; empty if the list is empty or can't be read."""
    from vellum.functions import tex

    first = F.try_element_at(parse_names(authors)["names"], F.lit(1))
    return F.coalesce(tex.decode(first["last"]), F.lit(""))


def full_name(name: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(", ", F.concat_ws(" ", blank(name["first"]), blank(name["von"]), blank(name["last"])), blank(name["jr"]))
