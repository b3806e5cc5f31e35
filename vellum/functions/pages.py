"""Page texts and embedded metadata of papers, as they come from a reader of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import refs, tex

# The Symbol font's characters at 0x20-0x7e and 0xa0-0xef, 0xf1-0xfe, in its order.
SYMBOL_LOW = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧ∆ΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλµνοπθρστυϖωξψζ{|}∼"
SYMBOL_HIGH = "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪"
SYMBOL_LAST = "〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"
PRISM_TEXTS = ("doi", "publicationName", "issn", "eIssn", "volume", "number", "issueIdentifier", "startingPage", "endingPage", "pageRange", "coverDate", "aggregationType")
PRISM_VERSIONS = ("2.1", "2.0", "3.0")


def remap_symbols(text: Column) -> Column:
    """Text whose private characters U+F020 to U+F0FE stand for Symbol glyphs, with those glyphs."""
    private = [*range(0xF020, 0xF07F), *range(0xF0A0, 0xF0F0), *range(0xF0F1, 0xF0FF)]
    return F.translate(text, "".join(map(chr, private)), SYMBOL_LOW + SYMBOL_HIGH + SYMBOL_LAST)


def has_text(pages: Column) -> Column:
    """Whether some page has more than white space."""
    return F.coalesce(F.exists(pages, lambda p: p.rlike(r"\P{IsWhite_Space}")), F.lit(False))


def line_sizes(glyph_sizes: Column) -> Column:
    """The font size of each line: the largest of its glyphs."""
    return F.transform(glyph_sizes, F.array_max)


def top_lines(lines: Column, sizes: Column) -> Column:
    """array<struct<line, size>> of the first page's lines by falling size, equal ones in their order."""
    numbered = F.transform(F.arrays_zip(lines.alias("line"), sizes.alias("size")), lambda x, i: F.struct((-x["size"]).alias("by"), i.alias("at"), x["line"].alias("line"), x["size"].alias("size")))
    return F.transform(F.array_sort(numbered), lambda x: F.struct(x["line"].alias("line"), x["size"].alias("size")))


def _text(values: Column, name: str) -> Column:
    return F.regexp_replace(F.coalesce(values[name], F.lit("")), r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def _first(*texts: Column) -> Column:
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def normal_doi(value: Column) -> Column:
    """The bare DOI of a value that may carry a prefix; empty if it is none."""
    return F.coalesce(refs.parse_ref(F.coalesce(value, F.lit("")))["doi"], F.lit(""))


def prism_pages(values: Column) -> Column:
    """The page range as it was given, else start and end, else the start alone."""
    whole, start, end = (_text(values, n) for n in ("pageRange", "startingPage", "endingPage"))
    return F.when(whole != "", whole).when((start != "") & (end != ""), F.concat(start, F.lit("--"), end)).otherwise(start)


def prism(versions: dict[str, Column], pdfx_doi: Column) -> Column:
    """Publisher metadata of a packet, null if there is none.

    versions: structs of PRISM_TEXTS by namespace version.  The first of
    PRISM_VERSIONS with any text counts, with all its texts; a DOI that it lacks
    comes from pdfx_doi.
    """
    given = lambda v: F.exists(F.array(*(F.coalesce(v[n], F.lit("")) for n in PRISM_TEXTS)), lambda x: x != "")
    chosen = F.coalesce(*(F.when(given(versions[v]), versions[v]) for v in PRISM_VERSIONS if v in versions))
    texts = ("doi", "publication", "issn", "volume", "number", "pages", "cover_date", "aggregation")
    said = lambda info: F.exists(F.array(*(info[n] for n in texts)), lambda x: x != "")
    return tex.once(tex.once(chosen, lambda v: _publisher(v, pdfx_doi)), lambda info: F.when(said(info), info))


def _publisher(v: Column, pdfx_doi: Column) -> Column:
    return F.struct(
        _first(normal_doi(v["doi"]), normal_doi(pdfx_doi)).alias("doi"), _text(v, "publicationName").alias("publication"), _first(_text(v, "issn"), _text(v, "eIssn")).alias("issn"),
        _text(v, "volume").alias("volume"), _first(_text(v, "number"), _text(v, "issueIdentifier")).alias("number"), prism_pages(v).alias("pages"),
        _text(v, "coverDate").alias("cover_date"), _text(v, "aggregationType").alias("aggregation"),
    )


def stated_doi(info: Column, identifier: Column) -> Column:
    """The DOI that metadata states: the publisher's, else that of the document's identifier; empty without one."""
    return _first(F.coalesce(info["doi"], F.lit("")), normal_doi(identifier))


def metadata_title(title: Column, xmp_title: Column) -> Column:
    """The document's title, else that of its packet, without white space at the ends."""
    edges = r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z"
    return _first(*(F.regexp_replace(F.coalesce(t, F.lit("")), edges, "") for t in (title, xmp_title)))
