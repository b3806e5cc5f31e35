"""Candidate papers from the answers of search services (JSON text columns).

A hit of the wrong shape is left out and costs none of the others; the limit
counts hits as the service sent them, so it comes before that.  Variants tell
the shapes apart, which a fixed schema would coerce.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANDIDATE = "struct<source:string,title:string,authors:array<string>,venue:string,year:int,doi:string>"


def _kind(hit: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(hit, path, "variant")), F.lit("VOID"))


def _text(hit: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(hit, path, "string"), F.lit(""))


def _hits(body: Column, path: str, limit: int) -> Column:
    found = F.coalesce(F.try_variant_get(F.try_parse_json(body), path, "array<variant>"), F.array().cast("array<variant>"))
    return F.slice(found, 1, max(0, limit))


def _candidate(source: str, title: Column, authors: Column, venue: Column, year: Column, doi: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(source).alias("source"), title.alias("title"), F.coalesce(authors, none).alias("authors"), venue.alias("venue"), F.coalesce(year, F.lit(0)).alias("year"), doi.alias("doi")).cast(CANDIDATE)


def zbmath(body: Column, limit: int = 5) -> Column:
    """array<CANDIDATE>; venue is the first series, doi the first link of that type, an absent year 0."""
    fits = lambda h: _kind(h, "$.title.title").isin("STRING", "VOID") & _kind(h, "$.year").isin("BIGINT", "VOID")

    def candidate(h: Column) -> Column:
        links = F.filter(F.try_variant_get(h, "$.links", "array<struct<type:string,identifier:string>>"), lambda x: x["type"] == "doi")
        authors = F.transform(F.try_variant_get(h, "$.contributors.authors", "array<struct<name:string>>"), lambda a: F.coalesce(a["name"], F.lit("")))
        return _candidate("zbmath", _text(h, "$.title.title"), authors, _text(h, "$.source.series[0].title"), F.try_variant_get(h, "$.year", "int"), F.coalesce(F.try_element_at(links, F.lit(1))["identifier"], F.lit("")))

    return F.transform(F.filter(_hits(body, "$.result", limit), fits), candidate)


def dblp(body: Column, limit: int = 5) -> Column:
    """array<CANDIDATE>; an author may stand alone or in an array, so may a venue; a year is text, 0 if it is no number."""
    fits = lambda h: _kind(h, "$.info.title").isin("STRING", "VOID") & _kind(h, "$.info.year").isin("STRING", "VOID") & _kind(h, "$.info.doi").isin("STRING", "VOID")

    def candidate(h: Column) -> Column:
        many = F.transform(F.try_variant_get(h, "$.info.authors.author", "array<struct<text:string>>"), lambda a: F.coalesce(a["text"], F.lit("")))
        one = F.when(_kind(h, "$.info.authors.author").startswith("OBJECT"), F.array(_text(h, "$.info.authors.author.text")))
        venue = F.when(_kind(h, "$.info.venue") == "STRING", _text(h, "$.info.venue")).when(_kind(h, "$.info.venue") == "ARRAY<STRING>", _text(h, "$.info.venue[0]")).otherwise("")
        return _candidate("dblp", _text(h, "$.info.title"), F.coalesce(many, one), venue, _text(h, "$.info.year").try_cast("int"), _text(h, "$.info.doi"))

    return F.transform(F.filter(_hits(body, "$.result.hits.hit", limit), fits), candidate)
