"""References to papers: DOI and arXiv identifiers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import tex

DOI = r"10\.\d{4,9}/[^\t\n\f\r ]+"
ARXIV_NEW, ARXIV_OLD = r"\d{4}\.\d{4,5}", r"[a-z-]+(?:\.[A-Z]{2})?/\d{7}"
_EDGES = r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z"


def trim_doi(doi: Column) -> Column:
    return F.regexp_replace(doi, r"[.,;)]+\z", "")


def is_doi(c: Column) -> Column:
    return c.rlike(rf"\A{DOI}\z")


def is_arxiv(c: Column) -> Column:
    return c.rlike(rf"\A(?:{ARXIV_NEW}|{ARXIV_OLD})\z")


def _without(s: Column, prefixes: tuple[str, ...], suffix: str = "") -> Column:
    """s without the first of the prefixes that it has, and then without white space at its ends; suffix goes with prefixes that end in pdf/."""
    out = s
    for p in reversed(prefixes):
        rest = F.regexp_replace(s, rf"\A(?:{p})", "")
        out = F.when(s.rlike(rf"\A(?:{p})"), F.regexp_replace(rest, suffix, "") if suffix and p.endswith("pdf/") else rest).otherwise(out)
    return F.regexp_replace(out, _EDGES, "")


def parse_ref(ref: Column) -> Column:
    """struct<kind, doi, arxiv_id, version, text> of a reference typed by a person; one prefix at most is taken off."""
    return tex.once(F.regexp_replace(ref, _EDGES, ""), _parsed)


def _parsed(s: Column) -> Column:
    doi = _without(s, (r"https://doi\.org/", r"http://dx\.doi\.org/", "(?i:doi:)"))
    page = _without(s, (r"https?://arxiv\.org/abs/", r"https?://arxiv\.org/pdf/", "(?i:arxiv:)"), r"\.pdf\z")
    bare, version = F.regexp_replace(page, r"v\d+\z", ""), F.regexp_extract(page, r"v(\d+)\z", 1)
    kind = F.when(is_doi(doi), "doi").when(is_arxiv(bare), "arxiv").otherwise("text")
    return F.struct(
        kind.alias("kind"), F.when(kind == "doi", doi).alias("doi"), F.when(kind == "arxiv", bare).alias("arxiv_id"),
        F.when(kind == "arxiv", F.coalesce(F.try_to_number(F.nullif(version, F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))).alias("version"), F.when(kind == "text", s).alias("text"),
    )


def find_doi(text: Column) -> Column:
    """The first DOI inside a text, without trailing punctuation; null if there is none."""
    return F.nullif(trim_doi(F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>]+)", 1)), F.lit(""))


def find_arxiv(text: Column) -> Column:
    """The first arXiv stamp inside a text."""
    stamp = lambda p: F.nullif(F.regexp_extract(text, rf"arXiv:({p}(?:v\d+)?)", 1), F.lit(""))
    return F.coalesce(stamp(ARXIV_NEW), stamp(ARXIV_OLD))


def find_arxiv_id(text: Column) -> Column:
    """struct<id, version> of the first arXiv stamp, version 0 where it has none; null without a stamp."""
    stamp = find_arxiv(text)
    version = F.regexp_extract(stamp, r"v(\d+)\z", 1).try_cast("int")
    return F.when(stamp.isNotNull(), F.struct(F.regexp_replace(stamp, r"v\d+\z", "").alias("id"), F.coalesce(version, F.lit(0)).alias("version")))


def eprint_id(id_: Column, version: Column) -> Column:
    """An arXiv id with its version, where that is known."""
    return F.when(F.coalesce(version, F.lit(0)) > 0, F.concat(id_, F.lit("v"), version.cast("string"))).otherwise(id_)


def arxiv_file_base(id_: Column, version: Column) -> Column:
    """The name of an arXiv download; slashes of old ids become hyphens."""
    return F.concat(F.lit("arxiv-"), F.replace(eprint_id(id_, version), F.lit("/"), F.lit("-")))


def arxiv_url(id_: Column, version: Column, kind: str, base: str = "https://arxiv.org") -> Column:
    """Where a paper (kind pdf), its source (e-print) or its page (abs) is; without a known version the newest one."""
    return F.concat(F.lit(f"{base}/{kind}/"), eprint_id(id_, version))
