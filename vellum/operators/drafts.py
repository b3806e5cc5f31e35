"""Draft records from services' answers, titles guessed from page lines, and what a search prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import tex
from vellum.functions.names import parse_names
from vellum.operators.batch import first_holders, identifiers
from vellum.operators.records import SIMILAR, add_pending, make_key, merge
from vellum.sources import services

LEAST_TOKENS = 4


def _filled(pairs: dict[str, Column]) -> Column:
    """A map without the empty values."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()))
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def _encoded(rows: DataFrame, **texts: Column) -> DataFrame:
    """rows with TeX source of texts as columns; a generator makes them, so that no later use or filter encodes a text again."""
    made = F.struct(*(tex.encode(c).alias(n) for n, c in texts.items()))
    return rows.select("*", F.explode(F.array(made)).alias("_encoded")).select(*rows.columns, *(F.col(f"_encoded.{n}").alias(n) for n in texts))


def published_drafts(works: DataFrame) -> DataFrame:
    """works (work as services.WORK, other columns kept) with error, and base key, type, fields and doi of a draft where it is null.

    A work needs a title, authors that are not all empty, and a year; a first
    author without letters in the last name has no key.
    """
    w = F.col("work")
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    year = services.work_year(w)
    raw = _encoded(works, _title=first(w["title"]), _venue=first(w["container-title"]), _authors=F.coalesce(services.work_authors(w), F.lit("")))
    named = raw.withColumn("_names", parse_names("_authors"))
    base = make_key(F.try_element_at(F.col("_names.names"), F.lit(1))["last"], year.cast("string"))
    error = F.when(F.col("_title") == "", "missing title").when(F.coalesce(F.size(w["author"]), F.lit(0)) <= 0, "missing authors").when(year == 0, "missing year").when(F.col("_authors") == "", "missing authors").when(base.isNull(), "no key")
    fields = _filled({"author": F.col("_authors"), "title": tex.brace_title(F.col("_title")), "year": year.cast("string"), "journal": F.col("_venue"), "volume": w["volume"], "number": w["issue"], "pages": tex.normalize_pages(w["page"]), "doi": w["DOI"]})
    made = F.when(F.col("error").isNull(), F.struct(base.alias("base"), services.work_type(w).alias("type"), fields.alias("fields"), w["DOI"].alias("doi")))
    return named.withColumn("error", error).select(*works.columns, "error", made.alias("_d")).select(*works.columns, "error", "_d.*")


PENDING = "complete and check the metadata"


def preprint_drafts(entries: DataFrame) -> DataFrame:
    """entries (entry as services.ENTRY, other columns kept) with error, and base key, type, fields, arxiv, abstract and doi of a draft where it is null."""
    e = F.col("entry")
    raw = _encoded(entries, _title=F.coalesce(e["title"], F.lit("")), _authors=F.coalesce(services.arxiv_authors(e["authors"]), F.lit("")))
    named = raw.withColumn("_names", parse_names("_authors"))
    year = F.coalesce(e["year"], F.lit(0))
    base = make_key(F.try_element_at(F.col("_names.names"), F.lit(1))["last"], year.cast("string"))
    error = F.when(F.col("_title") == "", "missing title").when(F.coalesce(F.size(e["authors"]), F.lit(0)) <= 0, "missing authors").when(year == 0, "missing year").when(base.isNull(), "no key")
    fields = _filled({"author": F.col("_authors"), "title": tex.brace_title(F.col("_title")), "year": year.cast("string"), "eprint": e["id"], "archiveprefix": F.lit("arXiv"), "primaryclass": e["primary_class"]})
    arxiv = F.struct(e["id"].alias("id"), e["version"].alias("version"))
    made = F.when(F.col("error").isNull(), F.struct(base.alias("base"), F.lit("misc").alias("type"), fields.alias("fields"), arxiv.alias("arxiv"), e["summary"].alias("abstract"), F.nullif(e["doi"], F.lit("")).alias("doi")))
    return named.withColumn("error", error).select(*entries.columns, "error", made.alias("_d")).select(*entries.columns, "error", "_d.*")


def merge_published(preprints: DataFrame, works: DataFrame) -> DataFrame:
    """preprints (id, base, type, fields, arxiv, abstract, doi, pending) with the published record of their DOI where works (doi, status, work) has one.

    The published record is the entry: its key, type and fields, with the
    preprint's identifiers laid over them, its arXiv reference and its abstract.
    Where the lookup failed or the record is unusable, the preprint stays and
    pending says why.
    """
    asked = preprints.where("doi is not null").select("doi").distinct().join(works, "doi")
    published = published_drafts(asked.where("status = 200").select(F.col("doi").alias("asked"), "work"))
    facts = works.select(F.col("doi").alias("asked"), "status").join(published.select("asked", F.struct("error", "base", "type", "fields", "doi").alias("p")), "asked", "left")
    joined = preprints.join(facts.select(F.col("asked").alias("_asked"), F.struct("status", "p").alias("_said")), F.col("doi") == F.col("_asked"), "left")
    p = F.col("_said.p")
    good = F.coalesce(p.isNotNull() & p["error"].isNull(), F.lit(False))
    failed = F.concat(F.lit("preprint only: asked for "), F.col("doi"), F.lit(", got "), F.coalesce(F.col("_said.status").cast("string"), F.lit("no answer")))
    unusable = F.concat(F.lit("preprint only: the record of "), F.col("doi"), F.lit(" has a fault, "), p["error"])
    note = F.when(F.col("doi").isNotNull() & ~good, F.when(p.isNull(), failed).otherwise(unusable))
    pick = lambda n, own=None: F.when(good, p[n]).otherwise(F.col(n) if own is None else own).alias(n)
    fields = F.when(good, merge(p["fields"], F.col("fields"))).otherwise(F.col("fields")).alias("fields")
    own = [c for c in preprints.columns if c not in ("base", "type", "fields", "doi", "pending")]
    return joined.select(*own, pick("base"), pick("type"), fields, pick("doi", F.lit(None).cast("string")), add_pending(F.col("pending"), note).alias("pending"))


def unseen_in_batch(papers: DataFrame) -> DataFrame:
    """papers (ord, doi, arxiv_id, more) with first: the ord of the row of the batch that creates the record.

    A paper whose first is its own ord is new; another one repeats a record that
    an earlier row creates, with the same DOI, whatever its case, or the same
    arXiv id.  A row that repeats creates nothing, so its identifiers don't count
    for those after it.  Empty identifiers match nothing.
    """
    given = identifiers(F.col("doi"), F.col("arxiv_id"))
    found = first_holders(papers.select("ord", given.alias("asks"), given.alias("holds"))).withColumnRenamed("first", "_first")
    return papers.join(found, "ord", "left").select(*papers.columns, F.coalesce("_first", "ord").alias("first"))


def title_guess(lines: Column, sizes: Column) -> Column:
    """The leading lines of one size joined, if they have LEAST_TOKENS words, else the first later line that has, else empty.

    lines come by falling size; without a size for each, only the first line leads.
    """
    other = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (F.size(sizes) != F.size(lines)) & (i > 1) | (F.try_element_at(sizes, i) != F.try_element_at(sizes, F.lit(1))))
    end = F.when(F.size(lines) > 0, F.coalesce(F.array_min(other) - 1, F.size(lines))).otherwise(0)
    enough = lambda s: F.size(tex.words(s)) >= LEAST_TOKENS
    lead = F.array_join(F.slice(lines, F.lit(1), end), " ")
    later = F.filter(F.slice(lines, end + 1, F.size(lines)), enough)
    return F.when(F.size(lines) <= 0, "").when(enough(lead), lead).otherwise(F.coalesce(F.try_element_at(later, F.lit(1)), F.lit("")))


def hit_flags(status: Column, versions: Column) -> Column:
    """draft first, then deprecated files by name."""
    files = F.array_sort(F.map_keys(F.map_filter(versions, lambda k, v: F.coalesce(v["deprecated"], F.lit(False)))))
    draft = F.when(status == "draft", F.array(F.lit("draft"))).otherwise(F.array().cast("array<string>"))
    return F.concat(draft, F.coalesce(F.transform(files, lambda f: F.concat(F.lit("deprecated:"), f)), F.array().cast("array<string>")))


def online_problems(records: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, severity, msg) of records (key, doi, title, year) against answers (doi, status, work).

    Status 404 is an error and any other but 200 a warning; a title that is not
    alike and a year that differs are warnings.  Records without a DOI, or
    without an answer, are left out.  One equi-join on doi.
    """
    met = records.where(F.coalesce("doi", F.lit("")) != "").join(answers, "doi")
    theirs, year = F.coalesce(F.try_element_at(F.col("work.title"), F.lit(1)), F.lit("")), services.work_year(F.col("work"))
    alike = tex.similarity(tex.words(F.coalesce("title", F.lit(""))), tex.words(theirs)) >= SIMILAR
    mine = F.coalesce("year", F.lit(""))
    row = lambda when, severity, msg: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), msg.alias("msg")))
    ok = F.col("status") == 200
    found = F.array(
        row(F.col("status") == 404, "error", F.lit("DOI does not resolve")),
        row(~ok & (F.col("status") != 404), "warning", F.concat(F.lit("lookup failed: "), F.col("status").cast("string"))),
        row(ok & (F.size("work.title") > 0) & ~alike, "warning", F.concat(F.lit("title differs: "), theirs)),
        row(ok & (year != 0) & (mine != "") & (mine != year.cast("string")), "warning", F.concat(F.lit("year differs: "), year.cast("string"))),
    )
    return met.select("key", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("key", "p.*")
