"""What becomes of references and files that ask for a record: drafts, downloads and outcomes, as plans over answers of services.

Every step is a join with answers that were fetched before; nothing here talks
to a service.  A request ends in one outcome: ok, duplicate, ambiguous,
unidentified, no-oa-route or error.  Requests of a batch follow each other by
id: what one creates, those after it find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.functions import refs
from vellum.operators.batch import first_holders, identifiers
from vellum.operators.drafts import PENDING, merge_published, preprint_drafts, published_drafts
from vellum.operators.records import append_log, auto_accept, find_duplicates, free_keys, identify_by_title, verify_into
from vellum.operators.reports import entry_label, mismatch, record_facts, work_facts, work_label
from vellum.schema import EVENT_FIELDS, RECORD, RECORD_FIELDS
from vellum.session import cut
from vellum.sources import services

_DOWNLOADS = "array<struct<url:string,name:string>>"
OUTCOME = (
    "id", "outcome", "known", "base", "type", "fields", "doi", "arxiv", "abstract", "pending", "downloads", "detail", "candidates",
)
_TYPES = {
    "known": "string", "base": "string", "type": "string", "fields": "map<string,string>", "doi": "string", "arxiv": "struct<id:string,version:int>", "abstract": "string", "pending": "string",
    "downloads": _DOWNLOADS, "detail": "string", "candidates": "array<string>",
}


EARLIEST_YEAR, LATEST_YEAR = 1800, 2099
CREATING = ("ok", "no-oa-route")  # the outcomes that leave a record behind


def _outcome(rows: DataFrame, outcome: str | Column, **values: Column) -> DataFrame:
    """rows (id, ...) as OUTCOME with asks, the identifiers that the request was looked up by; columns that are not given are null."""
    made = {"outcome": F.lit(outcome) if isinstance(outcome, str) else outcome, **values}
    asks = values.get("asks", F.array()).cast("array<string>").alias("asks")
    return rows.select("id", *((made[n] if n in made else F.lit(None)).cast(_TYPES.get(n, "string")).alias(n) for n in OUTCOME[1:]), asks)


def in_order(outcomes: DataFrame) -> DataFrame:
    """outcomes of a batch (OUTCOME, asks) with first in place of asks: the id of the request that creates what this one asks for again.

    Such a request is a duplicate and makes nothing.  Requests that found a
    stored record stay as they are and have no first.
    """
    outcomes = cut(outcomes, "outcomes")
    open_ = F.col("outcome") != "duplicate"
    holds = F.when(F.col("outcome").isin(*CREATING), identifiers(F.col("doi"), F.col("arxiv.id")))
    first = first_holders(outcomes.select(F.col("id").alias("ord"), F.when(open_, F.col("asks")).alias("asks"), holds.alias("holds"))).select(F.col("ord").alias("id"), "first")
    again, lost = F.col("first").isNotNull(), ("base", "type", "fields", "arxiv", "abstract", "pending", "downloads", "detail")
    met = outcomes.join(first, "id", "left").withColumn("outcome", F.when(again, "duplicate").otherwise(F.col("outcome")))
    return met.select(*(F.when(~again, F.col(n)).alias(n) if n in lost else F.col(n) for n in OUTCOME), "first")


def arxiv_downloads(id_: Column, version: Column) -> Column:
    """Where an arXiv paper and its source are, and the names to keep them under."""
    base = refs.arxiv_file_base(id_, version)
    one = lambda kind, name: F.struct(refs.arxiv_url(id_, version, kind).alias("url"), name.alias("name"))
    return F.array(one("pdf", F.concat(base, F.lit(".pdf"))), one("e-print", F.concat(base, F.lit("/"))))


def _known(rows: DataFrame, stored: DataFrame, name: str, doi: Column | None = None, arxiv: Column | None = None) -> DataFrame:
    """(id, name): the stored key of rows whose DOI or arXiv id is stored."""
    none = F.lit(None).cast("string")
    asked = rows.select("id", (none if doi is None else doi).alias("doi"), (none if arxiv is None else arxiv).alias("arxiv_id"))
    return find_duplicates(asked, stored).withColumnRenamed("key", name)


def resolve_dois(requests: DataFrame, stored: DataFrame, works: DataFrame, oa: DataFrame) -> DataFrame:
    """OUTCOME of requests (id, doi): a stored record, an error, or a draft of the published work with its open-access copy.

    stored: key, doi, arxiv_id.  works: doi, status, work.  oa: doi, status, answer.
    """
    rows = requests.select("id", F.col("doi").alias("asked")).join(_known(requests, stored, "known", doi=F.col("doi")), "id", "left")
    rows = rows.join(works.select(F.col("doi").alias("asked"), "status", "work"), "asked", "left")
    rows = rows.join(oa.select(F.col("doi").alias("asked"), F.col("status").alias("said"), "answer"), "asked", "left")
    drafted = published_drafts(rows).withColumn("route", services.unpaywall_route(F.col("said"), F.col("answer")))
    stored_, lost, bad, open_ = F.col("known").isNotNull(), F.coalesce(F.col("status") != 200, F.lit(True)) | F.col("work").isNull(), F.col("error").isNotNull(), F.col("route.url").isNotNull()
    outcome = F.when(stored_, "duplicate").when(lost | bad, "error").when(open_, "ok").otherwise("no-oa-route")
    made = lambda c: F.when(~stored_ & ~lost & ~bad, c)
    failed = F.concat(F.lit("lookup of "), "asked", F.lit(" failed: "), F.coalesce(F.col("status").cast("string"), F.lit("no answer")))
    unusable = F.concat(F.lit("work "), work_label(F.col("work")), F.lit(": "), "error")
    told = F.when(open_, F.concat(F.lit("unpaywall: "), "route.verdict")).otherwise(work_facts(F.col("work"), F.col("route.verdict")))
    copy = F.when(open_, F.array(F.struct(F.col("route.url").alias("url"), F.lit("published.pdf").alias("name"))))
    return _outcome(
        drafted, outcome, known=F.col("known"), base=made(F.col("base")), type=made(F.col("type")), fields=made(F.col("fields")), doi=F.coalesce(made(F.col("doi")), "asked"),
        pending=made(F.lit(PENDING)), downloads=made(copy), detail=F.when(stored_, None).when(lost, failed).when(bad, unusable).otherwise(told), asks=identifiers(F.col("asked"), F.lit("")),
    )


def resolve_preprints(requests: DataFrame, stored: DataFrame, entries: DataFrame, works: DataFrame) -> DataFrame:
    """OUTCOME of requests (id, arxiv_id, version): a stored record, an error, or a draft with the published record that the preprint names.

    entries: arxiv_id, status, entry.  A preprint whose DOI is stored is a duplicate too.
    """
    rows = requests.select("id", "arxiv_id", F.col("version").alias("asked")).join(_known(requests, stored, "known", arxiv=F.col("arxiv_id")), "id", "left")
    rows = rows.join(entries, "arxiv_id", "left")
    rows = rows.join(_known(rows.where("entry is not null"), stored, "published", doi=F.col("entry.doi")), "id", "left")
    drafted = preprint_drafts(rows)
    lost = F.coalesce(F.col("status") != 200, F.lit(True)) | F.col("entry").isNull()
    stored_, bad = F.coalesce("known", "published").isNotNull(), F.col("error").isNotNull()
    drafted = drafted.withColumn("stored", stored_).withColumn("failed", F.when(lost, F.concat(F.lit("arXiv "), "arxiv_id", F.lit(" not found"))).when(bad, F.concat(F.lit("arXiv entry "), entry_label(F.col("entry")), F.lit(": "), "error")))
    good = ~F.col("stored") & F.col("failed").isNull()
    drafted = drafted.withColumn("named", F.col("doi")).withColumn("doi", F.when(good, F.col("doi"))).withColumn("pending", F.lit(PENDING))
    drafted = drafted.withColumn("asks", identifiers(F.col("named"), F.col("arxiv_id")))
    merged = merge_published(drafted.select("id", "asks", "asked", "known", "published", "stored", "failed", "named", "base", "type", "fields", "arxiv", "abstract", "doi", "pending"), works)
    made = lambda c: F.when(good, c)
    version = F.when(F.col("arxiv.version") > 0, F.col("arxiv.version")).otherwise(F.coalesce("asked", F.lit(0)))
    return _outcome(
        merged, F.when(F.col("stored"), "duplicate").when(F.col("failed").isNotNull(), "error").otherwise("ok"), known=F.coalesce("known", "published"), base=made(F.col("base")), type=made(F.col("type")),
        fields=made(F.col("fields")), doi=F.when(F.col("published").isNotNull(), F.col("named")).otherwise(made(F.col("doi"))), arxiv=made(F.col("arxiv")), abstract=made(F.col("abstract")),
        pending=made(F.col("pending")), downloads=made(arxiv_downloads(F.col("arxiv.id"), version)),
        detail=F.when(~F.col("stored"), F.coalesce("failed", F.concat(F.lit("arXiv record "), refs.eprint_id(F.col("arxiv.id"), version)))), asks=F.col("asks"),
    )


def _years(text: Column) -> Column:
    """The numbers of four digits in a text that can be years."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\b[0-9]{4}\b"), F.lit(0)), lambda y: y.cast("int"))
    return F.filter(numbers, lambda y: y.between(EARLIEST_YEAR, LATEST_YEAR))


def fetch(requests: DataFrame, stored: DataFrame, works: DataFrame, entries: DataFrame, hits: DataFrame, oa: DataFrame) -> DataFrame:
    """OUTCOME, first, kind and source of requests (id, ref): references as people type them, one after another by id.

    DOIs, arXiv ids and free texts are three plans; a text whose first hit (hits:
    query, pos, doi, score, year, label) is clear goes on as that DOI, another
    one is ambiguous and carries its candidates.  Hits are judged once a text,
    however many requests say it, and candidates are joined to the outcomes at
    the end, so that no plan that leaves them out makes them.
    """
    asked = requests.withColumn("r", refs.parse_ref(F.col("ref"))).select("id", "ref", "r.*")
    texts = asked.where("kind = 'text'").select("id", "text")
    mine = hits.withColumnRenamed("query", "text").join(texts.select("text").distinct(), "text", "left_semi")
    clear = auto_accept(mine.select(F.col("text").alias("query"), "pos", "doi", "score", "year", _years(F.col("text")).alias("years")))
    chosen = texts.join(clear.withColumnRenamed("query", "text"), "text").select("id", "doi")
    dois = asked.where("kind = 'doi'").select("id", refs.trim_doi(F.col("doi")).alias("doi")).unionByName(chosen)
    papers = asked.where("kind = 'arxiv'").select("id", "arxiv_id", "version")
    label = F.concat_ws(" ", "doi", F.concat(F.lit("("), F.col("score").cast("string"), F.lit(")")))
    several = mine.groupBy("text").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", label.alias("label")))), lambda x: x["label"]).alias("candidates"))
    unclear = texts.join(chosen, "id", "left_anti")
    ambiguous = _outcome(unclear, "ambiguous", detail=F.concat(F.lit("no clear answer for "), "text"))
    out = in_order(resolve_dois(dois, stored, works, oa).unionByName(resolve_preprints(papers, stored, entries, works)).unionByName(ambiguous))
    source = F.when(F.col("kind") == "arxiv", "arxiv").otherwise("crossref")
    told = out.drop("candidates").join(asked.select("id", "kind", source.alias("source"), "text"), "id")
    told = told.withColumn("text", F.when(F.col("outcome") == "ambiguous", F.col("text"))).join(several, "text", "left")
    return told.select(*OUTCOME, "first", "kind", "source")


def ingest(files: DataFrame, stored: DataFrame, works: DataFrame, entries: DataFrame, hits: DataFrame, oa: DataFrame) -> DataFrame:
    """OUTCOME, first, tier and title of files (id, ident as identify() gives it, guess): identified, completed by title, then resolved one after another by id."""
    known = identify_by_title(files.select("id", "ident", "guess"), hits).select("id", "ident.*", "title")
    dois = known.where("doi is not null").select("id", "doi")
    papers = known.where("doi is null and arxiv_id is not null").select("id", "arxiv_id", "version")
    lost = known.where("doi is null and arxiv_id is null")
    none = _outcome(lost, "unidentified", detail=F.concat(F.lit("no identifier found; title guess: "), F.coalesce("title", F.lit("none"))))
    found = resolve_dois(dois, stored, works, oa)
    found = found.withColumn("outcome", F.when(F.col("outcome") == "no-oa-route", "ok").otherwise(F.col("outcome")))  # the file is there already
    out = in_order(found.unionByName(resolve_preprints(papers, stored, entries, works)).unionByName(none))
    return out.join(known.select("id", "tier", "title"), "id")


def attach_into(records: DataFrame, files: DataFrame) -> DataFrame:
    """(key, path, outcome, file, arxiv, detail) of files meant for a record each: attached under a name, or a mismatch with both sides.

    records: key, doi, arxiv, title, author.  files: key, path, ident, file_title
    and facts.  A key with another number of files than one attaches none.
    """
    many = files.groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    met = files.join(many, "key").join(records, "key")
    fits = verify_into(F.col("doi"), F.col("arxiv"), F.col("title"), F.col("ident"), F.col("file_title"))
    judged = met.withColumn("v", F.when(F.col("n") == 1, fits))
    outcome = F.when(F.col("n") > 1, "error").when(F.col("v").isNull(), "mismatch").otherwise("ok")
    several = F.concat(F.lit("exactly one file is needed, but these are left: "), F.array_join("paths", ", "))
    detail = F.when(F.col("n") > 1, several).otherwise(mismatch(F.col("v"), F.col("facts"), record_facts(F.col("doi"), F.col("arxiv"), F.col("title"), F.col("author"))))
    return judged.select("key", "path", outcome.alias("outcome"), F.col("v.file").alias("file"), F.col("v.arxiv").alias("arxiv"), detail.alias("detail"))


def with_keys(outcomes: DataFrame, stored: DataFrame, order: str = "id") -> DataFrame:
    """outcomes with key: a free one for each draft, given out in the order of a column; a preview of what a real run would write.

    Requests that repeat an earlier one of the batch know the key of its draft.
    """
    keys = free_keys(outcomes.where("base is not null").select("base", F.col(order).alias("ord"), "id"), stored.select("key")).select("id", "key")
    keyed = outcomes.join(keys, "id", "left")
    if "first" not in outcomes.columns:
        return keyed
    return keyed.join(keys.select(F.col("id").alias("first"), F.col("key").alias("_known")), "first", "left").withColumn("known", F.coalesce("known", "_known")).select(*keyed.columns)


def draft_records(outcomes: DataFrame, when: str, action: str) -> DataFrame:
    """RECORD rows of the drafts among outcomes of with_keys(), each with a first log entry; rows without a free key are left out."""
    log = append_log(F.lit(None).cast("array<struct<when:string,action:string,detail:string>>"), F.lit(when), F.lit(action), F.coalesce("detail", F.lit("")))
    given = {
        "key": F.col("key"), "status": F.lit("draft"), "pending": F.col("pending"), "bibtex": F.struct("type", "fields"), "doi": F.col("doi"), "arxiv": F.col("arxiv"), "abstract": F.col("abstract"), "holdings": F.lit("none"), "log": log,
    }
    types = {f.name: f.dataType for f in StructType.fromDDL(RECORD).fields}
    return outcomes.where("base is not null and key is not null").select(*((given[n] if n in given else F.lit(None)).cast(types[n]).alias(n) for n in RECORD_FIELDS))


def events(outcomes: DataFrame, when: str, command: str) -> DataFrame:
    """One row of EVENT for each outcome (id, outcome, kind, source, ref or nothing, key)."""
    given = {"when": F.lit(when), "command": F.lit(command), "input": F.col("kind"), "ref": F.coalesce("key", "known"), "outcome": F.col("outcome"), "source": F.col("source")}
    return outcomes.select(*((given[n] if n in given else F.lit(None)).cast({"tier": "int", "duration_ms": "bigint"}.get(n, "string")).alias(n) for n in EVENT_FIELDS))
