"""Scored conjunctive search over records, and what it prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import tex
from vellum.functions.names import last_name
from vellum.operators.drafts import hit_flags

# What a match in a field is worth, and the length of a hit's line.
WEIGHTS = {"key": 5.0, "doi": 5.0, "arxiv": 5.0, "author": 3.0, "title": 2.0, "year": 2.0, "venue": 1.0, "abstract": 1.0}
LINE = 100
AS_WRITTEN = ("doi", "arxiv")


def record_fields(records: DataFrame) -> DataFrame:
    """records (RECORD) with the columns of WEIGHTS that a search looks at; the venue is journal and booktitle.

    Columns of records that already have such a name, key and doi, stay as they
    are; arxiv becomes its id.
    """
    field = lambda n: F.coalesce(F.try_element_at("bibtex.fields", F.lit(n)), F.lit(""))
    made = {"arxiv": F.col("arxiv.id"), "author": field("author"), "title": field("title"), "year": field("year"), "venue": F.trim(F.concat_ws(" ", field("journal"), field("booktitle")))}
    return records.withColumns(made)


def _weight(term: str, folded: str, f: Column) -> Column:
    """The largest weight of the folded fields f that hold the term, null if none does."""
    low = term.lower()
    rules = []
    for name, w in WEIGHTS.items():
        if name in AS_WRITTEN:
            hit = F.contains(f[name], F.lit(low)) if low else F.lit(False)
        else:
            hit = (f[name] == folded if name == "year" else F.contains(f[name], F.lit(folded))) if folded else F.lit(False)
        rules.append(F.when(hit, F.lit(w)))
    return F.greatest(*rules)


def _total(scores: Column) -> Column:
    """The sum of the terms' scores, null if a term has none."""
    return F.aggregate(scores, F.lit(0.0), lambda a, b: a + b)


def folded_fields() -> Column:
    """The columns of WEIGHTS as terms are compared with them; nulls are empty."""
    wanted = {n: F.coalesce(F.col(n), F.lit("")) for n in WEIGHTS}
    return F.struct(*((F.lower(c) if n in AS_WRITTEN else tex.fold(c)).alias(n) for n, c in wanted.items()))


def score_of(fields: Column, terms: list[str], folded: list[str]) -> Column:
    """An array of the score of folded_fields(), empty if a term has none."""
    score = lambda f: _total(F.array(*(_weight(t, w, f) for t, w in zip(terms, folded, strict=True))) if terms else F.array(F.lit(0.0)))
    return F.filter(F.transform(F.array(fields), score), lambda s: s.isNotNull())


def search(records: DataFrame, terms: list[str], k: int | None = None) -> DataFrame:
    """records that match every term in some field, with score, the best first; the first k of them, if k is given.

    records has the columns of WEIGHTS as strings.  A term is folded as fields
    are, TeX included; it takes its best field and the score is the sum.  The
    score is made inside one generator, so that a filter on it folds no field a
    second time.  For the first k, tasks keep k keys with their scores each, and
    only the records of those that are left are fetched; keys are unique then.
    """
    folded = list(records.sparkSession.range(1).select(*(tex.fold(F.lit(t)) for t in terms)).first()) if terms else []
    if k is not None:
        best = records.select("key", F.explode(score_of(folded_fields(), terms, folded)).alias("score")).orderBy(F.desc("score"), "key").limit(k)
        return records.join(F.broadcast(best), "key").select(*records.columns, "score").orderBy(F.desc("score"), "key")
    hits = records.select("*", F.explode(score_of(folded_fields(), terms, folded)).alias("score"))
    return hits.repartition("key").orderBy(F.desc("score"), "key")  # the sort samples its input first: it reads the hits twice, not the folding


def who_year(who: Column, year: Column) -> Column:
    """`Name (year)`, or what is known of it."""
    who, year = F.coalesce(who, F.lit("")), F.coalesce(year, F.lit(""))
    return F.concat_ws(" ", F.nullif(who, F.lit("")), F.when(year != "", F.concat(F.lit("("), year, F.lit(")"))))


def hit_line(key: Column, who: Column, year: Column, title: Column, holdings: Column, flags: Column) -> Column:
    """One line of LINE characters at most for a hit; only the title is cut, so many flags may make it longer."""
    head, tail = _ends(key, who, year, holdings, flags)
    return _fitted(head, title, tail)


def _ends(key: Column, who: Column, year: Column, holdings: Column, flags: Column) -> tuple[Column, Column]:
    """What a hit's line says before its title, and after it."""
    said = who_year(who, year)
    head = F.concat(key, F.lit("  "), F.when(said != "", F.concat(said, F.lit("  "))).otherwise(""))
    return head, F.concat(F.lit("  ["), holdings, F.lit("]"), F.array_join(F.transform(flags, lambda f: F.concat(F.lit(" ["), f, F.lit("]"))), ""))


def _fitted(head: Column, title: Column, tail: Column) -> Column:
    room = F.lit(LINE) - F.length(head) - F.length(tail)
    shown = F.when(room <= 0, "").when(F.length(title) > room, F.concat(F.substring(title, F.lit(1), room - 1), F.lit("…"))).otherwise(title)
    return F.concat(head, shown, tail)


def hit_report(hits: DataFrame) -> DataFrame:
    """(key, score, line, json) of hits: records with record_fields() and score.

    The decoded title and the first author's name are made inside a generator,
    so that the many places of a line that look at them make them once.
    """
    made = F.struct(tex.decode(F.col("title")).alias("_title"), last_name(F.col("author")).alias("_who"), hit_flags(F.col("status"), F.col("versions")).alias("_flags"))
    hits = hits.select("*", F.inline(F.array(made)))
    title, flags = F.col("_title"), F.col("_flags")
    parts = F.struct(*(c.alias(n) for n, c in zip(("_head", "_tail"), _ends(F.col("key"), F.col("_who"), F.col("year"), F.coalesce("holdings", F.lit("")), flags), strict=True)))
    hits = hits.select("*", F.inline(F.array(parts)))
    line = _fitted(F.col("_head"), title, F.col("_tail"))
    shown = F.struct("key", "score", tex.decode(F.col("author")).alias("authors"), title.alias("title"), "year", "venue", "doi", "arxiv", "status", "holdings", flags.alias("flags"))
    return hits.select("key", "score", line.alias("line"), F.to_json(shown).alias("json"))

