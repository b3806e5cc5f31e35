"""Duplicates, keys, merging, export and identification of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import refs, tex
from vellum.schema import FIELD_ORDER
from vellum.session import cut

RATIO = 1.3
SIMILAR = 0.8


def find_duplicates(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, key): for rows of new (id, doi, arxiv_id) the first stored key (key, doi, arxiv_id) with the same DOI, whatever its case, or arXiv id.

    Two equi-joins, not one join on an OR; empty identifiers match nothing.
    """
    part = lambda c, f: new.where(F.coalesce(F.col(c), F.lit("")) != "").select("id", f(F.col(c)).alias("v")).join(stored.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(f(F.col(c)).alias("v")).agg(F.min("key").alias("key")), "v").select("id", "key")
    return part("doi", F.lower).unionByName(part("arxiv_id", lambda c: c)).groupBy("id").agg(F.min("key").alias("key"))


def free_keys(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new (base, ord) with key: the base, then base and a letter, skipping keys that are taken (key).

    A base has 27 keys; rows beyond them get null.
    """
    suffixes = [""] + [chr(97 + i) for i in range(26)]
    used = taken.select(F.regexp_replace("key", r"(?<=\d)[a-z]\z", "").alias("base"), "key").groupBy("base").agg(F.collect_set("key").alias("used"))
    ranked = new.withColumn("_r", F.row_number().over(Window.partitionBy("base").orderBy("ord"))).join(used, "base", "left")
    every = F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat("base", s))
    free = F.array_except(every, F.coalesce("used", F.array().cast("array<string>")))
    return ranked.withColumn("key", F.try_element_at(free, F.col("_r"))).drop("_r", "used")


def make_key(last: Column, year: Column) -> Column:
    """The folded last name with hyphens for spaces, letters only, and the year."""
    name = F.regexp_replace(tex.fold(F.replace(last, F.lit(" "), F.lit("-"))), r"[^a-z-]", "")
    return F.when(name.rlike("[a-z]"), F.concat_ws("_", name, year))


def auto_accept(hits: DataFrame) -> DataFrame:
    """(query, doi) of queries whose first hit is clear.

    hits: query, pos, doi, score, year, years (array of the query's years).  The
    first by position counts, not the highest score.
    """
    w = Window.partitionBy("query").orderBy("pos")
    first = hits.withColumn("_next", F.lead("score").over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    year_fits = (F.size("years") == 0) | F.array_contains("years", F.col("year"))
    return first.where((F.coalesce("doi", F.lit("")) != "") & (F.col("score") > 0) & (F.col("_next").isNull() | (F.col("score") >= RATIO * F.col("_next"))) & year_fits).select("query", "doi")


def holdings(names: Column) -> Column:
    pre = F.exists(names, lambda n: n.startswith("arxiv-"))
    pub = F.exists(names, lambda n: ~n.startswith("arxiv-") & n.endswith(".pdf"))
    return F.when(pre & pub, "both").when(pre, "preprint").when(pub, "published").otherwise("none")


def fill_gaps(fields: Column, extra: Column, names: tuple[str, ...] = ("journal", "volume", "number", "pages", "issn")) -> Column:
    """fields with empty ones of names taken from extra."""
    got = lambda m, n: F.nullif(F.try_element_at(m, F.lit(n)), F.lit(""))
    filled = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.coalesce(got(fields, n), got(extra, n)).alias("value")) for n in names)), lambda e: e["value"].isNotNull()))
    return F.map_concat(F.map_filter(fields, lambda k, v: ~k.isin(*names)), filled)


def merge(published: Column, preprint: Column, names: tuple[str, ...] = ("eprint", "archiveprefix", "primaryclass")) -> Column:
    """The published fields, overlaid by the preprint's identifiers."""
    over = F.map_filter(preprint, lambda k, v: k.isin(*names))
    return F.map_concat(F.map_filter(published, lambda k, v: ~F.map_contains_key(over, k)), over)


def bib_entry(key: Column, kind: Column, fields: Column) -> Column:
    """One export entry, fields in canonical order, then the others by name."""
    order = F.array(*map(F.lit, FIELD_ORDER))
    place = lambda e: F.struct(F.when(F.array_position(order, e["key"]) > 0, F.array_position(order, e["key"])).otherwise(len(FIELD_ORDER) + 1).alias("p"), e["key"].alias("k"), e["value"].alias("v"))
    lines = F.transform(F.array_sort(F.transform(F.map_entries(fields), place)), lambda e: F.concat(F.lit("  "), e["k"], F.lit(" = {"), e["v"], F.lit("},\n")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ""), F.lit("}\n"))


def metadata_values(subject: Column, keywords: Column, custom: Column, packet: Column) -> Column:
    """The metadata texts that identification reads: subject, keywords, custom entries by name, the packet's text; empty ones go."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(custom, F.create_map().cast("map<string,string>")))), lambda e: e["value"])
    return F.filter(F.concat(F.array(subject, keywords), entries, F.array(packet)), lambda v: F.coalesce(v, F.lit("")) != "")


def identify(typed_doi: Column, values: Column, pages: Column) -> Column:
    """struct<doi, arxiv_id, tier, version>: a typed DOI, then identifiers in metadata values, then in page texts; a DOI anywhere in a tier precedes arXiv stamps.

    tier is 0 and the others null where nothing is found.
    """
    first = lambda texts, f: F.try_element_at(F.filter(F.transform(texts, f), lambda x: x.isNotNull()), F.lit(1))
    typed, doi1, ax1, doi2, ax2 = F.nullif(typed_doi, F.lit("")), first(values, refs.find_doi), first(values, refs.find_arxiv_id), first(pages, refs.find_doi), first(pages, refs.find_arxiv_id)
    doi = F.coalesce(typed, doi1)
    tier = F.when(doi.isNotNull() | ax1.isNotNull(), 1).when(doi2.isNotNull() | ax2.isNotNull(), 2).otherwise(0)
    doi = F.when(tier == 1, doi).otherwise(doi2)
    arxiv = F.when(doi.isNull(), F.when(tier == 1, ax1).otherwise(ax2))
    return F.struct(doi.alias("doi"), arxiv["id"].alias("arxiv_id"), tier.alias("tier"), arxiv["version"].alias("version"))


def best_hits(guesses: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, title, doi, score) for guesses (id, title): the hit (query, pos, doi, title) of a guess's title whose title is most like it, the first of equal ones."""
    met = guesses.join(hits.select(F.col("query").alias("title"), "pos", "doi", F.col("title").alias("theirs")), "title")
    score = tex.similarity(tex.words(F.col("title")), tex.words(F.col("theirs")))
    best = F.min_by(F.struct("doi", "score"), F.struct(-F.col("score"), "pos"))
    return met.withColumn("score", score).groupBy("id", "title").agg(best.alias("b")).select("id", "title", "b.*")


def identify_by_title(papers: DataFrame, hits: DataFrame, least: float = SIMILAR) -> DataFrame:
    """papers (id, ident as identify() gives it, guess) with ident completed by tier 3 and with title: the guess of papers that nothing else identified.

    A guess is kept where no hit is like it enough; an empty one is no guess.
    """
    open_ = papers.where((F.col("ident.tier") == 0) & (F.coalesce("guess", F.lit("")) != "")).select("id", F.col("guess").alias("title"))
    found = best_hits(open_, hits).where(F.col("score") >= least).select("id", F.col("doi").alias("_doi"))
    joined = papers.join(found, "id", "left")
    third = F.struct(F.col("_doi").alias("doi"), F.col("ident.arxiv_id").alias("arxiv_id"), F.lit(3).alias("tier"), F.col("ident.version").alias("version"))
    title = F.when(F.col("ident.tier") == 0, F.nullif("guess", F.lit("")))
    return joined.withColumn("_title", title).withColumn("ident", F.when(F.col("_doi").isNotNull(), third).otherwise(F.col("ident"))).select(*papers.columns, F.col("_title").alias("title"))


def verify_into(doi: Column, arxiv: Column, title: Column, ident: Column, file_title: Column) -> Column:
    """struct<file, arxiv> if a file's ident and title fit a record (doi, arxiv struct<id, version>, title), else null.

    They fit by the same arXiv id, the same DOI whatever its case, or a title
    that is alike.  file is the name to store it under; arxiv is the record's
    reference afterwards, taken from the file where the record had none.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    same_arxiv = (text(ident["arxiv_id"]) != "") & (text(arxiv["id"]) == ident["arxiv_id"])
    same_doi = (text(ident["doi"]) != "") & (F.lower(text(doi)) == F.lower(ident["doi"]))
    same_title = tex.similarity(tex.words(text(title)), tex.words(text(file_title))) >= SIMILAR
    version = F.coalesce(ident["version"], F.lit(0))
    known = F.when(F.coalesce(same_arxiv, F.lit(False)) & (version <= 0), F.coalesce(arxiv["version"], F.lit(0))).otherwise(version)
    name = F.when(text(ident["arxiv_id"]) == "", "published.pdf").otherwise(F.concat(refs.arxiv_file_base(ident["arxiv_id"], known), F.lit(".pdf")))
    taken = F.struct(ident["arxiv_id"].alias("id"), version.cast("int").alias("version"))
    after = F.when(arxiv.isNull() & (text(ident["arxiv_id"]) != ""), taken).otherwise(arxiv)
    return F.when(F.coalesce(same_arxiv | same_doi | same_title, F.lit(False)), F.struct(name.alias("file"), after.alias("arxiv")))


def add_pending(pending: Column, note: Column) -> Column:
    """Notes that wait for somebody, one after another."""
    return F.concat_ws("; ", F.nullif(pending, F.lit("")), F.nullif(note, F.lit("")))


def append_log(log: Column, when: Column, action: Column, detail: Column) -> Column:
    entry = F.struct(when.alias("when"), action.alias("action"), detail.alias("detail"))
    return F.concat(F.coalesce(log, F.array().cast("array<struct<when:string,action:string,detail:string>>")), F.array(entry))


def missing_keys(spark, keys: list[str], records: DataFrame) -> DataFrame:
    """(key) of the asked keys, each once, that records lack."""
    return spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string").join(records.select("key"), "key", "left_anti")


def gate(new: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new (id, doi, arxiv_id, more) parted: rows that no stored record knows, and the others with the key that does."""
    known = find_duplicates(new.select("id", "doi", "arxiv_id"), stored)
    return new.join(known, "id", "left_anti"), new.join(known, "id")


def batch_summaries(outcomes: DataFrame, *by: str) -> DataFrame:
    """One row for each batch (columns by) of outcomes (input, outcome, detail): how many there were, how many failed, each failure's input and detail in order, and a line where any failed."""
    failed = F.col("outcome") != "ok"
    failures = F.sort_array(F.collect_list(F.when(failed, F.struct("input", "outcome", "detail"))))
    told = F.concat_ws(" ", F.col("failed").cast("string"), F.lit("of"), F.col("total").cast("string"), F.lit("left in place"))
    return outcomes.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"), failures.alias("failures")).withColumn("line", F.when(F.col("failed") > 0, told))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    return batch_summaries(outcomes)


WORD_ROWS = 4096


def _ranked_sets(sides: list[DataFrame]) -> list[DataFrame]:
    """For each of sides (id, w: distinct words), (id, w, n, x0, x1): w as sorted numbers of the words, the rarest first, n as array of how many sets hold each, and the parity of the numbers in 128 slots.

    Sides that are the same table are numbered once.
    """
    own = [next(i for i, e in enumerate(sides) if e is d) for d in sides]
    held = reduce(DataFrame.unionByName, [sides[i].select(F.lit(i).alias("side"), "id", F.explode("w").alias("word")) for i in sorted(set(own))])
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    numbered = cut(counts.orderBy("n", "word").withColumn("r", F.monotonically_increasing_id()), "title-words")
    slot = F.pmod(F.xxhash64("r"), F.lit(128)).cast("int")
    parity = lambda i: F.coalesce(F.bit_xor(F.when(F.floor(slot / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), slot % 64))), F.lit(0).cast("long")).alias(f"x{i}")
    sets = held.join(numbered, "word").groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("s"), parity(0), parity(1))
    sets = cut(sets.select("side", "id", F.col("s.r").alias("w"), F.col("s.n").alias("n"), "x0", "x1"), "title-sets")
    return [sets.where(F.col("side") == i).drop("side") for i in own]


def similar_titles(left: DataFrame, right: DataFrame, least: float = SIMILAR, word_rows: int = WORD_ROWS) -> DataFrame:
    """(left_id, right_id, similarity) of rows (id, words) whose distinct words have a Jaccard similarity of at least `least`.

    Words are ordered by how rare they are; two sets that alike share one of
    their first n - ceil(least * n) + 1 words, so only those are joined.  Sizes,
    and the places of the word in both sets, bound what a pair can share; slots
    in which the parities of two sets differ bound from below how many words
    only one of them has, so nearly all pairs that are not alike are told by two
    numbers each.  A pair is looked at where its first common word meets.  The
    right rows of a word that many sets hold are dealt to one task for
    `word_rows` sets each, and the left ones are sent to all of these.  Null and
    empty sets are like nothing.
    """
    sets = [d.select("id", F.array_distinct("words").alias("w")).where("size(w) > 0") for d in ((left,) if left is right else (left, right))]
    sets = _ranked_sets([sets[0], sets[-1]])

    def prefixes(d: DataFrame, side: str) -> DataFrame:
        first = F.slice("w", F.lit(1), F.size("w") - F.ceil(F.size("w") * least - 1e-9).cast("int") + 1)
        rows = d.select(F.col("id").alias(f"{side}_id"), F.col("w").alias(f"{side}_w"), F.size("w").alias(f"{side}_n"), *(F.col(x).alias(f"{side}_{x}") for x in ("x0", "x1")), "n", F.posexplode(first).alias(f"{side}_at", "word"))
        return rows.withColumn("_parts", F.ceil(F.col("n")[F.col(f"{side}_at")] / word_rows).cast("int")).drop("n")

    a = prefixes(sets[0], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    b = prefixes(sets[1], "right").withColumn("part", F.pmod(F.xxhash64("right_id"), F.col("_parts")).cast("int")).drop("_parts")
    n, m = F.col("left_n"), F.col("right_n")
    both = F.least(n - F.col("left_at"), m - F.col("right_at"))  # no word before this one is shared
    fits = (n >= m * least - 1e-9) & (m >= n * least - 1e-9) & (both * (1 + least) >= (n + m) * least - 1e-9)
    apart = sum((F.bit_count(F.col(f"left_{x}").bitwiseXOR(F.col(f"right_{x}"))) for x in ("x0", "x1")), F.lit(0))
    near = apart * (1 + least) <= (n + m) * (1 - least) + 1e-9
    here = ~F.arrays_overlap(F.slice("left_w", F.lit(1), F.col("left_at")), F.slice("right_w", F.lit(1), F.col("right_at")))
    shared = F.size(F.array_intersect("left_w", "right_w"))
    met = a.join(b.hint("merge"), (a["word"] == b["word"]) & (a["part"] == b["part"]) & fits & near & here & (shared * (1 + least) >= (n + m) * least - 1e-9))
    return met.select("left_id", "right_id", (shared / (n + m - shared)).alias("similarity"))


def best_titles(left: DataFrame, right: DataFrame, least: float = SIMILAR, word_rows: int = WORD_ROWS) -> DataFrame:
    """left (id, words) with best, the id of the row of right (id, words) whose words are most like it, and similarity; of equal ones the smallest id, null where none reaches `least`.

    Rows of equal word sets are one on either side, so copies of a title are
    compared once; ids of right are not null.  Empty and null word sets have no
    best one.
    """
    sets = lambda d: d.select("id", F.array_sort(F.array_distinct(F.coalesce("words", F.array().cast("array<string>")))).alias("_w"))
    classes = lambda d: sets(d).groupBy("_w").agg(F.min("id").alias("id"))
    mine = cut(sets(left).groupBy("_w").agg(F.count("*").alias("_m")).select(F.monotonically_increasing_id().alias("_c"), "_w"), "title-classes")
    pairs = similar_titles(mine.select(F.col("_c").alias("id"), F.col("_w").alias("words")), classes(right).select("id", F.col("_w").alias("words")), least, word_rows)
    best = pairs.groupBy(F.col("left_id").alias("_c")).agg(F.min_by(F.struct("right_id", "similarity"), F.struct(-F.col("similarity"), "right_id")).alias("_b"))
    found = mine.join(best, "_c").select("_w", F.col("_b.right_id").alias("best"), F.col("_b.similarity").alias("similarity"))
    own = left.withColumn("_w", F.array_sort(F.array_distinct(F.coalesce("words", F.array().cast("array<string>")))))
    return own.join(found, "_w", "left").select(*left.columns, "best", "similarity")


def union_candidates(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """One table of candidates of several services, in their order (rank)."""
    out = [d.select(F.lit(i).alias("rank"), F.lit(n).alias("source"), *d.columns) for i, (n, d) in enumerate(parts)]
    result = out[0]
    for d in out[1:]:
        result = result.unionByName(d, allowMissingColumns=True)
    return result
