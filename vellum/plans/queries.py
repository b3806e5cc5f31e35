"""Queries over the supplied tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import names, refs, tex
from vellum.operators import check, records, search
from vellum.plans.registry import QUERIES, SQL, registered
from vellum.session import cut, ship_package, table
from vellum.streaming import events as event_jobs

__all__ = ["QUERIES", "SQL"]


def _sql_fold(c: str) -> str:
    return f"replace(replace(replace(replace(lower(strip_accents({c})), 'ß', 'ss'), 'æ', 'ae'), 'ø', 'o'), 'ł', 'l')"


def _sql_term(folded: str, low: str) -> str:
    contains = lambda c, t: f"contains({c}, '{t}')"
    return f"greatest(case when {contains('key', folded)} then 5e0 end, case when {contains('author', folded)} then 3e0 end, case when {contains('title', folded)} then 2e0 end, case when {contains('venue', folded)} then 1e0 end, case when {contains('abstract', folded)} then 1e0 end)"


_SQL_DOCS = f"select 'doc' || doc_id as key, {_sql_fold('source')} as author, {_sql_fold('string_split(text, chr(10))[1]')} as title, {_sql_fold('lang')} as venue, {_sql_fold('text')} as abstract, doc_id from documents"


def _doc_records(docs: DataFrame) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return docs.select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("key"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv"), F.col("source").alias("author"), title.alias("title"), F.lit(None).cast("string").alias("year"), F.col("lang").alias("venue"), F.col("text").alias("abstract"))


@registered(f"with d as ({_SQL_DOCS}) select key, {_sql_term('reeu', 'réeu')} + {_sql_term('src1', 'src1')} as score from d where {_sql_term('reeu', 'réeu')} + {_sql_term('src1', 'src1')} is not null")
def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_doc_records(table(spark, sf_dir, "documents")), ["Réeu", "src1"]).select("key", "score")


@registered(f"with d as ({_SQL_DOCS}) select key, {_sql_term('the', 'the')} as score, quality from d join labels using (doc_id) where {_sql_term('the', 'the')} is not null and quality = 1")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_doc_records(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id"), ["the"])
    return found.where("quality = 1").select("key", "score", "quality")


@registered(
    f"with t as (select doc_id, list_sort(list_distinct(regexp_extract_all({_sql_fold('string_split(text, chr(10))[1]')}, '[\\p{{L}}\\p{{Nd}}]+'))) as w from documents), "
    "s as (select a.doc_id, b.doc_id as best, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as similarity from t a join t b on a.doc_id % 2 = 0 and b.doc_id % 2 = 1 and len(a.w) > 0 and len(b.w) > 0), "
    "r as (select *, row_number() over (partition by doc_id order by similarity desc, best) as n from s where similarity >= 0.8) "
    "select doc_id, best, similarity from t left join (select doc_id, best, similarity from r where n = 1) using (doc_id) where doc_id % 2 = 0"
)
def best_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the title of every second document the most similar one among all others."""
    titles = cut(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_sort(F.array_distinct(tex.words(F.substring_index("text", "\n", 1)))).alias("words")), "titles")
    return records.best_titles(titles.where("id % 2 = 0"), titles.where("id % 2 = 1")).select(F.col("id").alias("doc_id"), "best", "similarity")


@registered(f"select doc_id, md5({_sql_fold('text')}) as folded from documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tex.fold(F.col("text"))).alias("folded"))


@registered(f"select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_distinct from (select doc_id, regexp_extract_all({_sql_fold('text')}, '[\\p{{L}}\\p{{Nd}}]+') as w from documents)")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", tex.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@registered(
    f"with t as (select doc_id, list_sort(list_distinct(regexp_extract_all({_sql_fold('string_split(text, chr(10))[1]')}, '[\\p{{L}}\\p{{Nd}}]+'))) as w from documents), "
    "c as (select w, min(doc_id) as class_id, count(*) as m from t group by w), "
    "p as (select a.class_id, sum(b.m) as others from c a join c b on a.class_id <> b.class_id and len(a.w) > 0 and len(b.w) > 0 and len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(list_concat(a.w, b.w))) group by a.class_id) "
    "select doc_id, class_id, cast(m - 1 + coalesce(others, 0) as bigint) as n_links from t join c using (w) left join p using (class_id)"
)
def title_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, the class of titles with its words, and how many other documents have a title that is alike."""
    titles = cut(table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(tex.words(F.substring_index("text", "\n", 1)))).alias("words")), "titles")
    classes = cut(titles.groupBy("words").agg(F.min("doc_id").alias("id"), F.count("*").alias("m")), "title-classes")
    pairs = records.similar_titles(classes, classes).where("left_id <> right_id")
    others = pairs.join(classes.select(F.col("id").alias("right_id"), "m"), "right_id").groupBy(F.col("left_id").alias("id")).agg(F.sum("m").alias("others"))
    facts = classes.join(others, "id", "left").select("words", F.col("id").alias("class_id"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return titles.join(facts, "words").select("doc_id", "class_id", "n_links")


_REF = "case doc_id % 6 when 0 then ' https://doi.org/10.1234/doc.' || doc_id when 1 then 'DOI: 10.5555/x' || doc_id when 2 then 'https://arxiv.org/abs/2101.' || lpad(cast(doc_id % 100000 as varchar), 5, '0') || 'v2' when 3 then 'arXiv:math.AG/' || lpad(cast(doc_id % 10000000 as varchar), 7, '0') when 4 then 'https://dx.doi.org/10.1/' || doc_id else source || ' ' || lang end"


@registered(
    f"select doc_id, case when doc_id % 6 < 2 then 'doi' when doc_id % 6 < 4 then 'arxiv' else 'text' end as kind, case doc_id % 6 when 0 then '10.1234/doc.' || doc_id when 1 then '10.5555/x' || doc_id end as doi, "
    f"case doc_id % 6 when 2 then '2101.' || lpad(cast(doc_id % 100000 as varchar), 5, '0') when 3 then 'math.AG/' || lpad(cast(doc_id % 10000000 as varchar), 7, '0') end as arxiv_id, case doc_id % 6 when 2 then 2 when 3 then 0 end as version, case when doc_id % 6 >= 4 then trim({_REF}) end as text from documents"
)
def parse_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.expr(_REF.replace("varchar", "string"))
    return table(spark, sf_dir, "documents").select("doc_id", refs.parse_ref(ref).alias("r")).select("doc_id", "r.*")


@registered("select page_id, nullif(rtrim(regexp_extract(html || ' (see doi 10.1234/page.' || page_id || ').', '(10\\.\\d{4,9}/[^\\s\"<>]+)', 1), '.,;)'), '') as doi, url from pages")
def find_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("html", F.lit(" (see doi 10.1234/page."), "page_id", F.lit(")."))
    return table(spark, sf_dir, "pages").select("page_id", refs.find_doi(text).alias("doi"), "url")


@registered("select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then l_partkey || '--' || l_suppkey else l_partkey || '--' || l_suppkey end as pages from lineitem")
def normalize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    dash = F.when(F.col("l_linenumber") % 2 == 0, "--").otherwise("-")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tex.normalize_pages(F.concat("l_partkey", dash, "l_suppkey")).alias("pages"))


@registered(
    "with s as (select c_name as key, '10.1000/n' || c_nationkey || '.' || c_custkey % 10 as doi, '2101.' || lpad(cast(c_custkey % 700 as varchar), 5, '0') as arxiv_id from customer), "
    "n as (select s_suppkey as id, '10.1000/N' || s_nationkey || '.' || s_suppkey % 20 as doi, '2101.' || lpad(cast(s_suppkey as varchar), 5, '0') as arxiv_id from supplier) "
    "select id, min(key) as key from n join s on lower(n.doi) = lower(s.doi) or n.arxiv_id = s.arxiv_id group by id"
)
def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.expr("'10.1000/n' || c_nationkey || '.' || c_custkey % 10").alias("doi"), F.expr("'2101.' || lpad(cast(c_custkey % 700 as string), 5, '0')").alias("arxiv_id"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("'10.1000/N' || s_nationkey || '.' || s_suppkey % 20").alias("doi"), F.expr("'2101.' || lpad(cast(s_suppkey as string), 5, '0')").alias("arxiv_id"))
    return records.find_duplicates(new, stored)


@registered(
    "with n as (select regexp_replace(lower(replace(n_name, ' ', '-')), '[^a-z-]', '', 'g') || '_19' || lpad(cast(s_suppkey % 10 as varchar), 2, '0') as base, s_suppkey as ord from supplier join nation on s_nationkey = n_nationkey), "
    "t as (select regexp_replace(lower(replace(n_name, ' ', '-')), '[^a-z-]', '', 'g') || '_19' || lpad(cast(n_regionkey as varchar), 2, '0') as base, case when n_nationkey % 2 = 0 then '' else 'a' end as suffix from nation), "
    "u as (select base, list(base || suffix) as used from t group by base), r as (select base, ord, row_number() over (partition by base order by ord) as r from n) "
    "select base, ord, list_filter(list_transform(['','a','b','c','d','e','f','g','h','i','j','k','l','m','n','o','p','q','r','s','t','u','v','w','x','y','z'], lambda s: base || s), lambda k: not list_contains(coalesce(used, []), k))[r] as key from r left join u using (base)"
)
def free_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    new = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    new = new.select(records.make_key(F.col("n_name"), F.expr("'19' || lpad(cast(s_suppkey % 10 as string), 2, '0')")).alias("base"), F.col("s_suppkey").alias("ord"))
    taken = nation.select(F.concat(records.make_key(F.col("n_name"), F.expr("'19' || lpad(cast(n_regionkey as string), 2, '0')")), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("a")).alias("key"))
    return records.free_keys(new, taken)


@registered(
    "with h as (select l_orderkey as query, '10.1/' || l_partkey as doi, l_extendedprice as score, year(l_shipdate) as y, year(o_orderdate) as oy, lead(l_extendedprice) over w as nxt, row_number() over w as r "
    "from lineitem join orders on l_orderkey = o_orderkey window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)) select query, doi from h where r = 1 and score > 0 and (nxt is null or score >= 1.3 * nxt) and y = oy"
)
def auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return records.auto_accept(hits.select(F.col("l_orderkey").alias("query"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), F.concat(F.lit("10.1/"), "l_partkey").alias("doi"), F.col("l_extendedprice").alias("score"), F.year("l_shipdate").alias("year"), F.array(F.year("o_orderdate")).alias("years")))


_FILE = "case p_partkey % 3 when 0 then 'arxiv-' || p_partkey || '.pdf' when 1 then p_name || '.pdf' else p_type || '.txt' end"


@registered(f"select p_brand, p_size, case when a and b then 'both' when a then 'preprint' when b then 'published' else 'none' end as holdings from (select p_brand, p_size, bool_or(starts_with(f, 'arxiv-')) as a, bool_or(not starts_with(f, 'arxiv-') and ends_with(f, '.pdf')) as b from (select p_brand, p_size, {_FILE} as f from part) group by p_brand, p_size)")
def holdings_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.collect_set(F.expr(_FILE)).alias("names"))
    return files.select("p_brand", "p_size", records.holdings(F.col("names")).alias("holdings"))


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.explode(F.expr("sequence(1, 3)")).alias("i")).select("key", F.concat(F.lit("line"), "i").alias("name"))
    return versions, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("line"), "l_linenumber").alias("name")).distinct()


@registered("with v as (select o_orderkey as key, 'line' || i as name from orders, range(1, 4) t(i)) select key, name from v where not exists (select 1 from lineitem where l_orderkey = key and 'line' || l_linenumber = name)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.missing_files(*_files(spark, sf_dir))


@registered("select distinct l_orderkey as key, 'line' || l_linenumber as name from lineitem where l_linenumber > 3 or l_orderkey not in (select o_orderkey from orders)")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.orphan_files(*_files(spark, sf_dir))


@registered("select 0 as rank, 'supplier' as source, s_name as title, s_nationkey as venue from supplier union all select 1, 'customer', c_name, c_nationkey from customer union all select 2, 'part', p_name, null from part")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.col("s_nationkey").alias("venue"))
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), F.col("c_nationkey").alias("venue"))
    return records.union_candidates([("supplier", s), ("customer", c), ("part", table(spark, sf_dir, "part").select(F.col("p_name").alias("title")))])


@registered("select p_partkey, p_brand as title, p_type as journal, p_name as eprint from part")
def merge_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.create_map(F.lit("title"), "p_brand", F.lit("journal"), "p_type", F.lit("eprint"), F.lit("old"))
    merged = records.merge(published, F.create_map(F.lit("title"), F.lit("other"), F.lit("eprint"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", merged.alias("m")).select("p_partkey", *(F.try_element_at("m", F.lit(n)).alias(n) for n in ("title", "journal", "eprint")))


@registered("select doc_id, case when quality = 1 then lang else source end as journal, 'v' || coalesce(toxic, 0) as volume, null::varchar as pages from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id)")
def fill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(known, "doc_id", "left")
    fields = F.create_map(F.lit("journal"), F.when(F.col("quality") == 1, F.col("lang")).otherwise(F.lit("")), F.lit("pages"), F.lit(""))
    extra = F.create_map(F.lit("journal"), "source", F.lit("volume"), F.concat(F.lit("v"), F.coalesce("toxic", F.lit(0)).cast("string")))
    return rows.select("doc_id", records.fill_gaps(fields, extra).alias("m")).select("doc_id", *(F.try_element_at("m", F.lit(n)).alias(n) for n in ("journal", "volume", "pages")))


@registered("select 'part' || p_partkey as key, '@misc{part' || p_partkey || ',' || chr(10) || '  author = {' || p_brand || '},' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  year = {' || p_size || '},' || chr(10) || '  issn = {' || p_type || '},' || chr(10) || '}' || chr(10) as entry from part")
def bib_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("part"), "p_partkey")
    fields = F.create_map(F.lit("issn"), "p_type", F.lit("year"), F.col("p_size").cast("string"), F.lit("title"), "p_name", F.lit("author"), "p_brand")
    return table(spark, sf_dir, "part").select(key.alias("key"), records.bib_entry(key, F.lit("misc"), fields).alias("entry")).orderBy("key")


@registered(
    "select page_id, case page_id % 4 when 0 then '10.1111/t.' || page_id when 1 then '10.2222/v.' || page_id when 2 then '10.3333/p.' || page_id end as doi, case page_id % 4 when 3 then 'math/' || lpad(cast(page_id % 10000000 as varchar), 7, '0') end as arxiv_id, case page_id % 4 when 2 then 2 when 3 then 2 else 1 end as tier, case page_id % 4 when 3 then 1 end as version from pages"
)
def identify_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda s: F.expr(s)
    typed, value = e("case page_id % 4 when 0 then '10.1111/t.' || page_id end"), e("url || case page_id % 4 when 1 then ' doi:10.2222/v.' || page_id || ');' else '' end")
    text = e("html || case page_id % 4 when 2 then ' 10.3333/p.' || page_id || '.' when 3 then ' arXiv:math/' || lpad(cast(page_id % 10000000 as string), 7, '0') || 'v1 [x]' else '' end")
    return table(spark, sf_dir, "pages").select("page_id", records.identify(typed, F.array(value), F.array(text)).alias("i")).select("page_id", "i.*")


@registered(
    """select date_trunc('hour', ts) as hour, event_type as command, case when cast(json_extract_string(props, '$.k') as int) < 50 then 'ok' else 'error' end as outcome, count(*) as events,
    avg(cast(json_extract_string(props, '$.k') as int)) as mean_ms from events group by all"""
)
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed outcomes of the event log, as the streaming job makes them, over a table."""
    k = F.get_json_object("props", "$.k").cast("int")
    log = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("when"), F.col("event_type").alias("command"), F.when(k < 50, "ok").otherwise("error").alias("outcome"), k.alias("duration_ms"))
    return event_jobs.outcomes(log).select(F.col("window.start").alias("hour"), "command", "outcome", "events", "mean_ms")


@registered("select doc_id, case when length(text) > 100 then substr(text, 1, 99) || '…' else text end as line from documents")
def truncate_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tex.truncate(F.col("text"), 100).alias("line"))


# How TeX writes accents, each with the letters that have it, and letters with macros of their own.
_ACCENTS = (
    ("`", "ÀÈÌÒÙàèìòù"), ("''", "ÁÉÍÓÚÝáéíóúýĆćĹĺŃńŔŕŚśŹź"), ("^", "ÂÊÎÔÛâêîôûĈĉĜĝĤĥĴĵŜŝŴŵŶŷ"), ("~", "ÃÑÕãñõĨĩŨũ"), ('"', "ÄËÏÖÜäëïöüÿŸ"), ("=", "ĀāĒēĪīŌōŪū"), (".", "ĊċĖėĠġİŻż"),
)
_NAMED_ACCENTS = (("c", "ÇçĢģĶķĻļŅņŖŗŞşŢţ"), ("u", "ĂăĔĕĞğĬĭŎŏŬŭ"), ("v", "ČčĎďĚěĽľŇňŘřŠšŤťŽž"), ("H", "ŐőŰű"))
_OWN_MACROS = (("ss", "ß"), ("ae", "æ"), ("AE", "Æ"), ("o", "ø"), ("O", "Ø"), ("aa", "å"), ("AA", "Å"), ("l", "ł"), ("L", "Ł"))
_ENCODED = (
    "case " + " ".join(f"when contains('{letters}', c) then '{{\\{mark}' || strip_accents(c) || '}}'" for mark, letters in _ACCENTS) + " "
    + " ".join(f"when contains('{letters}', c) then '{{\\{mark}{{' || strip_accents(c) || '}}}}'" for mark, letters in _NAMED_ACCENTS) + " "
    + " ".join(f"when c = '{letter}' then '{{\\{macro}}}'" for macro, letter in _OWN_MACROS) + r" when contains('&%#_', c) then '\' || c when c = '–' then '--' when c = '—' then '---' else c end"
)


@registered(f"select doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: {_ENCODED}), '')) as encoded from documents")
def tex_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tex.encode(F.col("text"))).alias("encoded"))


@registered(
    """with a as (select c_custkey, string_split(replace(c_name, '#', '') || ', ' || c_mktsegment || ' and van der ' || c_mktsegment || ', Jr, Jan', ' and ') as a from customer),
    p as (select c_custkey, len(a) as n_names, string_split(a[1], ', ') as x, string_split(a[2], ', ') as y from a)
    select c_custkey, n_names, x[2] || ' ' || x[1] as first_full, y[3] || ' ' || y[1] || ', ' || y[2] as second_full from p"""
)
def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = F.concat(F.regexp_replace("c_name", "#", ""), F.lit(", "), "c_mktsegment", F.lit(" and van der "), "c_mktsegment", F.lit(", Jr, Jan"))
    n = table(spark, sf_dir, "customer").select("c_custkey", names.parse_names(authors)["names"].alias("n"))
    return n.select("c_custkey", F.size("n").alias("n_names"), names.full_name(F.col("n")[0]).alias("first_full"), names.full_name(F.col("n")[1]).alias("second_full"))


from vellum.plans import papers, stores  # noqa: E402, F401  (registers their queries)
