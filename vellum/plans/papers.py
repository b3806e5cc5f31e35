"""Queries over records that are made from the supplied tables, and the same in SQL.

What a record is made of is one select for both sides; what is asked of it is
stated in SQL from its definition, with windows over characters where the
library walks through a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import pages, refs, tex
from vellum.operators import check, drafts, records, resolve, search
from vellum.plans.registry import registered, rows_of
from vellum.session import ship_package
from vellum.sources import services

PAPERS = """
select 'doc' || doc_id as key, case when doc_id % 19 = 0 then 'dir' || doc_id else 'doc' || doc_id end as dir_key,
  case when doc_id % 7 = 0 then 'draft' when doc_id % 11 = 0 then 'odd' else 'clean' end as status,
  case when doc_id % 21 = 0 then 'wait' else '' end as pending,
  case when doc_id % 5 = 0 then 'essay' else 'article' end as kind,
  case doc_id % 8
    when 0 then replace(line, ' th', ' {Th}') when 1 then 'a {{X} Y} zQ ' || line when 2 then 'b } $X$ cD ' || line when 3 then replace(line, ' ', chr(9))
    when 4 then line || ' ' || chr(92) || 'foo{x} ' || chr(92) || 'ss & 50%' when 5 then line || ' {oPen' when 6 then '' else line end as title,
  case when doc_id % 13 = 0 then 'a, b, c, ' || lang when doc_id % 13 = 1 then '' else 'Doe, ' || upper(lang) || ' and van der Berg, ' || source end as author,
  case when doc_id % 4 = 0 then '' else source end as journal,
  case when doc_id % 2 = 0 then '1-' || n_chars else '1--' || n_chars end as pages,
  case doc_id % 9 when 0 then '' when 1 then '10.12/' || doc_id else '10.1234/' || doc_id end as doi,
  case doc_id % 10 when 0 then '10.1234/other' when 1 then '10.1234/' || doc_id else '' end as doi_field,
  case doc_id % 6 when 0 then '2101.' || lpad(cast(doc_id % 100000 as string), 5, '0') when 1 then 'bad' || doc_id else '' end as arxiv_id,
  case doc_id % 12 when 0 then '2101.00000' else '' end as eprint,
  case when doc_id % 17 = 0 then 'some' else 'none' end as holdings,
  case when doc_id % 23 = 0 then 'unknown member colour' end as load_error, doc_id
from (select *, split_part(text, chr(10), 1) as line from documents) d
"""


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rows_of(spark, sf_dir, PAPERS, "documents")
    fields = {n: F.col(n) for n in ("author", "title", "journal", "pages", "eprint")} | {"year": F.lit("2001"), "doi": F.col("doi_field")}
    bibtex = F.struct(F.col("kind").alias("type"), F.create_map(*(x for n, c in fields.items() for x in (F.lit(n), c))).alias("fields"))
    arxiv = F.when(F.col("arxiv_id") != "", F.struct(F.col("arxiv_id").alias("id"), F.lit(1).alias("version")))
    version = F.struct(F.lit("").alias("acquired"), F.lit("").alias("source"), (F.col("doc_id") % 2 == 0).alias("deprecated"), F.lit("").alias("note"))
    listed = F.transform(F.expr("sequence(1, 1 + cast(doc_id % 3 as int))"), lambda i: F.concat(F.lit("v"), i.cast("string")))
    versions = F.map_from_arrays(listed, F.transform(listed, lambda _: version))
    return p.select("key", "dir_key", "load_error", "status", "pending", bibtex.alias("bibtex"), "doi", arxiv.alias("arxiv"), "holdings", F.lit("").alias("abstract"), versions.alias("versions"), "doc_id")


_CHARS = r"""
  c as (select dir_key, i, substr(title, i, 1) as ch from (select dir_key, title, unnest(range(1, length(title) + 1)) as i from p)),
  s as (select *, sum(case ch when '{' then 1 when '}' then -1 else 0 end) over (partition by dir_key order by i) as total from c),
  d as (select *, total - least(0, min(total) over (partition by dir_key order by i)) as depth from s),
  b as (select *, regexp_full_match(ch, '[\s\p{Z}\x{85}]') and depth = 0 as gap from d),
  n as (select *, sum(gap::int) over (partition by dir_key order by i) as word from b),
  w as (select dir_key, word, string_agg(ch, '' order by i) filter (not gap) as raw, string_agg(ch, '' order by i) filter (not gap and depth = 0 and ch not in ('{', '}')) as bare from n group by dir_key, word),
  k as (select *, row_number() over (partition by dir_key order by word) as r from w where raw is not null)
"""
_RULES = r"""
  select dir_key as key, 'L2' as rule, 'error' as severity, 'key differs from its directory' as msg from p where key <> dir_key
  union all select dir_key, 'R1', 'error', 'unknown entry type ' || kind from p where kind = 'essay'
  union all select dir_key, 'R2', 'error', 'missing ' || g from p, (values ('author'), ('title'), ('journal')) v(g) where kind = 'article' and case g when 'author' then author when 'title' then title else journal end = ''
  union all select dir_key, 'R3', 'error', 'author can''t be parsed' from p where author not like '% and %' and length(author) - length(replace(author, ',', '')) > 2
  union all select dir_key, 'R4', 'error', 'unknown macro ' || m || ' in title' from (select dir_key, unnest(regexp_extract_all(title, '\\([A-Za-z]+)', 1)) as m from p) where m not in ('ss', 'o', 'O', 'ae', 'AE', 'aa', 'AA', 'l', 'L')
  union all select dir_key, 'R5', 'error', 'unbalanced braces in title' from s group by dir_key having min(total) < 0 or arg_max(total, i) <> 0
  union all select dir_key, 'R5a', 'warning', 'raw ' || m || ' in title' from p, (values ('&'), ('%')) v(m) where contains(regexp_replace(title, '\\.|\$[^$]*\$', '', 'g'), m)
  union all select dir_key, 'R6', 'error', 'bad DOI ' || doi from p where doi <> '' and not regexp_full_match(doi, '10\.\d{4,9}/\S+')
  union all select dir_key, 'R7', 'error', 'bad arXiv id ' || arxiv_id from p where arxiv_id <> '' and not regexp_full_match(arxiv_id, '\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7}')
  union all select dir_key, 'R8', 'error', 'bad status ' || status from p where status = 'odd'
  union all select dir_key, 'R8', 'error', 'bad holdings ' || holdings from p where holdings = 'some'
  union all select dir_key, 'R9', 'warning', 'page range with a single hyphen' from p where pages like '1-%' and pages not like '1--%'
  union all select dir_key, 'R10', 'warning', 'capital outside braces: ' || raw from k where r > 1 and regexp_matches(bare, '\p{Lu}')
  union all select dir_key, 'R11', 'warning', 'article without DOI' from p where kind = 'article' and doi = '' and doi_field = ''
  union all select dir_key, 'R12', 'warning', 'draft' from p where status = 'draft'
  union all select dir_key, 'R13', 'error', 'DOI differs from its field' from p where doi <> '' and doi_field <> '' and doi <> doi_field
  union all select dir_key, 'R13', 'error', 'arXiv id differs from its field' from p where arxiv_id <> '' and eprint <> '' and arxiv_id <> eprint
"""
_PROBLEMS = f"with p as ({PAPERS}), {_CHARS}, problems as ({_RULES})"


def _problems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ship_package(spark)
    papers = paper_records(spark, sf_dir)
    return papers, check.problems(papers)


@registered(f"{_PROBLEMS} select * from problems")
def check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problems(spark, sf_dir)[1].select("key", "rule", "severity", "msg")


@registered(f"{_PROBLEMS} select key, count(*) filter (severity = 'error') as errors, count(*) as problems from problems group by key")
def check_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.error_counts(_problems(spark, sf_dir)[1])


@registered(f"{_PROBLEMS} select dir_key as key from p where status = 'draft' and pending = '' and dir_key not in (select key from problems where severity = 'error')")
def promote_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.promotable(*_problems(spark, sf_dir))


_FILES = """
select dir_key, 'v1' as name, false as is_dir, doc_id from p
union all select dir_key, 'x.txt', false, doc_id from p where doc_id % 4 = 1
union all select dir_key, 'source', true, doc_id from p where doc_id % 4 = 3
union all select dir_key, 'paper.json', false, doc_id from p
union all select dir_key, 'a.sync-conflict-1', false, doc_id from p where doc_id % 29 = 0
"""


@registered(
    f"""with p0 as ({PAPERS}), p as (select * from p0 where load_error is null), {_CHARS}, problems as ({_RULES}),
    v as (select dir_key, 'v' || i as name from (select dir_key, unnest(range(1, 2 + doc_id % 3)) as i from p)),
    f as ({_FILES.replace("from p", "from p0")}), good as (select f.* from f semi join p using (dir_key))
    select key, msg from problems union all select dir_key, 'no readable record: ' || load_error from p0 where load_error is not null
    union all select dir_key, 'no file for version "' || name || '"' from (select dir_key, name from v except select dir_key, name from f)
    union all select dir_key, case when is_dir then 'directory' else 'file' end || ' "' || name || '" belongs to no version' from good where name not in ('v1', 'paper.json') and not contains(name, 'sync-conflict')
    union all select dir_key, 'conflicting copy ' || dir_key || '/' || name from f where contains(name, 'sync-conflict')"""
)
def check_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load failures, rules, files and conflicts in one result."""
    ship_package(spark)
    papers = paper_records(spark, sf_dir)
    files = rows_of(spark, sf_dir, f"{_FILES.replace('from p', f'from ({PAPERS}) p')}", "documents").select(F.col("dir_key").alias("key"), "name", "is_dir")
    paths = files.select(F.concat_ws("/", "key", "name").alias("path"))
    return check.check_all(papers, files, paths).select("key", "msg")


_PLAIN = "lower(strip_accents(replace(replace({}, '{{', ''), '}}', '')))"
_WORTH = "greatest(case when contains(lower(key), '{0}') then 5e0 end, case when contains(doi, '{0}') then 5e0 end, case when contains(lower(arxiv_id), '{0}') then 5e0 end, case when contains(a, '{0}') then 3e0 end, case when contains(t, '{0}') then 2e0 end, case when '2001' = '{0}' then 2e0 end, case when contains(v, '{0}') then 1e0 end)"


@registered(
    f"with p as (select *, {_PLAIN.format('author')} as a, {_PLAIN.format('title')} as t, {_PLAIN.format('journal')} as v from ({PAPERS})), "
    f"s as (select key, {_WORTH.format('berg')} + {_WORTH.format('src1')} + {_WORTH.format('2001')} as score from p) select key, score from s where score is not null"
)
def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by author with TeX in the term, journal and year."""
    return search.search(search.record_fields(paper_records(spark, sf_dir)), [r"B{\'e}rg", "SRC1", "2001"]).select("key", "score")


_SHELF = """
select 'part' || p_partkey as key, case when p_partkey % 5 = 0 then '' when p_partkey % 5 = 1 then 'a, b, c, d' else 'Doe, ' || p_brand end as author, case when p_partkey % 3 = 0 then '' else '20' || p_size end as year,
  repeat(p_name || ' ', 1 + cast(p_partkey % 12 as int)) || p_type as title, case when p_partkey % 2 = 0 then 'draft' else 'clean' end as status, lower(p_type) as holdings, p_partkey from part
"""


@registered(
    f"""with s as (select *, case when author like 'Doe%' then 'Doe' else '' end as who from ({_SHELF})),
    h as (select *, key || '  ' || case when who <> '' and year <> '' then who || ' (' || year || ')  ' when who <> '' then who || '  ' when year <> '' then '(' || year || ')  ' else '' end as head,
      '  [' || holdings || ']' || case when status = 'draft' then ' [draft]' else '' end || case when p_partkey % 7 = 0 then ' [deprecated:a.pdf]' else '' end as tail from s)
    select key, head || case when length(title) > 100 - length(head) - length(tail) then substr(title, 1, 99 - length(head) - length(tail)) || '…' else title end || tail as line from h"""
)
def hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of a hit: key, first author and year, title, holdings and flags, in 100 characters."""
    ship_package(spark)
    p = rows_of(spark, sf_dir, _SHELF, "part")
    version = lambda bad: F.struct(bad.alias("deprecated"))
    versions = F.create_map(F.lit("b.pdf"), version(F.lit(False)), F.lit("a.pdf"), version(F.col("p_partkey") % 7 == 0))
    empty = {n: F.lit(None).cast("string") for n in ("venue", "doi", "arxiv", "abstract")}
    hits = p.withColumns({"versions": versions, "score": F.lit(1.0), **empty})
    return search.hit_report(hits).select("key", "line")


_WORKS = """
select '10.1234/p' || p_partkey as doi, case when p_partkey % 7 = 0 then 404 else 200 end as status, p_partkey,
  '{"message":{"DOI":"10.1234/p' || p_partkey || '","type":"journal-article","title":["' || case when p_partkey % 11 = 0 then '' else p_name end || '"],"author":[{"family":"' || p_brand || '","given":"J"}],"published":{"date-parts":[[' || (1990 + p_size) || ']]}}}' as body,
  case when p_partkey % 2 = 0 then '{"is_oa":true,"best_oa_location":{"url_for_pdf":"http://x/' || p_partkey || '","host_type":"r"}}' else '{"is_oa":false}' end as oa from part
"""
_ENTRIES = """
select '2101.' || lpad(cast(s_suppkey as string), 5, '0') as arxiv_id, s_suppkey,
  '<feed><entry><id>http://arxiv.org/abs/2101.' || lpad(cast(s_suppkey as string), 5, '0') || 'v2</id><title>' || s_name || '</title><published>2021-01-01</published><author><name>Jo Writer</name></author>' ||
  case when s_suppkey % 2 = 0 then '<arxiv:doi>10.1234/p' || s_suppkey || '</arxiv:doi>' else '' end || '</entry></feed>' as body from supplier
"""
_REQUESTS = """
select doc_id as id, case doc_id % 5 when 0 then '10.1234/p' || (doc_id % 3000) when 1 then 'https://doi.org/10.1234/p' || (doc_id % 500) || '.' when 2 then 'arXiv:2101.' || lpad(cast(doc_id % 150 as string), 5, '0') when 3 then 'NATION_' || (doc_id % 30) else 'NATION_' || (doc_id % 25) || ' 1999' end as ref from documents
"""
_HITS = "select n_name as query, s_suppkey as pos, '10.1234/p' || s_suppkey as doi, s_acctbal as score, 2001 as year, s_name as title from supplier join nation on s_nationkey = n_nationkey"
_STORED = "select c_name as key, '10.1234/P' || c_custkey as doi, '2101.' || lpad(cast(c_custkey + 7 as string), 5, '0') as arxiv_id from customer where c_custkey % 20 = 0"


_FETCHED = f"""w as ({_WORKS}), e as ({_ENTRIES}), r as ({_REQUESTS}), h as ({_HITS}), s as ({_STORED}),
    t as (select *, row_number() over (partition by query order by pos) as n, lead(score) over (partition by query order by pos) as nxt from h),
    picked as (select query, doi from t where n = 1 and score > 0 and (nxt is null or score >= 1.3 * nxt)),
    a as (select id, case id % 5 when 0 then ref when 1 then rtrim(replace(ref, 'https://doi.org/', ''), '.') when 3 then (select doi from picked where query = ref) end as doi, case when id % 5 = 2 then replace(ref, 'arXiv:', '') end as arxiv_id from r),
    j as (select a.*, w.p_partkey, w.status, e.s_suppkey, (select min(key) from s where lower(s.doi) = lower(a.doi) or s.arxiv_id = a.arxiv_id) as stored,
      (select min(key) from s where e.s_suppkey % 2 = 0 and lower(s.doi) = '10.1234/p' || e.s_suppkey) as published, coalesce(pw.status = 200 and pw.p_partkey % 11 <> 0, false) as merged, pw.p_partkey as ppart
      from a left join w on w.doi = a.doi left join e on e.arxiv_id = a.arxiv_id left join w pw on e.s_suppkey % 2 = 0 and pw.p_partkey = e.s_suppkey),
    o as (select *, coalesce(stored, published) as known, case when doi is null and arxiv_id is null then 'ambiguous' when coalesce(stored, published) is not null then 'duplicate' when arxiv_id is not null then case when s_suppkey is null then 'error' else 'ok' end
      when status is null or status = 404 or p_partkey % 11 = 0 then 'error' when p_partkey % 2 = 0 then 'ok' else 'no-oa-route' end as alone from j),
    q as (select *, row_number() over (order by id) as n, case when alone = 'duplicate' then [] when arxiv_id is null then ['doi:' || doi] when s_suppkey % 2 = 0 then ['arxiv:' || arxiv_id, 'doi:10.1234/p' || s_suppkey] else ['arxiv:' || arxiv_id] end as asks,
      case when alone not in ('ok', 'no-oa-route') then [] when arxiv_id is null then ['doi:' || doi] when merged then ['arxiv:' || arxiv_id, 'doi:10.1234/p' || s_suppkey] else ['arxiv:' || arxiv_id] end as holds from o),
    v as (select 0::bigint as n, []::varchar[] as held, []::bigint[] as holder, null::bigint as first
      union all select x.n, case when x.f is null then x.held || x.holds else x.held end, case when x.f is null then x.holder || [x.id for i in x.holds] else x.holder end, x.f
      from (select q.*, v.held, v.holder, list_min([z[2] for z in list_zip(v.held, v.holder) if list_contains(q.asks, z[1])]) as f from v join q on q.n = v.n + 1) x),
    fetched as (select q.*, v.first, case when v.first is null then alone else 'duplicate' end as outcome, v.first is null and alone in ('ok', 'no-oa-route') as made from q join v on v.n = q.n)"""


def _fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ship_package(spark)
    works = rows_of(spark, sf_dir, _WORKS, "part")
    entries = rows_of(spark, sf_dir, _ENTRIES, "supplier").select("arxiv_id", F.lit(200).alias("status"), services.arxiv_entry(F.col("body")).alias("entry"))
    oa = works.select("doi", F.lit(200).alias("status"), services.unpaywall(F.col("oa")).alias("answer"))
    works = works.select("doi", "status", F.when(F.col("status") == 200, services.crossref_work(F.col("body"))).alias("work"))
    requests, hits, stored = rows_of(spark, sf_dir, _REQUESTS, "documents"), rows_of(spark, sf_dir, _HITS, "supplier", "nation"), rows_of(spark, sf_dir, _STORED, "customer")
    return resolve.fetch(requests, stored, works, entries, hits, oa), stored


@registered(
    f"""with recursive {_FETCHED} select id, outcome, known, first, case when made then case when arxiv_id is null or merged then 'article' else 'misc' end end as type from fetched"""
)
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of DOIs, arXiv ids and texts, one after another, against answers of services, stored records and those that the batch makes."""
    return _fetched(spark, sf_dir)[0].select("id", "outcome", "known", "first", "type")


@registered(
    rf"""with recursive {_FETCHED}, m as (select f.*, p.p_brand, p.p_size, p.p_name, su.s_name from fetched f left join part p on p.p_partkey = case when arxiv_id is null then f.p_partkey when merged then f.ppart end left join supplier su on su.s_suppkey = f.s_suppkey where made),
    b as (select *, case when p_name is null then 'writer_2021' else 'brand_' || (1990 + p_size) end as base from m), k as (select *, row_number() over (partition by base order by id) as nth from b)
    select case when nth = 1 then base else base || chr((95 + nth)::int) end as key, 'draft' as status, case when p_name is null then 'misc' else 'article' end as type, case when p_name is null then replace(s_name, '#', '\#') else p_name end as title,
      case when p_name is null then 'Writer, Jo' else replace(p_brand, '#', '\#') || ', J' end as author, case when p_name is null then '2021' else cast(1990 + p_size as varchar) end as year,
      case when arxiv_id is null then doi when merged then '10.1234/p' || ppart end as doi, arxiv_id, arxiv_id as eprint, 'fetch' as action from k where nth <= 27"""
)
def fetch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draft records that a batch of requests leaves behind: key, fields, identifiers and first log entry."""
    outcomes, stored = _fetched(spark, sf_dir)
    made = resolve.draft_records(resolve.with_keys(outcomes, stored), "2024-01-01T00:00:00Z", "fetch")
    field = lambda n: F.try_element_at("bibtex.fields", F.lit(n)).alias(n)
    return made.select("key", "status", "bibtex.type", field("title"), field("author"), field("year"), "doi", F.col("arxiv.id").alias("arxiv_id"), field("eprint"), F.try_element_at("log", F.lit(1))["action"].alias("action"))


_TOLD = """
select page_id, case when page_id % 3 = 0 then '10.1234/A' || page_id when page_id % 3 = 1 then '' end as doi, case when page_id % 4 < 2 then '2101.' || lpad(cast(page_id % 100000 as string), 5, '0') end as arxiv_id, url as title,
  case when page_id % 6 = 0 then '10.1234/a' || page_id when page_id % 6 = 1 then '10.1234/other' end as found_doi, case when page_id % 6 > 1 and page_id % 4 <> 3 then '2101.' || lpad(cast((page_id - page_id % 2 * 7) % 100000 as string), 5, '0') end as found_id,
  cast(page_id % 3 as int) as found_version, case when page_id % 5 = 0 then upper(url) else 'other words' end as found_title from pages where page_id >= 7
"""


@registered(
    f"""with p as ({_TOLD}), j as (select *, coalesce(found_id = arxiv_id, false) as same_id,
      coalesce(found_id = arxiv_id, false) or coalesce(doi <> '' and lower(doi) = lower(found_doi), false) or lower(title) = lower(found_title) as fits from p)
    select page_id, case when not fits then null when found_id is null then 'published.pdf' else 'arxiv-' || found_id || case when same_id and found_version = 0 then 'v5' when found_version = 0 then '' else 'v' || found_version end || '.pdf' end as file,
      case when not fits then null else coalesce(arxiv_id, found_id) end as arxiv_id from j"""
)
def verify_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a file is the paper that a record describes, the name to keep it under, and the record's arXiv id then."""
    p = rows_of(spark, sf_dir, _TOLD, "pages")
    arxiv = F.when(F.col("arxiv_id").isNotNull(), F.struct(F.col("arxiv_id").alias("id"), F.lit(5).alias("version")))
    ident = F.struct(F.col("found_doi").alias("doi"), F.col("found_id").alias("arxiv_id"), F.lit(1).alias("tier"), F.col("found_version").alias("version"))
    v = records.verify_into(F.col("doi"), arxiv, F.col("title"), ident, F.col("found_title"))
    return p.select("page_id", v.alias("v")).select("page_id", "v.file", F.col("v.arxiv.id").alias("arxiv_id"))


_PRISM = """
select p_partkey, case when p_partkey % 4 = 0 then p_name else '' end as a, case when p_partkey % 3 = 0 then ' ' || p_brand || ' ' else '' end as b, p_type as c, case when p_partkey % 5 = 0 then 'https://doi.org/10.1234/' || p_partkey when p_partkey % 5 = 1 then 'none' else '' end as px from part
"""


@registered(
    f"""with p as ({_PRISM}) select p_partkey, trim(case when a <> '' then a when b <> '' then b else c end) as publication, case when p_partkey % 5 = 0 then '10.1234/' || p_partkey else '' end as doi,
    case when a <> '' then p_partkey || '--' || (p_partkey + 1) when b <> '' then cast(p_partkey as varchar) else 'all' end as pages from p"""
)
def prism_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first namespace version with any text gives all of a paper's publisher metadata; its DOI may come from elsewhere."""
    p = rows_of(spark, sf_dir, _PRISM, "part")
    key, none = F.col("p_partkey"), F.lit("")
    packet = lambda **k: F.struct(*((k[n] if n in k else none).alias(n) for n in pages.PRISM_TEXTS))
    given = lambda c, **k: F.when(F.col(c) != "", packet(publicationName=F.col(c), **k))
    versions = {
        "2.1": given("a", startingPage=key.cast("string"), endingPage=(key + 1).cast("string")), "2.0": given("b", startingPage=key.cast("string")), "3.0": packet(publicationName=F.col("c"), pageRange=F.lit("all"), startingPage=F.lit("1")),
    }
    return p.select("p_partkey", pages.prism(versions, F.col("px")).alias("i")).select("p_partkey", "i.publication", "i.doi", "i.pages")


@registered(
    """with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as nth from lineitem)
    select l_orderkey, string_agg(l_partkey || ':' || cast(l_quantity as int), ' ' order by l_quantity desc, nth) as lines from l group by l_orderkey"""
)
def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order by falling size, equal ones in their order."""
    rows = rows_of(spark, sf_dir, "select l_orderkey, struct(l_linenumber, l_partkey, l_suppkey, l_quantity) as x from lineitem", "lineitem")
    order = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    top = pages.top_lines(F.transform("x", lambda x: x["l_partkey"]), F.transform("x", lambda x: x["l_quantity"]))
    return order.select("l_orderkey", F.array_join(F.transform(top, lambda t: F.concat(t["line"].cast("string"), F.lit(":"), t["size"].cast("int").cast("string"))), " ").alias("lines"))


@registered(
    "select doc_id, translate(text, 'abgqx', 'αβγθξ') as symbols from (select doc_id, regexp_replace(substr(text, 1, 400), '[^abgqx]', '', 'g') as text from documents)",
)
def remap_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that a Symbol font stored as private characters."""
    letters = F.regexp_replace(F.substring("text", 1, 400), "[^abgqx]", "")
    private = F.translate(letters, "abgqx", "\uf061\uf062\uf067\uf071\uf078")
    return rows_of(spark, sf_dir, "select doc_id, text from documents", "documents").select("doc_id", pages.remap_symbols(private).alias("symbols"))


@registered(
    """select command, count(*) as total, count(*) filter (bad) as failed, case when count(*) filter (bad) > 0 then count(*) filter (bad) || ' of ' || count(*) || ' left in place' end as line
    from (select event_type as command, cast(json_extract_string(props, '$.k') as int) >= 90 as bad from events) group by command"""
)
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each kind of command: how many there were and how many failed."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = rows_of(spark, sf_dir, "select * from events", "events").select(F.col("event_type").alias("command"), F.col("event_id").cast("string").alias("input"), F.when(k >= 90, "error").otherwise("ok").alias("outcome"), F.lit("").alias("detail"))
    return records.batch_summaries(e, "command").select("command", "total", "failed", "line")


_TITLES = """
select page_id, case page_id % 4 when 0 then 'see 10.1234/v.' || page_id || '.' when 1 then 'arXiv:math/' || lpad(cast(page_id % 10000000 as string), 7, '0') || 'v3' else '' end as said, case when page_id % 4 = 2 then url when page_id % 8 = 3 then 'no such title here' else '' end as guess from pages
"""
_FOUND = "select url as query, page_id as pos, '10.1234/h' || page_id as doi, case when page_id % 3 = 0 then upper(url) else 'quite another title of some length' end as title from pages"


@registered(
    f"""with p as ({_TITLES}), h as (select query, min(pos) filter (upper(query) = title) as pos from ({_FOUND}) group by query)
    select page_id, case page_id % 4 when 0 then '10.1234/v.' || page_id when 2 then '10.1234/h' || h.pos end as doi, case page_id % 4 when 1 then 'math/' || lpad(cast(page_id % 10000000 as varchar), 7, '0') end as arxiv_id,
      case page_id % 4 when 1 then 3 end as version, case when page_id % 4 < 2 then 1 when page_id % 4 = 2 and h.pos is not null then 3 else 0 end as tier, case when page_id % 4 > 1 and guess <> '' then guess end as title from p left join h on p.guess = h.query"""
)
def identify_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in metadata, and for the other files the search hit whose title is like the guess."""
    p = rows_of(spark, sf_dir, _TITLES, "pages")
    ident = records.identify(F.lit(None).cast("string"), F.array("said"), F.array().cast("array<string>"))
    papers = p.select(F.col("page_id").alias("id"), ident.alias("ident"), "guess")
    out = records.identify_by_title(papers, rows_of(spark, sf_dir, _FOUND, "pages"))
    return out.select(F.col("id").alias("page_id"), "ident.doi", "ident.arxiv_id", "ident.version", "ident.tier", "title")


_PREPRINTS = "select s_suppkey as id, s_name as title, case when s_suppkey % 3 = 0 then '10.1234/p' || s_suppkey when s_suppkey % 3 = 1 then '10.1234/none' end as doi from supplier"


@registered(
    f"""with s as ({_PREPRINTS}), w as ({_WORKS}) select id, case when good then p_name else s.title end as title, case when good then 'article' else 'misc' end as type, '2101.' || id as eprint,
      'note' || case when s.doi is null or good then '' when w.status = 200 then '; preprint only: the record of ' || s.doi || ' has a fault, missing title'
        else '; preprint only: asked for ' || s.doi || ', got ' || coalesce(cast(w.status as varchar), 'no answer') end as pending
    from (select s.*, w.status, part.p_name, coalesce(w.status = 200 and w.p_partkey % 11 <> 0, false) as good from s left join w on w.doi = s.doi left join part on part.p_partkey = w.p_partkey) s left join w on w.doi = s.doi"""
)
def preprint_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprints with the published record of their DOI, or with a note on why there is none."""
    ship_package(spark)
    fields = F.create_map(F.lit("title"), F.col("title"), F.lit("eprint"), F.concat(F.lit("2101."), F.col("id").cast("string")))
    rows = rows_of(spark, sf_dir, _PREPRINTS, "supplier")
    rows = rows.select("id", F.lit("base").alias("base"), F.lit("misc").alias("type"), fields.alias("fields"), F.lit("").alias("abstract"), "doi", F.lit("note").alias("pending"))
    works = rows_of(spark, sf_dir, _WORKS, "part").select("doi", "status", F.when(F.col("status") == 200, services.crossref_work(F.col("body"))).alias("work"))
    out = drafts.merge_published(rows, works)
    return out.select("id", F.try_element_at("fields", F.lit("title")).alias("title"), "type", F.try_element_at("fields", F.lit("eprint")).alias("eprint"), "pending")


@registered(
    """select s_suppkey, '2101.' || s_suppkey || v as eprint, 'arxiv-math-' || s_suppkey || v as base, 'https://arxiv.org/pdf/2101.' || s_suppkey || v as pdf, split_part(s_name, '#', 1) || '#' || ltrim(split_part(s_name, '#', 2), '0') || ', Jo Ann and Plato' as authors
    from (select *, case when s_nationkey % 3 > 0 then 'v' || s_nationkey % 3 else '' end as v from supplier)"""
)
def arxiv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned ids, file names, addresses and author lists of preprints."""
    s = rows_of(spark, sf_dir, "select s_suppkey, s_nationkey % 3 as v, s_name from supplier", "supplier")
    key, v = F.col("s_suppkey").cast("string"), F.col("v")
    new, old = F.concat(F.lit("2101."), key), F.concat(F.lit("math/"), key)
    family = F.concat(F.substring_index("s_name", "#", 1), F.lit("#"), F.ltrim(F.substring_index("s_name", "#", -1), F.lit("0")))
    names = F.array(F.concat(F.lit("Jo Ann "), family), F.lit("Plato"))
    return s.select("s_suppkey", refs.eprint_id(new, v).alias("eprint"), refs.arxiv_file_base(old, v).alias("base"), refs.arxiv_url(new, v, "pdf").alias("pdf"), services.arxiv_authors(names).alias("authors"))


_BRACED = """
with t as (select doc_id, case doc_id % 4 when 0 then 'b{C}D aB $xY zW$ qR} ' || line when 1 then '{Open gRoup} mRNA$x$ ' || line when 2 then replace(line, ' e', ' eX') else line end as title from (select doc_id, split_part(text, chr(10), 1) as line from documents) d)
"""


@registered(
    rf"""{_BRACED}, w as (select doc_id, i, string_split(title, ' ')[i] as word from (select *, unnest(range(1, len(string_split(title, ' ')) + 1)) as i from t)),
    c as (select doc_id, i, j, substr(word, j, 1) as ch from (select *, unnest(range(1, length(word) + 1)) as j from w)),
    s as (select *, sum(case ch when '{{' then 1 when '}}' then -1 else 0 end) over o as total, sum((ch = '$')::int) over o as dollars from c window o as (partition by doc_id order by i, j)),
    d as (select *, total - least(0, min(total) over (partition by doc_id order by i, j)) as depth from s),
    e as (select doc_id, i, arg_max(depth, j) as depth, arg_max(dollars, j) % 2 as math from d group by doc_id, i),
    f as (select w.*, coalesce(last_value(e.depth ignore nulls) over (b rows between unbounded preceding and 1 preceding), 0) as d0, coalesce(last_value(e.math ignore nulls) over (b rows between unbounded preceding and 1 preceding), 0) as m0,
      coalesce(last_value(e.depth ignore nulls) over b, 0) as d1, coalesce(last_value(e.math ignore nulls) over b, 0) as m1 from w left join e using (doc_id, i) window b as (partition by doc_id order by i))
    select doc_id, string_agg(case when d0 + m0 + d1 + m1 = 0 and not regexp_matches(word, '^[{{$]') and regexp_matches(substr(word, 2), '\p{{Lu}}') then '{{' || word || '}}' else word end, ' ' order by i) as title from f group by doc_id"""
)
def brace_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, f"select * from ({_BRACED} select * from t)", "documents").select("doc_id", tex.brace_title(F.col("title")).alias("title"))
