"""References and files resolved against answers that were fetched before."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import batch, drafts, records, reports, resolve
from vellum.sources import services


def work(doi, title="On Größe", year=2001, **more):
    return json.dumps({"message": {"DOI": doi, "type": "journal-article", "title": [title], "author": [{"family": "Doe", "given": "Jane"}], "published": {"date-parts": [[year]]}} | more})


def feed(id_, doi="", title="A Preprint on NATO", category="math.PR"):
    extra = f"<arxiv:doi>{doi}</arxiv:doi>" if doi else ""
    return f'<feed><entry><id>http://arxiv.org/abs/{id_}</id><title>{title}</title><summary>An  abstract</summary><published>2020-01-01</published><author><name>Jane van Roe</name></author><author><name>Plato</name></author><arxiv:primary_category term="{category}"/>{extra}</entry></feed>'


@pytest.fixture(scope="module")
def answers(spark):
    works = spark.createDataFrame([("10.1000/a", 200, work("10.1000/a")), ("10.1000/b", 404, None), ("10.1000/c", 200, work("10.1000/c", title="")), ("10.1000/d", 200, work("10.1000/d")), ("10.1000/p", 200, work("10.1000/p", title="The Published One"))], "doi string, status int, body string")
    works = works.select("doi", "status", services.crossref_work(F.col("body")).alias("work"))
    entries = spark.createDataFrame([("2001.00001", 200, feed("2001.00001v3", "10.1000/p")), ("2001.00002", 200, feed("2001.00002v1")), ("math/0101001", 200, feed("math/0101001", "10.1000/b")), ("2001.00005", 200, feed("2001.00005v1", "10.9999/Known")), ("2001.00009", 200, "<feed></feed>")], "arxiv_id string, status int, body string")
    entries = entries.select("arxiv_id", "status", services.arxiv_entry(F.col("body")).alias("entry"))
    oa = spark.createDataFrame([("10.1000/a", 200, json.dumps({"is_oa": True, "best_oa_location": {"url_for_pdf": "http://x/a.pdf", "host_type": "repository"}})), ("10.1000/d", 200, json.dumps({"is_oa": False}))], "doi string, status int, body string")
    oa = oa.select("doi", "status", services.unpaywall(F.col("body")).alias("answer"))
    hits = spark.createDataFrame([("clear words", 0, "10.1000/a", 9.0, 2001, "Clear words"), ("clear words", 1, "10.1000/d", 2.0, 2001, "Other"), ("close call", 0, "10.1000/a", 9.0, 2001, "x"), ("close call", 1, "10.1000/d", 8.0, 2001, "y"), ("clear 1999", 0, "10.1000/a", 9.0, 2001, "x")], "query string, pos int, doi string, score double, year int, title string")
    stored = spark.createDataFrame([("doe_2001", "10.9999/known", None), ("roe_1999", None, "2001.00007")], "key string, doi string, arxiv_id string")
    return {"stored": stored, "works": works, "entries": entries, "hits": hits, "oa": oa}


def test_fetch(spark, answers):
    asked = ["10.1000/a", "doi:10.1000/b", "10.1000/c.", "https://doi.org/10.1000/d", "10.9999/KNOWN", "arXiv:2001.00001", "2001.00002v4", "math/0101001", "2001.00005", "2001.00007", "2001.00009", "clear words", "close call", "clear 1999", "nothing at all"]
    requests = spark.createDataFrame(list(enumerate(asked)), "id int, ref string")
    out = resolve.with_keys(resolve.fetch(requests, **answers), answers["stored"]).cache()
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["outcome"] for i in range(len(asked))] == ["ok", "error", "error", "no-oa-route", "duplicate", "ok", "ok", "ok", "duplicate", "duplicate", "error", "duplicate", "ambiguous", "ambiguous", "ambiguous"]
    assert (got[4]["known"], got[8]["known"], got[9]["known"]) == ("doe_2001", "doe_2001", "roe_1999")
    assert [got[i]["key"] for i in (0, 3)] == ["doe_2001a", "doe_2001b"]
    assert (got[11]["first"], got[11]["known"], got[11]["key"], got[11]["fields"], got[11]["doi"]) == (0, "doe_2001a", None, None, "10.1000/a")  # the text names what the batch has made
    assert all(r["first"] is None for i, r in got.items() if i != 11)
    assert got[5]["key"] == "doe_2001c" and got[5]["fields"]["title"] == "The Published One" and got[5]["fields"]["eprint"] == "2001.00001" and got[5]["fields"]["primaryclass"] == "math.PR" and got[5]["abstract"] == "An abstract" and got[5]["arxiv"]["version"] == 3
    assert [tuple(d) for d in got[5]["downloads"]] == [("https://arxiv.org/pdf/2001.00001v3", "arxiv-2001.00001v3.pdf"), ("https://arxiv.org/e-print/2001.00001v3", "arxiv-2001.00001v3/")]
    assert got[6]["fields"]["author"] == "Roe, Jane van and Plato" and got[6]["fields"]["title"] == "A Preprint on {NATO}" and got[6]["type"] == "misc" and got[6]["pending"] == drafts.PENDING
    assert got[7]["downloads"][0]["name"] == "arxiv-math-0101001.pdf" and "404" in got[7]["pending"] and got[7]["pending"].startswith(drafts.PENDING + "; ")
    assert [tuple(d) for d in got[0]["downloads"]] == [("http://x/a.pdf", "published.pdf")] and got[3]["detail"].split("\n")[0] == "authors: Jane Doe" and got[3]["detail"].endswith("unpaywall: no free copy known")
    assert got[12]["candidates"] == ["10.1000/a (9.0)", "10.1000/d (8.0)"] and got[14]["candidates"] is None
    rows = {(r["input"], r["outcome"], r["source"]) for r in resolve.events(out, "2024-01-01T00:00:00", "fetch").collect()}
    assert {("doi", "ok", "crossref"), ("arxiv", "ok", "arxiv"), ("text", "ambiguous", "crossref")} <= rows


def test_ingest(spark, answers):
    files = spark.createDataFrame([(0, "10.1000/a", None, 1, None, ""), (1, None, "2001.00002", 2, 0, ""), (2, None, None, 0, None, "clear words"), (3, None, None, 0, None, "no such title"), (4, None, None, 0, None, ""), (5, "10.1000/d", None, 1, None, "")], "id int, doi string, arxiv_id string, tier int, version int, guess string")
    files = files.select("id", F.struct("doi", "arxiv_id", "tier", "version").alias("ident"), "guess")
    out = resolve.ingest(files, **answers)
    got = {r["id"]: r for r in out.collect()}
    assert [(got[i]["outcome"], got[i]["tier"], got[i]["title"]) for i in range(6)] == [("ok", 1, None), ("ok", 2, None), ("duplicate", 3, "clear words"), ("unidentified", 0, "no such title"), ("unidentified", 0, None), ("ok", 1, None)]
    told = records.batch_summary(out.select(F.col("id").cast("string").alias("input"), "outcome", "detail")).first()
    assert (told["total"], told["failed"], told["line"]) == (6, 3, "3 of 6 left in place") and [f["input"] for f in told["failures"]] == ["2", "3", "4"]


def test_what_a_batch_makes_counts_for_later_requests(spark, answers):
    asked = ["10.1000/c", "10.1000/c", "2001.00001", "10.1000/P", "arXiv:2001.00001v2", "10.1000/p", "math/0101001", "10.1000/b", "math/0101001", "10.1000/d", "10.1000/D"]
    got = {r["id"]: r for r in resolve.fetch(spark.createDataFrame(list(enumerate(asked)), "id int, ref string"), **answers).collect()}
    # a failed request makes nothing; a preprint with its published record holds both identifiers, without it the arXiv id alone
    assert [(got[i]["outcome"], got[i]["first"]) for i in range(len(asked))] == [("error", None), ("error", None), ("ok", None), ("duplicate", 2), ("duplicate", 2), ("duplicate", 2), ("ok", None), ("error", None), ("duplicate", 6), ("no-oa-route", None), ("duplicate", 9)]
    made = resolve.with_keys(resolve.fetch(spark.createDataFrame(list(enumerate(asked)), "id int, ref string"), **answers), answers["stored"])
    rows = {r["key"]: r for r in resolve.draft_records(made, "2024-01-01T00:00:00Z", "fetch").collect()}
    assert len(rows) == 3 and all(r["status"] == "draft" and len(r["log"]) == 1 and r["log"][0]["action"] == "fetch" for r in rows.values())
    assert {r["arxiv"]["id"] for r in rows.values() if r["arxiv"]} == {"2001.00001", "math/0101001"}


def in_turn(rows):
    """(ord, first) row by row."""
    made, out = {}, {}
    for ord_, asks, holds in sorted(rows):
        first = min((made[i] for i in asks or [] if i in made), default=None)
        if first is None:
            for i in holds or []:
                made.setdefault(i, ord_)
        else:
            out[ord_] = first
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "hot", "empty"])
def test_first_holders_against_a_loop(spark, kind):
    rng = random.Random(4)
    some = lambda n, k: [f"i{rng.randrange(n)}" for _ in range(rng.randrange(k))]
    rows = {
        "random": [(i * 3 - 50, some(60, 4), some(60, 3)) for i in range(200)] + [(1001, None, None), (1002, ["i1", None], ["i1", "i1"])],
        "chain": [(i, [f"c{i}", f"c{i + 1}"], [f"c{i}", f"c{i + 1}"]) for i in range(9)],
        "hot": [(i, ["hot"] if i % 3 else some(30, 3), ["hot"] if i % 3 else some(30, 3)) for i in range(300)],
        "empty": [],
    }[kind]
    rng.shuffle(rows)
    got = {r["ord"]: r["first"] for r in batch.first_holders(spark.createDataFrame(rows, "ord long, asks array<string>, holds array<string>")).collect()}
    assert got == in_turn([(o, [a for a in asks or [] if a], holds) for o, asks, holds in rows])


def test_attach_and_reports(spark, answers):
    ddl = "key string, path string, ident struct<doi:string,arxiv_id:string,tier:int,version:int>, file_title string"
    files = spark.createDataFrame([("a", "1.pdf", ("10.1/A", None, 1, None), ""), ("b", "2.pdf", (None, "2001.1", 1, 2), "Other"), ("c", "3.pdf", None, ""), ("c", "4.pdf", None, "")], ddl)
    facts = reports.file_facts(F.col("ident"), F.lit(""), F.lit(None).cast("string"), F.col("file_title"), F.col("file_title") != "")
    rows = spark.createDataFrame([("a", "10.1/a", None, "T", "A"), ("b", "", ("2001.9", 1), "T", "A"), ("c", "", None, "T", "A")], "key string, doi string, arxiv struct<id:string,version:int>, title string, author string")
    got = {r["path"]: r for r in resolve.attach_into(rows, files.withColumn("facts", facts)).collect()}
    assert (got["1.pdf"]["outcome"], got["1.pdf"]["file"], got["1.pdf"]["detail"]) == ("ok", "published.pdf", None)
    assert got["2.pdf"]["outcome"] == "mismatch" and got["2.pdf"]["detail"] == "What the file says:\narxiv: 2001.1v2\ntitle_guess: Other\nWhat the record says:\ndoi: (none recorded)\narxiv: 2001.9v1\ntitle: T\nauthor: A"
    assert got["3.pdf"]["outcome"] == "error" and got["4.pdf"]["detail"].endswith("3.pdf, 4.pdf")
    w = answers["works"].where("doi = '10.1000/a'").select(reports.work_candidate(F.col("work")).alias("c"))
    r = w.select(reports.candidate_line(F.col("c")), reports.example_doi(F.array("c")), reports.example_doi(F.array().cast("array<struct<doi:string>>"))).first()
    assert tuple(r) == ("crossref; Jane Doe; 2001; On Größe; doi 10.1000/a", "10.1000/a", "10.1000/182")
    e = answers["entries"].where("arxiv_id = '2001.00001'").select(reports.entry_facts(F.col("entry")), reports.entry_label(F.col("entry"))).first()
    assert e[0].split("\n")[3:] == ["arxiv: https://arxiv.org/abs/2001.00001v3", "primary_class: math.PR", "doi: https://doi.org/10.1000/p"] and e[1] == "2001.00001"


def test_hits_are_judged_once_a_text(spark, answers, monkeypatch):
    seen = []
    monkeypatch.setattr(resolve, "in_order", lambda o: o.select(*resolve.OUTCOME, F.lit(None).cast("int").alias("first")))
    monkeypatch.setattr(resolve, "auto_accept", lambda hits: seen.append(hits) or records.auto_accept(hits))
    requests = spark.createDataFrame([(i, ("clear words", "close call")[i % 2]) for i in range(40)], "id int, ref string")
    resolve.fetch(requests, **answers)
    assert seen[0].count() == 4
