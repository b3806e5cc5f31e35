"""Record scans, events and operators on small stores."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.operators import check, records, search
from vellum.sources import services, store
from vellum.streaming.events import event_stream, outcomes


@pytest.fixture
def root(tmp_path):
    paper = {"key": "gross_1963", "status": "draft", "bibtex": {"type": "article", "fields": {"author": r"Gro{\ss}, K.", "title": "A test", "year": "1963"}}, "holdings": "none", "versions": {"a.pdf": {"deprecated": True}}}
    for name, body in {"gross_1963": json.dumps(paper), "odd": json.dumps(paper | {"colour": 1}), "bad": "{"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "paper.json").write_text(body)
    (tmp_path / "inbox").mkdir()
    return str(tmp_path)


def test_scan(spark, root):
    rows = {r["dir_key"]: r for r in store.scan_records(spark, root, strict=False).collect()}
    assert set(rows) == {"gross_1963", "odd", "bad"} and rows["gross_1963"]["load_error"] is None
    assert rows["odd"]["load_error"] == "unknown member colour" and rows["bad"]["load_error"]
    assert [r["key"] for r in store.scan_records(spark, root, ["gross_1963"]).collect()] == ["gross_1963"]
    with pytest.raises(Exception, match="unknown member|not a JSON"):
        store.scan_records(spark, root).collect()


def test_search_and_check(spark, root):
    papers = store.scan_records(spark, root, ["gross_1963"])
    flat = papers.select("key", "doi", F.col("arxiv.id").alias("arxiv"), *(F.col("bibtex.fields")[n].alias(n) for n in ("author", "title", "year")), F.lit(None).cast("string").alias("venue"), "abstract")
    assert [(r["key"], r["score"]) for r in search.search(flat, ["gross", "1963"]).select("key", "score").collect()] == [("gross_1963", 10.0)]
    assert search.search(flat, ["gross", "absent"]).count() == 0
    assert search.search(flat, []).count() == 1
    found = {(r["rule"], r["severity"]) for r in check.problems(papers).collect()}
    assert {("R2", "error"), ("R11", "warning"), ("R12", "warning")} <= found
    assert check.promotable(papers, check.problems(papers)).count() == 0


def test_events(spark, tmp_path):
    row = ("2024-01-01T10:00:00", "fetch", "x", "k", "ok", "doi", 0, 12)
    df = spark.createDataFrame([row], "when string, command string, input string, ref string, outcome string, source string, tier int, duration_ms bigint")
    store.append_events(df, str(tmp_path / "e"))
    store.append_events(df, str(tmp_path / "e"))
    assert store.read_events(spark, str(tmp_path / "e")).count() == 2
    q = outcomes(event_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("outcomes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("outcomes").select("events").first()[0] == 2


def test_services(spark):
    body = json.dumps({"message": {"DOI": "10.1/x", "type": "journal-article", "title": ["T"], "author": [{"family": "Doe", "given": "J"}, {"name": "CERN"}, {}], "published": {"date-parts": [[2001, 2]]}}})
    feed = '<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title> A\n b </title><published>2021-01-01</published><author><name>J Doe</name></author></entry></feed>'
    r = spark.createDataFrame([(body, feed)], "b string, f string").withColumn("w", services.crossref_work(F.col("b")))
    got = r.select(services.work_year(F.col("w")), services.work_authors(F.col("w")), services.work_type(F.col("w"))).first()
    assert tuple(got) == (2001, "Doe, J and {CERN}", "article")
    e = r.select(services.arxiv_entry(F.col("f")).alias("e")).first()["e"]
    assert (e["id"], e["version"], e["title"], e["year"], e["authors"]) == ("2101.00001", 2, "A b", 2021, ["J Doe"])


def test_export_and_merge(spark):
    df = spark.createDataFrame([("k", {"zz": "1", "title": "T", "author": "A"})], "key string, fields map<string,string>")
    assert df.select(records.bib_entry(F.col("key"), F.lit("misc"), F.col("fields"))).first()[0] == "@misc{k,\n  author = {A},\n  title = {T},\n  zz = {1},\n}\n"


def test_sync_conflicts(spark):
    df = spark.createDataFrame([("a/paper.sync-conflict-1.json",), ("b/paper.json",)], "path string")
    assert [tuple(r) for r in check.sync_conflicts(df).collect()] == [("a", "a/paper.sync-conflict-1.json")]


def test_faults_at_every_depth(spark):
    good = {"key": "k", "status": "draft", "bibtex": {"type": "misc", "fields": {"title": "T"}}, "arxiv": {"id": "1", "version": 2}, "versions": {"a.pdf": {"acquired": "x", "deprecated": True}}, "audit": {"any": [1]}, "log": [{"when": "w", "action": "a"}], "holdings": "none", "doi": None}
    cases = [
        (good, None), (good | {"key": 5}, "member key is no string"), (good | {"versions": {"a.pdf": {"size": 1}}}, "unknown member versions.size"), (good | {"log": [{"when": "w"}, {"who": "x"}]}, "unknown member log.who"),
        (good | {"arxiv": {"id": "1", "v": 2}}, "unknown member arxiv.v"), (good | {"arxiv": {"id": "1", "version": "2"}}, "member arxiv.version is no bigint"), (good | {"bibtex": {"type": "misc", "fields": {"year": 1999}}}, "member bibtex.fields.year is no string"),
        (good | {"bibtex": []}, "member bibtex is no object"), (good | {"log": [{"when": 3}]}, "member log.when is no string"), (good | {"versions": {"a": {"deprecated": "yes"}}}, "member versions.deprecated is no boolean"), ([1], "record is no object"),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "{")], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(store.load_error(F.col("v"))).collect()]
    assert got == [e for _, e in cases] + ["not a JSON object"]


def test_whole_check(spark, root, tmp_path):
    (tmp_path / "gross_1963" / "b.pdf").write_text("x")
    (tmp_path / "gross_1963" / "src").mkdir()
    (tmp_path / "gross_1963" / "src" / "main.tex").write_text("x")
    (tmp_path / "odd" / "x.sync-conflict-1.txt").write_text("x")
    papers, paths = store.scan_records(spark, root, strict=False), store.store_paths(spark, root)
    files = store.entry_files(papers, paths)
    lines = [r["line"] for r in check.problem_lines(check.check_all(papers, files, paths)).collect()]
    assert {'gross_1963: error: no file for version "a.pdf"', 'gross_1963: error: file "b.pdf" belongs to no version', 'gross_1963: error: directory "src" belongs to no version'} <= set(lines)
    assert {"odd: error: no readable record: unknown member colour", "bad: error: no readable record: not a JSON object", "odd: error: conflicting copy odd/x.sync-conflict-1.txt"} <= set(lines)
    assert lines == sorted(lines, key=lambda x: x.split(":")[0]) and lines[0].startswith("bad: ")
    assert store.load_config(spark, root) == {}
    (tmp_path / "config.json").write_text('{"email": "a@b.c"}')
    assert store.load_config(spark, root) == {"email": "a@b.c"}
    (tmp_path / "config.json").write_text('{"mail": 1}')
    with pytest.raises(ValueError, match="unknown member mail"):
        store.load_config(spark, root)
    taken, failed = store.ingest_files(spark, [f"{root}/gross_1963/b.pdf", f"{root}/odd", f"{root}/none.pdf"])
    assert taken.count() == 1 and {r["detail"] for r in failed.collect()} == {"is a directory", "no such file"}
    assert [r["key"] for r in records.missing_keys(spark, ["gross_1963", "none", "none"], store.scan_records(spark, root, ["gross_1963"])).collect()] == ["none"]


def test_upsert_and_promotion(spark):
    rows = spark.createDataFrame([("a", "draft"), ("b", "draft")], "key string, status string").selectExpr("*", "'' as pending")
    found = spark.createDataFrame([("a", "error")], "key string, severity string")
    assert {(r["key"], r["status"]) for r in check.promoted(rows, found).collect()} == {("a", "draft"), ("b", "clean")}
    assert {(r["key"], r["status"]) for r in store.upsert(rows, rows.where("key = 'b'").withColumn("status", F.lit("clean"))).collect()} == {("a", "draft"), ("b", "clean")}


def test_hit_report(spark, root):
    papers = search.record_fields(store.scan_records(spark, root, ["gross_1963"]))
    hits = search.search(papers, [r"Gro{\ss}", "1963"])
    r = search.hit_report(hits).first()
    assert r["line"] == "gross_1963  Groß (1963)  A test  [none] [draft] [deprecated:a.pdf]" and json.loads(r["json"])["title"] == "A test"
    long_ = papers.withColumn("title", F.lit("w" * 200))
    line = search.hit_report(search.search(long_, ["www"])).first()["line"]
    assert len(line) == 100 and "…  [none]" in line
    who = spark.createDataFrame([("A", "1"), ("A", ""), ("", "1"), ("", None)], "w string, y string").select(search.who_year(F.col("w"), F.col("y"))).collect()
    assert [x[0] for x in who] == ["A (1)", "A", "(1)", ""]
