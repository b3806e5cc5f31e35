"""Drafts, title guesses, candidates of services and what a search prints."""

import json

from pyspark.sql import functions as F

from vellum.operators import drafts
from vellum.sources import candidates, services


def test_candidates(spark):
    z = {"result": [{"title": {"title": "T"}, "contributors": {"authors": [{"name": "Doe, J"}]}, "source": {"series": [{"title": "S"}]}, "year": 1999, "links": [{"type": "x", "identifier": "1"}, {"type": "doi", "identifier": "10.1/x"}]}, {"title": {"title": "odd"}, "year": "1999"}, {"title": {"title": "late"}}]}
    d = {"result": {"hits": {"hit": [{"info": {"title": "A", "venue": ["V", "W"], "year": "2001", "authors": {"author": {"text": "One"}}}}, {"info": {"title": 5}}, {"info": {"title": "B", "venue": "[X]", "year": "n", "doi": "10.2/y", "authors": {"author": [{"text": "P"}, {"text": "Q"}]}}}]}}}
    df = spark.createDataFrame([(json.dumps(z), json.dumps(d)), ("{}", '{"result":{"hits":{}}}'), (None, "{")], "z string, d string")
    rows = df.select(candidates.zbmath(F.col("z"), 2).alias("z"), candidates.dblp(F.col("d")).alias("d")).collect()
    assert [tuple(c) for c in rows[0]["z"]] == [("zbmath", "T", ["Doe, J"], "S", 1999, "10.1/x")]
    assert [tuple(c) for c in rows[0]["d"]] == [("dblp", "A", ["One"], "V", 2001, ""), ("dblp", "B", ["P", "Q"], "[X]", 0, "10.2/y")]
    assert all(r["z"] == [] and r["d"] == [] for r in rows[1:])


def test_published_drafts(spark):
    full = {"DOI": "10.1/x", "type": "monograph", "title": ["On Größe and NATO"], "container-title": ["J & K"], "author": [{"family": "Müller Lee", "given": "A"}], "page": "1-9", "published": {"date-parts": [[2001]]}}
    bodies = [full, full | {"title": []}, full | {"author": []}, full | {"published": None}]
    df = spark.createDataFrame([(i, json.dumps({"message": b})) for i, b in enumerate(bodies)], "i int, b string")
    rows = drafts.published_drafts(df.select("i", services.crossref_work(F.col("b")).alias("work"))).orderBy("i").collect()
    assert [r["error"] for r in rows] == [None, "missing title", "missing authors", "missing year"]
    assert rows[0]["base"] == "muller-lee_2001" and rows[0]["type"] == "book" and rows[1]["fields"] is None
    assert rows[0]["fields"]["journal"] == r"J \& K" and rows[0]["fields"]["pages"] == "1--9" and "volume" not in rows[0]["fields"]


def test_batch(spark):
    df = spark.createDataFrame([(1, "10.1/A", None), (2, "10.1/a", "x"), (3, "", "x"), (4, None, None), (5, None, ""), (6, "10.1/b", "x")], "ord int, doi string, arxiv_id string")
    got = {r["ord"]: r["first"] for r in drafts.unseen_in_batch(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 3}  # 2 is never created, so 3 is new


def test_title_guess(spark):
    cases = [(["a b", "c d", "x"], [9.0, 9.0, 5.0], "a b c d"), (["head", "one two three four"], [9.0, 5.0], "one two three four"), (["a b", "c d"], [], ""), (["a b c d", "e"], [], "a b c d"), ([], [], "")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "l array<string>, s array<double>")
    assert [r[0] for r in df.select(drafts.title_guess(F.col("l"), F.col("s"))).collect()] == [c[2] for c in cases]


def test_flags_and_online(spark):
    df = spark.sql("select 'draft' as status, map('b.pdf', named_struct('deprecated', true), 'a.pdf', named_struct('deprecated', true), 'c', named_struct('deprecated', false)) as v union all select 'clean', null")
    assert sorted(map(tuple, (r[0] for r in df.select(drafts.hit_flags(F.col("status"), F.col("v"))).collect()))) == [(), ("draft", "deprecated:a.pdf", "deprecated:b.pdf")]
    body = json.dumps({"message": {"title": ["A whole new title"], "published": {"date-parts": [[2001]]}}})
    answers = spark.createDataFrame([("d1", 200, body), ("d2", 404, None), ("d3", 500, None)], "doi string, status int, b string").select("doi", "status", services.crossref_work(F.col("b")).alias("work"))
    papers = spark.createDataFrame([("k1", "d1", "A whole new title", "2001"), ("k2", "d2", "t", ""), ("k3", "d3", "t", ""), ("k4", "d1", "Other words", "1999"), ("k5", "", "t", "")], "key string, doi string, title string, year string")
    got = sorted((r["key"], r["severity"]) for r in drafts.online_problems(papers, answers).collect())
    assert got == [("k2", "error"), ("k3", "warning"), ("k4", "warning"), ("k4", "warning")]
