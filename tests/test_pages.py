"""Page texts, publisher metadata, identification and what a file belongs to."""

from pyspark.sql import functions as F

from vellum.functions import pages
from vellum.operators import records


def test_symbols_and_lines(spark):
    df = spark.createDataFrame([("a\uf061\uf0b3 \uf0e5b\uf0ff", ["x", "y", "z"], [1.0, 3.0, 3.0])], "t string, l array<string>, s array<double>")
    r = df.select(pages.remap_symbols(F.col("t")), pages.top_lines(F.col("l"), F.col("s")), pages.line_sizes(F.array(F.col("s"), F.array(F.lit(2.0))))).first()
    assert r[0] == "aα≥ ∑b\uf0ff" and [tuple(x) for x in r[1]] == [("y", 3.0), ("z", 3.0), ("x", 1.0)] and r[2] == [3.0, 2.0]
    assert len(pages.SYMBOL_LOW) == 95 and len(pages.SYMBOL_HIGH) == 80 and len(pages.SYMBOL_LAST) == 14
    texts = spark.createDataFrame([([" \n", "x"],), (["\u2003"],), (None,)], "p array<string>")
    assert [r[0] for r in texts.select(pages.has_text(F.col("p"))).collect()] == [True, False, False]


def test_prism(spark):
    ddl = ", ".join(f"{v} struct<{','.join(n + ':string' for n in pages.PRISM_TEXTS)}>" for v in "abc") + ", px string, ident string"
    row = lambda **k: tuple(k.get(n) for n in pages.PRISM_TEXTS)
    rows = [
        (None, row(doi=" https://doi.org/10.1234/x ", startingPage="3", endingPage=" 9", eIssn="e"), row(doi="10.9/y", volume="7"), "10.1000/p", None),
        (row(), row(), None, "doi:10.1000/p", None), (row(publicationName="J", pageRange="1-2", startingPage="5"), None, None, None, "http://dx.doi.org/10.1000/i"), (None, None, None, "none", "urn:x"),
    ]
    info = pages.prism({"2.1": F.col("a"), "2.0": F.col("b"), "3.0": F.col("c")}, F.col("px"))
    got = spark.createDataFrame(rows, ddl).select(info.alias("i"), "ident").select("i", pages.stated_doi(F.col("i"), F.col("ident")).alias("doi")).collect()
    assert (got[0]["i"]["doi"], got[0]["i"]["pages"], got[0]["i"]["issn"], got[0]["i"]["volume"]) == ("10.1234/x", "3--9", "e", "")
    assert got[1]["i"]["doi"] == "10.1000/p" and got[2]["i"]["pages"] == "1-2" and got[2]["doi"] == "10.1000/i" and got[3]["i"] is None and got[3]["doi"] == ""
    titles = spark.createDataFrame([(" T ", "x"), (" ", " x"), (None, None)], "a string, b string").select(pages.metadata_title(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in titles] == ["T", "x", ""]


def test_verify_into(spark):
    ddl = "doi string, arxiv struct<id:string,version:int>, title string, ident struct<doi:string,arxiv_id:string,tier:int,version:int>, name string"
    rows = [("10.1/A", None, "t", ("10.1/a", None, 1, None), ""), (None, ("2001.1", 3), "t", (None, "2001.1", 1, 0), ""), (None, None, "One two three four", (None, "math/01", 2, 2), "One two three four"), ("10.1/b", ("x", 1), "t", ("10.1/c", "y", 1, 1), "u")]
    got = [r[0] for r in spark.createDataFrame(rows, ddl).select(records.verify_into(F.col("doi"), F.col("arxiv"), F.col("title"), F.col("ident"), F.col("name"))).collect()]
    assert [g and (g["file"], g["arxiv"] and tuple(g["arxiv"])) for g in got] == [("published.pdf", None), ("arxiv-2001.1v3.pdf", ("2001.1", 3)), ("arxiv-math-01v2.pdf", ("math/01", 2)), None]


def test_values_pending_log(spark):
    df = spark.sql("select 's' as s, '' as k, map('b', '2', 'a', '1', 'c', '') as m, cast(null as string) as x, cast(null as array<struct<when:string,action:string,detail:string>>) as log")
    r = df.select(records.metadata_values(F.col("s"), F.col("k"), F.col("m"), F.col("x")), records.append_log(F.col("log"), F.lit("w"), F.lit("a"), F.lit("d")), records.add_pending(F.lit(""), F.lit("n")), records.add_pending(F.lit("p"), F.lit("n"))).first()
    assert r[0] == ["s", "1", "2"] and [tuple(x) for x in r[1]] == [("w", "a", "d")] and (r[2], r[3]) == ("n", "p; n")
    new = spark.createDataFrame([(1, "10.1/X", None), (2, None, "a"), (3, None, None)], "id int, doi string, arxiv_id string")
    stored = spark.createDataFrame([("k", "10.1/x", "z")], "key string, doi string, arxiv_id string")
    fresh, known = records.gate(new, stored)
    assert sorted(r["id"] for r in fresh.collect()) == [2, 3] and [(r["id"], r["key"]) for r in known.collect()] == [(1, "k")]
