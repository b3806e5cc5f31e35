"""Scalar functions against tables of expected values."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import names, refs, tex
from vellum.operators.check import braces_balanced, capital_words, raw_specials


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_decode(spark):
    cases = {
        r"L\'evy": "Lévy", r"{\"o}": "ö", r"\c{c}a": "ça", r"\H{o}": "ő", r"\Hello x": " x", r"\o re": "øre", "a--b---c": "a–b—c", "x~y": "x y",
        "$a--b$ {T}": "$a--b$ T", r"\& \% \_": "& % _", "50$ left": "50$ left", r"\ss ": "ß", "plain": "plain", "": "", "end\\": "end",
    }
    assert values(spark, tex.decode, cases) == list(cases.values())
    assert values(spark, tex.unknown_macros, [r"\Hello \'e \foo{x} \& \ss", "none"]) == [["Hello", "foo"], []]


def test_fold(spark):
    cases = {"Ørsted": "orsted", r"Erd{\H{o}}s": "erdos", "ŁÓDŹ": "lodz", "Straße": "strasse", "æ~x": "ae x", "ΣΑΣ": "σασ"}
    assert values(spark, tex.fold, cases) == list(cases.values())
    import unicodedata

    hangul = ["한글 각", "ो ொ"]
    assert values(spark, tex.fold, hangul) == ["".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn") for x in hangul]


def test_encode_and_back(spark):
    texts = ["Lévy & Søn", "ångström", "ő – ç — ß", "100% #1 a_b", "Łódź"]
    encoded = values(spark, tex.encode, texts)
    assert encoded[0] == r"L{\'e}vy \& S{\o}n" and encoded[1] == r"{\aa}ngstr{\"o}m"
    assert values(spark, tex.decode, encoded) == texts


def test_titles_pages_lines(spark):
    assert values(spark, tex.brace_title, ["On the DNA of e-Coli", "{A B} mRNA", "Simple Title"]) == ["On the {DNA} of {e-Coli}", "{A B} {mRNA}", "Simple Title"]
    odd = ["b{C}D x", "mRNA$x$ y", "a } bCd", "x $aB cD$ eF", "p {aB cD} eF", "n{oB pC} dE", "", "É éÉ", "a$B c"]
    assert values(spark, tex.brace_title, odd) == ["{b{C}D} x", "{mRNA$x$} y", "a } {bCd}", "x $aB cD$ {eF}", "p {aB cD} {eF}", "n{oB pC} {dE}", "", "É {éÉ}", "a$B c"]
    assert values(spark, tex.normalize_pages, ["1-2", "1--2", "a-b", "1-2, 5-6"]) == ["1--2", "1--2", "a-b", "1--2, 5--6"]
    assert values(spark, lambda c: tex.truncate(c, 4), ["abcd", "abcde", "ééééé"]) == ["abcd", "abc…", "ééé…"]
    assert values(spark, lambda c: tex.similarity(tex.words(c), tex.words(F.lit("A b c d"))), ["d c b a", "a b", ""]) == [1.0, 0.5, 0.0]


@pytest.mark.parametrize(
    ("author", "expected"),
    [
        ("Jane Doe", [("Jane", "", "Doe", "")]), ("Ludwig van Beethoven", [("Ludwig", "van", "Beethoven", "")]), ("de la Cruz, Juan", [("Juan", "de la", "Cruz", "")]),
        ("Ford, Jr, Henry and {Big and Co}", [("Henry", "", "Ford", "Jr"), ("", "", "{Big and Co}", "")]), ("D.E. Knuth", [("D. E.", "", "Knuth", "")]),
    ],
)
def test_names(spark, author, expected):
    assert [tuple(n) for n in values(spark, names.parse_names, [author])[0]["names"]] == expected


def test_bad_names(spark):
    many, none, empty = values(spark, names.parse_names, ["a, b, c, d", ", x", ""])
    assert many["error"] and none["error"] and empty.asDict() == {"names": [], "error": None}


def test_refs(spark):
    got = values(spark, refs.parse_ref, ["https://doi.org/10.1000/a(b)", "doi: 10.1/x", " arXiv:2101.00001v3 ", "https://arxiv.org/pdf/math.AG/0101001.pdf", "https://dx.doi.org/10.1000/a", "DOI:10.1234/x", "two words"])
    doubled = values(spark, refs.parse_ref, ["https://doi.org/doi:10.1234/x", "arXiv:https://arxiv.org/abs/2101.00001", "https://arxiv.org/abs/arXiv:2101.00001", "http://dx.doi.org/ 10.1234/x"])
    assert [r["kind"] for r in doubled] == ["text", "text", "text", "doi"]
    assert [r and tuple(r) for r in values(spark, refs.find_arxiv_id, ["x arXiv:2101.00001v2 y", "arXiv:math/0101001", "2101.00001"])] == [("2101.00001", 2), ("math/0101001", 0), None]
    assert [r["kind"] for r in got] == ["doi", "text", "arxiv", "arxiv", "text", "doi", "text"]
    assert (got[2]["arxiv_id"], got[2]["version"], got[3]["arxiv_id"]) == ("2101.00001", 3, "math.AG/0101001")
    assert values(spark, refs.find_doi, ["see (10.1234/ab.c).", "nothing"]) == ["10.1234/ab.c", None]
    assert values(spark, refs.find_arxiv, ["x arXiv:2101.00001v2 y", "2101.00001"]) == ["2101.00001v2", None]


def test_check_parts(spark):
    assert values(spark, braces_balanced, ["{a}{b}", "}{", "{", "x"]) == [True, False, False, True]
    words = ["a {{X} Y} z", "a $X$ b", "On\tDNA", "  DNA of x", "A {B} cD{E f}g } hI", "x {Y", "x y{Z}", "Only", "", "ß Äb"]
    assert values(spark, capital_words, words) == [[], ["$X$"], ["DNA"], [], ["cD{E f}g", "hI"], [], [], [], [], ["Äb"]]
    assert values(spark, raw_specials, [r"a \& b", "a & b % &", "$a & b$"]) == [[], ["&", "%"], []]
