"""Author lists as expressions against a walk through each list in Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import names


def _depths(s: str) -> list[int]:
    """Brace depth before each character."""
    out, d = [], 0
    for c in s:
        out.append(d)
        d = d + 1 if c == "{" else max(0, d - 1) if c == "}" else d
    return out


def _split_outside(s: str, pattern: str) -> list[str]:
    depth, out, at = _depths(s), [], 0
    for m in re.finditer(pattern, s):
        if depth[m.start()] == 0 and m.start() >= at:
            out.append(s[at : m.start()])
            at = m.end()
    return [*out, s[at:]]


def _words(part: str) -> list[str]:
    found = []
    for w in _split_outside(part, r"[\s~]"):
        found += [x for x in _split_outside(w, r"(?<=\.)(?![-]|$)") if x]
    return found


def parse_name(author: str) -> tuple[str, str, str, str]:
    """(first, von, last, jr) of one author; ValueError if there is none or too many commas."""
    parts = [_words(p) for p in _split_outside(author, ",")]
    if len(parts) > 3 or not parts[0]:
        raise ValueError(f"not a name: {author}")
    lower = lambda w: bool(w) and w[0].islower()
    head = parts[0]
    small = [i for i, w in enumerate(head[:-1]) if lower(w)]
    if len(parts) == 1:
        if small:
            first, von, last = head[: small[0]], head[small[0] : small[-1] + 1], head[small[-1] + 1 :]
        else:
            first, von, last = head[:-1], [], head[-1:]
        jr: list[str] = []
    else:
        von = head[: small[-1] + 1] if small and small[0] == 0 else []
        last = head[len(von) :]
        first, jr = parts[-1], parts[1] if len(parts) == 3 else []
    return tuple(" ".join(x) for x in (first, von, last, jr))


def parse_list(text: str) -> dict:
    try:
        found = [parse_name(a) for a in _split_outside(text, " and ")] if text else []
        return {"names": [dict(zip(("first", "von", "last", "jr"), n, strict=True)) for n in found], "error": None}
    except ValueError as e:
        return {"names": [], "error": str(e)}



CASES = [
    None, "", " ", "Doe, Jane", "Jane Doe", "Jane van der Doe", "van der Doe, Jane", "Doe, Jr, Jane", "A, b, c, d", ", x", " and ", "A and B and C", "{A and B} and C", "{Barnes and Noble, Inc.}", "J.K. Rowling", "J.-P. Serre",
    "J.{K}. X", "J.} K", "{J.}K", "a.b.{c}.d", "A {and} B", "x and  and y", "de la Vall{\\'e}e Poussin, Ch.", "jean", "jean paul", "Jean de", "\u00c9mile \u00e9mile Borel", "a~b\u00a0c\u2003D", "}x{ and y", "{a", "a}, b", "A.B. and {C and D}, e.f.", "\u1d43bc Def, G", "A,,", "A,B,C", "x\u001cy\u0085z W",
]


def both(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", names.parse_names("t").alias("n"), names.name_errors(F.col("t"), F.lit(None).cast("string")).alias("e")).collect()
    for r in rows:
        theirs = parse_list(texts[r["i"]] or "")
        assert [n.asDict() for n in r["n"]["names"]] == theirs["names"], texts[r["i"]]
        assert r["n"]["error"] == theirs["error"] == r["e"]["author"] and r["e"]["editor"] is None


def test_lists(spark):
    both(spark, CASES)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["{", "}", ",", ".", "-", " ", "~", " and ", "A", "b", "van", "\u00e9", "Jr"]), max_size=14).map("".join), min_size=150, max_size=150))
def test_random_lists(spark, texts):
    both(spark, texts)


@pytest.mark.parametrize("column", ["names", "error"])
def test_no_python_worker(spark, column):
    plan = spark.createDataFrame([("A and B",)], "t string").select(names.parse_names("t")[column])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
