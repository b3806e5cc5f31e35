"""Composition of texts against Python's, and TeX encoding against a plain version."""

import random
import unicodedata

from pyspark.sql import functions as F

from vellum.functions import compose, tex

MARKS = "̸̧̨̣̀́̂̃̄̆̇̈̊̋̌ͅ͏़゙゚्ּ֑〮\U0001d165\U0001d16d"
OTHERS = "aeoqAEOLz&%#_éÅấǘÅΩक़कোৗෝ각가각か豈̈́̀ά⫝̸\U0001d15e\U0002f800יִ–— "


def run(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def some(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(MARKS if rng.random() < 0.5 else OTHERS) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_every_character(spark):
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["|".join(chars[i : i + 500]) for i in range(0, len(chars), 500)]
    texts += ["|".join(unicodedata.normalize("NFD", c) for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    assert run(spark, compose.composed, texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_mixed_sequences(spark):
    texts = [*some(4000, 1), None, "", "́", "́a", "é" * 50_000, "plain " * 500_000 + "é", "क़" * 20_000]
    assert run(spark, compose.composed, texts) == [t and unicodedata.normalize("NFC", t) for t in texts]


def plain_encode(s):
    written, own = {v: k for k, v in tex.MARKS.items()}, {v: k for k, v in tex.LITERALS.items()}
    out, clusters = [], []
    for c in unicodedata.normalize("NFC", s):
        if clusters and unicodedata.category(c) == "Mn":
            clusters[-1] += c
        else:
            clusters.append(c)
    for cl in clusters:
        d = unicodedata.normalize("NFD", cl)
        if cl in ("–", "—"):
            out.append("--" if cl == "–" else "---")
        elif cl in tuple("&%#_"):
            out.append("\\" + cl)
        elif cl in own:
            out.append("{\\" + own[cl] + "}")
        elif len(d) == 2 and d[1] in written and d[0].isascii() and d[0].isalpha():
            m = written[d[1]]
            out.append("{\\" + m + ("{" + d[0] + "}" if m.isalpha() else d[0]) + "}")
        else:
            out.append(cl)
    return "".join(out)


def test_encode(spark):
    letters = [x + m for m in tex.MARKS.values() for x in "aAbBcCiIjJqQzZ"]
    texts = [*some(3000, 2), None, "", "".join(letters), *letters, "Erdős – Å—ß & 50% #1 a_b", "Zoë " * 50_000]
    assert run(spark, tex.encode, texts) == [t if t is None else plain_encode(t) for t in texts]


def test_encode_needs_no_python(spark):
    plan = spark.range(1).select(tex.encode(F.col("id").cast("string")).alias("e"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
