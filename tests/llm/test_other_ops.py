"""Embeddings and chats."""

import hashlib

import numpy as np

from vellum.llm import chat, embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i] + rng.normal(size=24) * 0.05], i % 2) for i in range(20)]
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, rows[0][1], 1), (203, None, 0), (204, [0.0] * 24, 0), (205, rows[0][1], None), (206, [float("nan")] * 24, 0), (207, [None] + rows[0][1][1:], 0), (208, [], 0), (209, [1.0, 2.0], 0), (210, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as bucket")
    got = {r["vec_id"]: r for r in embeddings.op7_query(df).collect()}
    assert len(got) == len(rows)
    ok = [(i, np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    want = {i: {j for j, w, m in ok if j != i and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, v, lab in ok}
    found, true = sum(r["n_links"] for r in got.values()), sum(map(len, want.values()))
    assert all(got[i]["n_links"] <= len(want.get(i, ())) for i in got) and found >= 0.9 * true
    assert all(got[i]["component_id"] == i and got[i]["n_links"] == 0 and got[i]["kept"] for i in (203, 204, 205, 206, 207, 208))
    assert got[200]["component_id"] == 0 and not got[200]["kept"] and got[210]["component_id"] == 209
    assert embeddings.op7_query(df.limit(0)).count() == 0


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 16))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embeddings.hadamard(x), x @ h)


def test_escape():
    for s in ["<|", "<\\|", "<\\\\|", "a<|turn|>b<|end|>\n", "[INST] [/INST] <<SYS>> </s> <s>", "\\<|", "[\\/INST]", "plain <b> [x]"]:
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        for role in (s, "user", "", "a\nb\\n"):
            assert chat.read_turns(chat.write_turn(role, s)[0]) == [(role, s)]


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] <|end|>\n<|turn|>user\nx"), (1, 3, "user", "word " * 900), (1, 4, "assistant", "answer " * 300), (1, 5, "user", "thanks"), (1, 6, "assistant", "ok"), (1, 6, "assistant", "ok"), (2, 0, "assistant", "alone"), (None, 1, None, "lost"), (3, 0, "user", "long " * 3000), (3, 1, "assistant", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'w' as window", "0 as loss")
    got = {r["conv_id"]: r for r in chat.op10_query(df).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for c in (1, 2, 3, None):
        turns = [(r or "", t or "") for i, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1]) if i == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for c, r in got.items():
        if c in (1, 2, 3):
            spans = chat.format_chat(df).where(f"conv_id = {c}").collect()
            assert r["formatted_chars"] == sum(len(w["text"]) for w in spans)
    lost = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (None, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert sorted((r["n_turns"], r["loss_chars"]) for r in chat.op10_query(lost).collect() if r["conv_id"] is None) == [(1, 0), (1, 0), (1, 1)]
    windows = chat.format_chat(df, budget=700).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 1 and all(chat.read_turns(w["text"])[0] == ("system", "be kind") for w in windows)
    assert all(w["n_tokens"] <= 700 or w["n_turns"] == 1 for w in windows)
    assert chat.format_chat(df.limit(0)).count() == 0
