"""Windows of chats against a plain version, with system turns of any length."""

import random

import pytest

from vellum.llm import chat

BUDGET, HISTORY = 120, 2


def plain(turns):
    """Windows as lists of turn numbers (context, new), by looking back at all turns."""
    fits = lambda chosen: sum(turns[i][2] for i in chosen) <= BUDGET
    system = 0 if turns[0][0] == "system" else None
    out, i = [], 0
    while i < len(turns):
        alone = turns[i][2] > BUDGET
        context = [] if system is None or i == 0 or not fits([0] if alone else [0, i]) else [0]
        for j in reversed([j for j in range(i) if j != system][-HISTORY:]):
            if not fits([*context, j, i]):
                break
            context = context[:1] * (system in context) + [j] + context[(system in context) :]
        new = [i]
        while i + len(new) < len(turns) and fits([*context, *new, i + len(new)]):
            new.append(i + len(new))
        out.append((context, new))
        i += len(new)
    return out


@pytest.mark.parametrize("system", [None, 1, 40, 90, 300])
def test_windows_keep_the_budget(spark, system):
    rng = random.Random(system)
    text = lambda n: " ".join(rng.choice(("one", "two", "three")) for _ in range(n))
    rows = []
    for conv in range(12):
        said = [("system", text(system))] if system else []
        said += [(("user", "assistant")[k % 2], text(rng.choice((1, 5, 20, 60, 80, 150)))) for k in range(rng.randrange(1, 14))]
        rows += [(conv, k, role, t) for k, (role, t) in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = {}
    for w in chat.format_chat(df, BUDGET, HISTORY).orderBy("conv_id", "window").collect():
        windows.setdefault(w["conv_id"], []).append(w)
    enc = chat.encoder(chat.default_path())
    for conv in range(12):
        turns = [(role, t, len(enc.encode([chat.write_turn(role, t)[0]])[0]) // 4) for c, _, role, t in rows if c == conv]
        theirs = plain(turns)
        got = [(chat.read_turns(w["text"]), w["n_context"], w["n_tokens"]) for w in windows[conv]]
        assert [g[0] for g in got] == [[turns[i][:2] for i in context + new] for context, new in theirs]
        for (_, n_context, n), (context, new) in zip(got, theirs, strict=True):
            assert n_context == len(context) and n == sum(turns[i][2] for i in context + new)
            assert n <= BUDGET or len(new) == 1 and turns[new[0]][2] > BUDGET
