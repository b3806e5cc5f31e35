"""Chat conversations as training windows under a token budget.

A turn is written `<|turn|>role`, a line end, its text and `<|end|>`, a line
end.  Control strings of this and of other common templates inside texts and
roles get a backslash after their first character, so no text can open or
close a turn; reading takes one backslash away again.  Running sums of turn
tokens cut a conversation between turns into spans that fit the budget.  Every
span is preceded by the system turn and by as much of the last turns as a
limit and the budget allow; of these repeated turns nothing is a target.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.tokens import default_path, encoder
from vellum.session import ship_package

BUDGET = 1024
HISTORY = 2
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_CONTROL = r"(?=\||/?s>|/?SYS>|/?INST\])"
_ESCAPE = re.compile(rf"([<\[])(\\*){_CONTROL}")
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\{_CONTROL}")
WINDOWS = "conv_id long, window int, n_context int, n_turns int, n_tokens int, text string, loss array<struct<start:int,end:int>>"
_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("n_context", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def write_turn(role: str, text: str) -> tuple[str, int]:
    """The written turn and where its text begins."""
    head = OPEN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    return head + escape(text) + CLOSE, len(head)


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    out = []
    for turn in window.split(OPEN)[1:]:
        role, _, text = turn.removesuffix(CLOSE).partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        out.append((role, unescape(text)))
    return out


class Windows:
    """The windows of one conversation, turn by turn; holds one window and the history."""

    def __init__(self, budget: int, history: int):
        self.budget, self.system, self.last = budget, None, deque(maxlen=history)
        self.context: list[tuple] = []
        self.new: list[tuple] = []
        self.tokens = self.seen = self.written = 0

    def add(self, role: str, text: str, turn: str, at: int, tokens: int) -> tuple | None:
        done = None
        if self.new and self.tokens + tokens > self.budget:
            done = self.close()
        if not self.new:
            room, keep = self.budget - tokens, []
            system = [self.system] if self.system and self.system[2] <= (room if room >= 0 else self.budget) else []
            room -= sum(c[2] for c in system)
            for old in reversed(self.last):
                room -= old[2]
                if room < 0:
                    break
                keep.insert(0, old)
            self.context = system + keep
            self.tokens = sum(c[2] for c in self.context)
        entry = (role, turn, tokens, at)
        self.new.append(entry)
        self.tokens += tokens
        if role == "system" and not self.seen:
            self.system = entry
        else:
            self.last.append(entry)
        self.seen += 1
        return done

    def close(self) -> tuple:
        spans, chars = [], sum(len(c[1]) for c in self.context)
        for role, turn, _, at in self.new:
            if role == "assistant":
                spans.append({"start": chars + at, "end": chars + len(turn) - len(CLOSE)})
            chars += len(turn)
        row = (self.written, len(self.context), len(self.new), self.tokens, "".join(c[1] for c in [*self.context, *self.new]), spans)
        self.written += 1
        self.new = []
        return row


def format_chat(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): WINDOWS, loss as code-point spans of text.

    Turns go by turn number, equal ones by role and text.  A null text or role
    is empty.  Each row with a null conv_id is a conversation of its own.  No
    window has more tokens than the budget, unless a turn alone exceeds it, which
    then is the window's only new one.  The system turn is repeated where it fits
    beside the first new turn, and before a turn that alone exceeds the budget
    where it would fit by itself; other windows go without it.  Repeated rows are turns of their own; other columns are ignored; an
    empty table gives no window.  A conversation is streamed in turn order, so
    its length isn't held in memory.
    """
    ship_package(conversations.sparkSession)
    path = tokenizer or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, key, state, out, size = encoder(path), (), None, [], 0

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)

        for batch in batches:
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            turns = [write_turn(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            tokens = [len(x) // 4 for x in enc.encode([t for t, _ in turns])]
            for conv, role, text, (turn, at), n in zip(ids, roles, texts, turns, tokens, strict=True):
                if key != (conv,) or conv is None:
                    if state:
                        out.append((key[0], *state.close()))
                    key, state = (conv,), Windows(budget, history)
                if done := state.add(role or "", text or "", turn, at, n):
                    out.append((conv, *done))
                    size += len(done[4])
                if size > 4_000_000:
                    yield batch_of(out)
                    out, size = [], 0
        if state:
            out.append((key[0], *state.close()))
        if out:
            yield batch_of(out)

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return turns.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(rows, WINDOWS)


def read_chat(windows: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, read back from the text and the loss spans of its windows."""
    ship_package(windows.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = (), None

        def row(key, state):
            return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            for conv, _, context, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv,) or conv is None:
                    out += [row(key, state)] if state else []
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text)[context:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(row(key, state), _DIGESTS, strict=True)], schema=_DIGESTS)

    parts = windows.select("conv_id", "window", "n_context", "text", "loss").repartition("conv_id", F.when(F.col("conv_id").isNull(), F.xxhash64("text"))).sortWithinPartitions("conv_id", "window")
    return parts.mapInArrow(rows, DIGESTS)


def op10_query(conversations: DataFrame) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_chat(format_chat(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))
