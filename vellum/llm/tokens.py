"""Tokenising inside tasks with the `tokenizers` library, each distinct word once.

The byte-level pattern never lets a token hold a space except as its first
character, nor a letter with a mark after it, so a text falls apart before
every single space, around a line feed between two visible characters and
after the letters of a word, without changing its ids.  The pieces of
a group of texts are numbered by Arrow's dictionary encoding; the library
encodes the new ones in long strings that are cut again at tokens that begin
with a space or are a line feed; numpy lays the ids of all pieces out.

Three kinds of texts go through the library whole: those with a run of white
space that reaches across a single space, with white space beyond ASCII, or
with the string of an added token, which has an id of its own.  So do all
texts under a tokenizer that isn't byte-level in this plain way.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PIECES = 1_000_000
GROUP_BYTES = 8_000_000
JOINED_PIECES = 20_000
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_VISIBLE = (np.arange(256) > 32) & (np.arange(256) < 127)
_LETTER = np.isin(np.arange(256), [c for c in range(128) if chr(c).isalpha()])
_MARK = _VISIBLE & ~_LETTER
_WIDE_WHITE = "[\u0085   -     　]"
_INNER_WHITE = r"(?s)^.+[\t-\r\x1c-\x20]|^[\t-\r\x1c-\x1f]|^ $"
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ids(encodings: list) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in encodings]


class Encoder:
    """A tokenizer file with what is known of pieces, in two generations so that a full memo forgets only old ones.

    Ids are those of the library's encode(text, add_special_tokens=False).  With
    plain_text the strings of added tokens are tokenised like any other text.
    """

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, plain_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_text
        self.vocabulary = self.library.get_vocab_size()
        self.memo_pieces = memo_pieces
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        cutter = plan.get("pre_tokenizer") or {}
        self.line_feed = self.library.token_to_id("Ċ")
        self.splits = (
            plan.get("normalizer") is None and plan.get("truncation") is None and plan.get("padding") is None and self.line_feed is not None
            and plan["model"]["type"] == "BPE" and not plan["model"].get("dropout")
            and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        )
        self.added = [t["content"] for t in plan.get("added_tokens") or () if not (plain_text and t.get("special"))]
        self.spaced = np.zeros(self.vocabulary, bool)
        for token, i in self.library.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")

    def forget(self) -> None:
        """Drop what is remembered; workers outlive their tasks and would keep it beside later stages."""
        self.young, self.old = {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return _ids(self.library.encode_batch_fast(texts, add_special_tokens=False))

    def _joined(self, pieces: list[str], glue: str) -> list[bytes]:
        """Ids of pieces that all begin with their only space, or that hold none and are set apart by line feeds."""
        out: list[bytes] = []
        for at in range(0, len(pieces), JOINED_PIECES):
            part = pieces[at : at + JOINED_PIECES]
            ids = np.array(self.library.encode_batch_fast([glue.join(part)], add_special_tokens=False)[0].ids, "<u4")
            if glue:
                ends = np.append(np.flatnonzero(ids == self.line_feed), len(ids))
                starts = np.append(0, ends[:-1] + 1)
            else:
                starts = np.flatnonzero(self.spaced[ids])
                ends = np.append(starts[1:], len(ids))
            if len(starts) != len(part):
                return self._whole(pieces)
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
        return out

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        odd = pc.match_substring_regex(pa.array(fresh, pa.string()), _INNER_WHITE).to_pylist()
        spaced = [p for p, o in zip(fresh, odd, strict=True) if not o and p[0] == " "]
        bare = [p for p, o in zip(fresh, odd, strict=True) if not o and p[0] != " "]
        strange = [p for p, o in zip(fresh, odd, strict=True) if o]
        known = dict(zip(spaced, self._joined(spaced, ""), strict=True))
        known.update(zip(bare, self._joined(bare, "\n"), strict=True))
        known.update(zip(strange, self._whole(strange), strict=True))
        return known

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, remembered or learned."""
        found = list(map(self.young.get, pieces))
        late = [i for i, v in enumerate(found) if v is None]
        if late:
            older = {p: v for p in (pieces[i] for i in late) if (v := self.old.get(p)) is not None}
            fresh = self._learn([p for p in (pieces[i] for i in late) if p not in older])
            if len(self.young) + len(late) > self.memo_pieces // 2:
                self.old, self.young = self.young, {}
            for i in late:
                p = pieces[i]
                v = older.get(p)
                found[i] = fresh[p] if v is None else v
            self.young.update(older)
            self.young.update(fresh)
        return found

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and the place where each text begins, with the end; null gives none."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.splits:
            return _laid_out(self._whole(texts.to_pylist()))
        edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        buffer = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(buffer, np.uint8)[edge[0] : edge[-1]] if buffer is not None else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        whole = np.zeros(len(texts), bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        spaces, feeds = np.flatnonzero(data == 32), np.flatnonzero(data[1:-1] == 10) + 1
        runs = spaces[(spaces > 0) & _WHITE[data[spaces - 1]]]
        owner = np.searchsorted(edge, runs, "right") - 1
        last = runs + 1 == edge[owner + 1]
        across = (runs > edge[owner]) & (last | _WHITE[data[np.minimum(runs + 1, len(data) - 1)]])
        whole[owner[across]] = True
        feeds = feeds[_VISIBLE[data[feeds - 1]] & _VISIBLE[data[feeds + 1]]]
        cut = np.zeros(len(data) + 1, bool)
        np.logical_and(_LETTER[data[:-1]], _MARK[data[1:]], out=cut[1:-1])
        for places in (edge, spaces, feeds, feeds + 1):
            cut[places] = True
        cuts = np.append(np.flatnonzero(cut[:-1]), len(data))
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        code, first = pieces.indices.to_numpy(), np.searchsorted(cuts, edge)
        wide = pc.match_substring_regex(pieces.dictionary, _WIDE_WHITE).to_numpy(zero_copy_only=False)
        if wide.any():
            whole[np.searchsorted(edge, cuts[:-1][wide[code]], "right") - 1] = True
        known = self._ids_of(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(at[code] - (ends - n), n) + np.arange(ends[-1])]
        starts = np.append(0, ends)[first]
        if not whole.any():
            return ids, starts
        apart = iter(self._whole([texts[int(i)].as_py() for i in np.flatnonzero(whole)]))
        return _laid_out([next(apart) if w else ids[a:b].tobytes() for w, a, b in zip(whole.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; null gives none."""
        ids, starts = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), "<u4"), np.append(0, np.cumsum(sizes))


def encoder(path: str, plain_text: bool = False) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = (path, plain_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, plain_text=plain_text)
    return _ENCODERS[key]


def encoded(batches: Iterator[pa.RecordBatch], enc: Encoder, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the rows (doc_id, text) of batches, in their order; a bounded number of bytes, or one text, is encoded at once."""

    def ready(held: list[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        ids, starts = enc.encode_array(pa.concat_arrays([b.column(1).cast(pa.string()) for b in held]))
        keys = [k for b in held for k in b.column(0).to_pylist()]
        for k, a, b in zip(keys, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield k, ids[a:b]

    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > group_bytes:
            yield from ready(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from ready(held)
