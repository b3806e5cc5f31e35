"""A bucket that is thinned while it is read gives what one read at once gives."""

import numpy as np
import pyarrow as pa
import zstandard

from vellum.llm import substring


def test_thinned_bucket():
    rng = np.random.default_rng(7)
    passages = [" ".join(rng.choice(["a", "b", "c"], 40)) for _ in range(6)]
    docs = []
    for i in rng.permutation(60).tolist():
        docs.append((i, 0, " ".join(f"x{i} {passages[p]} y{i}" for p in rng.choice(6, 3)).encode().split(), 0))
    press = zstandard.ZstdCompressor()
    rows = [(0, np.array([(k, t, start, n)], substring._META).tobytes(), press.compress(packed)) for _, k, t, start, n, packed in substring.super_kmers(docs, 20, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 10], strict=True), substring._SENT, strict=True)], schema=substring._SENT) for a in range(0, len(rows), 10)]

    def places(limit):
        return {(r["k"], p) for b in substring._count(20, limit)(iter(batches)) for r in b.to_pylist() for p in range(r["start"], r["start"] + r["n"])}

    seen, want = set(), set()
    for k, _, words, _ in sorted(docs):
        for a in range(len(words) - 19):
            w = tuple(words[a : a + 20])
            if w in seen:
                want.add((k, a))
            seen.add(w)
    assert places(10**9) == want == places(500) and len(want) > 500
