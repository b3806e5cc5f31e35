"""Texts of more short words than one batch can number."""

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import rolling, substring


def test_passages_far_apart_meet():
    rng = np.random.default_rng(6)
    words = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_600_000)
    passage = words[1_500_000:1_500_300]
    sent = [b for k, text in ((1, passage), (2, words)) for b in substring._send(20, 3, 5000)(iter([pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([0], pa.int64()), pa.array([" ".join(text)])], names=["k", "t", "text"])]))]
    sent = pa.Table.from_batches(sent).sort_by("bucket")
    found = [r for b in substring._count(20)(iter(sent.to_batches())) for r in b.to_pylist()]
    assert {r["k"] for r in found} == {2}
    got = sorted(i for r in found for i in range(r["start"], r["start"] + r["n"]))
    assert got == list(range(1_500_000, 1_500_281))


def test_too_many_places_are_refused():
    with pytest.raises(ValueError):
        rolling.minimisers(np.zeros((1 << rolling.INDEX_BITS) + 1, np.uint64), 18)
