"""Document operators against plain versions, with nulls, empty texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_fixture import PASSAGE

from vellum.llm import arrow_tokens, decontaminate, lines, packing, simhash, substring, suffix, tokens, toxicity
from vellum.session import scratch_path, table


SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "  ", "   a", "a   b", "a \n b", "a\n\n b ", "x\t y", "it's we'll 12,000.5 ### é漢字🙂", "a   b", "end  ", "\n", " \n x", "<|endoftext|> z <|endoftext|>", "o’clock  —  d'ĺ"])
def test_encoder_equals_library(library, text):
    enc = tokens.Encoder(tokens.default_path(), memo_pieces=3)
    for _ in range(2):
        assert np.frombuffer(enc.encode([text, "other text", text])[2], "<u4").tolist() == library(text)


def test_best_fit_tree():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 65, 60).tolist()
        windows = packing.best_fit_decreasing(lengths, 64)
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(64 - n)
            else:
                rooms[rooms.index(fit)] -= n
        assert sorted(64 - sum(lengths[i] for i in w) for w in windows) == sorted(rooms)
        packed = packing.pack_block(lengths + [500], 64)
        assert all(sum(p[2] for p in w) <= 64 for w in packed)
        got = defaultdict(list)
        for w in packed:
            for d, s, n in w:
                got[d] += range(s, s + n)
        assert all(sorted(got[d]) == list(range(n)) for d, n in enumerate(lengths + [500]))


def test_packing(spark, docs, none, library):
    rows = packing.op4_query(docs).collect()
    whole = {i: library(t) + [1] for i, t in texts(docs)}
    fill = defaultdict(dict)
    for r in rows:
        ids = np.array(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["length"] and r["doc_tokens"] == len(whole[r["doc_id"]])
        fill[r["sequence_id"]][r["offset"]] = r["length"]
    assert sum(r["length"] for r in rows) == sum(map(len, whole.values()))
    for pieces in fill.values():
        at = 0
        for offset in sorted(pieces):
            assert offset == at
            at += pieces[offset]
        assert at <= 2048
    assert packing.op4_query(none).count() == 0


def test_arrow_files(spark, docs, none, library):
    folder = scratch_path(spark, "test-tokens")
    manifest = arrow_tokens.write_tokens(docs, folder, length=64, rows=4)
    got = arrow_tokens.read_tokens(manifest, folder).orderBy("start").collect()
    ordered = sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in ordered]
    at = 0
    for r, (_, t) in zip(got, ordered, strict=True):
        ids = np.array([*library(t), 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = manifest.orderBy("shard").first()
    shard = arrow_tokens.Shard(first["path"], folder)
    row, mask = shard.row(0)
    assert len(row) == len(mask) == 64 and row[: min(64, first["tokens"])].tolist() == shard.ids(0, min(64, first["tokens"])).tolist() and mask.sum() == min(64, first["tokens"])
    assert not row.flags.owndata and not mask.flags.owndata and mask.dtype == np.uint8
    for x in manifest.collect():
        s = arrow_tokens.Shard(x["path"], folder)
        masks = np.concatenate([s.row(i)[1] for i in range(-(-x["tokens"] // 64))])
        assert masks.tolist() == [1] * x["tokens"] + [0] * (-x["tokens"] % 64)
    assert arrow_tokens.op6_query(none).count() == 0


def plain_fingerprint(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_bit_slices():
    rng = np.random.default_rng(3)
    for radius in (0, 1, 3, 6):
        base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        fps = np.unique(np.concatenate([base ^ (rng.integers(0, 1 << 63, 40, dtype=np.uint64) & rng.integers(0, 1 << 63, 40, dtype=np.uint64) & rng.integers(0, 1 << 63, 40, dtype=np.uint64) & rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(5)] + [base]))
        planes = simhash.planes_of(fps)
        words = planes.shape[1]
        at, lane = simhash.within(planes, np.repeat(fps, words), np.tile(np.arange(words), len(fps)), radius)
        spot = at % words * 64 + lane
        got = {(int(a // words), int(s)) for a, s in zip(at, spot, strict=True) if s < len(fps)}
        assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_simhash(spark, docs, none):
    rows = simhash.op2_query(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((i, f"{plain_fingerprint(t, 3):016x}") for i, t in texts(docs))
    fps = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows]
    group = {f: {f} for _, f, _ in fps}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    for _, f, c in fps:
        assert c == min((i for i, g, _ in fps if g in group[f] and i is not None), default=None)
    assert simhash.op2_query(none).count() == 0


def test_hot_bucket_in_chunks(spark):
    fps = [(x,) for x in range(0, 3000)]
    found = simhash.links(spark.createDataFrame(fps, "fp long"), chunk=64)
    from vellum.llm.components import components

    assert {r["component"] for r in components(found).collect()} == {0}


def test_substrings(spark, docs, none):
    rows = by_id(substring.op5_query(docs))
    seen = set()
    for i, t in sorted(texts(docs), key=lambda x: (x[0] is None, x[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.op5_query(none).count() == 0


def test_bytes(spark, docs, none):
    rows = by_id(suffix.op8_query(docs))
    data = {i: (t or "").encode() for i, t in texts(docs)}
    counts = Counter(b[a : a + 200] for b in data.values() for a in range(len(b) - 199))
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, int)
        for a in range(len(b) - 199):
            if counts[b[a : a + 200]] > 1:
                gone[a : a + 200] = 1
        spans = int(((gone[:-1] == 1) & (np.concatenate([[0], gone[:-2]]) == 0)).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (len(b), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffix.op8_query(none).count() == 0


def test_periodic_bytes(spark):
    df = spark.createDataFrame([(1, "a" * 450), (2, "ab" * 150), (3, "b" + "ab" * 120)], "doc_id long, text string")
    rows = by_id(suffix.op8_query(df))
    assert [(rows[i]["n_removed"], rows[i]["n_spans"]) for i in (1, 2, 3)] == [(450, 1), (300, 1), (241, 1)]


def test_column_sort_against_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(30):
        core = bytes(rng.integers(97, 99, 40).tolist())
        parts, at = [], []
        for _ in range(12):
            a, b = int(rng.integers(0, 12)), int(rng.integers(20, 40))
            p = bytearray(core[a:b])
            if rng.random() < 0.6:
                p[int(rng.integers(0, len(p)))] = 120
            parts.append(bytes(p))
            at.append(15 - a)
        got = [set(x.tolist()) for x in suffix.repeated_starts(parts, at, 8)]
        for i, p in enumerate(parts):
            want = {s for s in range(len(p) - 7) if any(j != i and 0 <= s - at[i] + at[j] and q[s - at[i] + at[j] :][:8] == p[s : s + 8] for j, q in enumerate(parts))}
            assert got[i] == want


def test_one_edit_and_variants():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.choice(["x", "y", "z"], int(rng.integers(5, 8))).tolist()
        b = rng.choice(["x", "y", "z"], int(rng.integers(5, 8))).tolist()
        d = np.arange(len(b) + 1)
        for i, p in enumerate(a):
            e = [i + 1]
            for j, q in enumerate(b):
                e.append(min(d[j] + (p != q), d[j + 1] + 1, e[j] + 1))
            d = np.array(e)
        assert lines.one_edit(" ".join(a), " ".join(b)) == (d[-1] <= 1)
        pa, va = lines.variants_of([w.encode() for w in a])
        pb, vb = lines.variants_of([w.encode() for w in b])
        meets = any(x == y and (p == q or -1 in (p, q)) for p, x in zip(pa, va.tolist(), strict=True) for q, y in zip(pb, vb.tolist(), strict=True))
        assert meets == (d[-1] <= 1)
        if d[-1] <= 1:
            assert set(lines.anchors_of([w.encode() for w in a])) & set(lines.anchors_of([w.encode() for w in b]))


def test_lines(spark, docs, none):
    rows = by_id(lines.dedup_lines(docs))
    assert rows[4]["text"] == "x" and rows[4]["n_removed"] == 2
    assert rows[1]["n_removed"] == 0 and rows[2]["text"] is None and rows[2]["n_lines"] == 0 and rows[3]["text"] == ""
    assert rows[10]["text"] == "" and rows[9]["n_removed"] == 0 and rows[None]["text"] == "" and rows[6]["text"] == ""
    assert rows[8]["k"] == "k" and rows[8]["source"] == "c"
    assert lines.op9_query(none).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "unrelated words that occur nowhere at all in any of these documents"), (2, PASSAGE), (3, None), (4, "x"), (5, "words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op1_query(docs, bench).collect()}
    assert got == {(1, 2), (9, 2), (10, 2)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3, 4, 5, 6, 7, 8, None}
    assert decontaminate.op1_query(none, bench).count() == 0 and decontaminate.op1_query(docs, bench.limit(0)).count() == 0


def test_masks_hit_any_two_substitutions():
    from itertools import combinations

    for pair in combinations(range(decontaminate.WINDOW), 2):
        assert any(not any(s + i in pair for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - len(m) + 1))


def test_toxicity(spark, docs, none):
    big = "/root/testdata/sf0.1"
    d, labels = table(spark, big, "documents"), table(spark, big, "labels")
    rows = {r["doc_id"]: r for r in toxicity.op3_query(d, labels).collect()}
    held = [(rows[r["doc_id"]], r["toxic"]) for r in labels.collect() if toxicity.crc_fold(r["doc_id"])]
    assert all(r["held_out"] for r, _ in held) and all(r["held_out"] == toxicity.crc_fold(i) for i, r in rows.items())
    hit = sum(r["predicted"] == 1 and t == 1 for r, t in held)
    assert hit / sum(r["predicted"] for r, _ in held) > 0.9 and hit / sum(t for _, t in held) > 0.85
    learned = toxicity.fit(d, labels)
    assert 0 < learned.disagreement < 0.03 and len(learned.accuracies) == len(learned.correlations) > 4
    model = toxicity.fit(docs, labels.limit(0))
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["toxicity"] < 0.7 for r in scored)
    assert toxicity.op3_query(none, labels).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs, kept = table(spark, SF, "documents"), []
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_special_strings_and_other_tokenizers(library):
    import random

    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "a", "be", "'s", "é", "漢", " ", "　", ".", ",", "12", "\t", "<|endoftext|>", "\r\n", "🙂", "\x1c", "word", "Ġ", "Ċ", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    enc = tokens.Encoder(tokens.default_path(), memo_pieces=500)
    assert all(np.frombuffer(ids, "<u4").tolist() == library(t) for t, ids in zip(texts, enc.encode(texts), strict=True))
    assert np.frombuffer(enc.encode(["x <|endoftext|> y"])[0], "<u4").tolist() == [87, 220, 50256, 331]
    assert 50256 not in np.frombuffer(tokens.Encoder(tokens.default_path(), plain_text=True).encode(["x <|endoftext|> y"])[0], "<u4")
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    assert [np.frombuffer(i, "<u4").tolist() for i in tokens.Encoder(path).encode(["Two  Words", None, ""])] == [other.encode(t, add_special_tokens=False).ids for t in ("Two  Words", "", "")]


def test_label_model_needs_no_labels():
    """Posteriors from votes alone find the hidden class of made votes, and tell good voters from bad ones."""
    rng = np.random.default_rng(6)
    hidden = rng.random(4000) < 0.15
    right = [0.95, 0.9, 0.85, 0.8, 0.6]
    votes = np.stack([np.where(rng.random(4000) < 0.3, 0, np.where((rng.random(4000) < p) == hidden, 1, -1)) for p in right], 1).astype(np.int8)
    q, accuracy, corr = toxicity.label_model(votes, 0.15)
    assert ((q > 0.5) == hidden).mean() > 0.95 and accuracy[0] > accuracy[3] > accuracy[4] and corr.shape == (5, 5)
