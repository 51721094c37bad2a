"""The pipeline: each stage against a plain version of it on what its predecessor kept."""

import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corvid.llm import mixing, scratch, toxicity


def _shingles(t):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in brute.words(t)]
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _groups(rows):
    """The least id of each text's group by exact Jaccard similarity, compared pair by pair."""
    sets = {i: _shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (not sets[a] and not sets[b]) or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0]
    return brute.components(ids, pairs)


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What goes into each stage, and what comes out of the last."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch.fresh(spark, f"test-{name}")
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def _texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_toxicity(spark, sf, kept):
    model = toxicity.learned(kept[0], spark.read.parquet(f"{sf}/labels.parquet"))
    want = {i for i, t in _texts(kept[0]) if brute.toxicity(t, model, toxicity.LOOKALIKES, toxicity.SIGNS) < 0.5}
    assert {i for i, _ in _texts(kept[1])} == want and kept[1].columns == kept[0].columns


def test_near_copies(kept):
    rows = _texts(kept[1])
    group = _groups(rows)
    assert sorted(_texts(kept[2]), key=str) == sorted(((i, t) for i, t in rows if group[i] == i), key=str) and kept[2].columns == kept[0].columns


def test_substrings(kept):
    rows, cut = _texts(kept[2]), dict(_texts(kept[3]))
    want = brute.substrings(rows)
    assert set(cut) == {i for i, (n, gone, _) in want.items() if gone < n or n == 0}
    for i, t in rows:
        if i in cut:
            assert len(brute.words(cut[i])) == want[i][0] - want[i][1]
            assert cut[i] == t if not want[i][1] else brute.substrings([(i, cut[i])])[i][2] == want[i][2]


def test_mixing(kept):
    rows = _texts(kept[3])
    copies = Counter(i for i, _ in _texts(kept[4]))
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mixed(kept[3]).collect()}
    assert copies == Counter({i: n for i, (size, t) in taken.items() if size and (n := int(np.floor(t / size + 0.5)))})
    assert set(_texts(kept[4])) <= set(rows) and kept[4].columns == kept[0].columns


def test_packing(kept):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    times, text = Counter(i for i, _ in _texts(kept[4])), dict(_texts(kept[4]))
    pieces, used = {}, {}
    for r in kept[5].collect():
        pieces.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(times)
    for i, n in times.items():
        ids = np.array([*tok.encode(text[i] or "", add_special_tokens=False).ids, 0], "<u4")
        seen = Counter((r.start, r.length) for r in pieces[i])
        assert set(seen.values()) == {n} and sum(length for _, length in seen) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in pieces[i])
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run(spark, sf, kept):
    out = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert key(out) == key(kept[5])
