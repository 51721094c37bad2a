"""Each query against its contract, on whole small tables."""

import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvid.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple(map(str, r))
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)


def test_packing(spark, sf, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, by_seq = defaultdict(list), defaultdict(list)
    for r in QUERIES["op2_packing"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {i for i, _ in docs}
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
        used += at
    assert used / (1024 * len(by_seq)) > 0.97


def test_simhash(spark, sf, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, sf).collect()}
    assert got == brute.simhash(docs)


def test_toxicity(spark, sf):
    rows = QUERIES["op4_toxicity"](spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) if bad else 1.0
    assert auc > 0.8


def test_quality(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op5_quality_compression"](spark, sf).collect()}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
        assert not (r.base_failed and r.kept)


def test_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op6_embedding_dedup"](spark, sf).collect()}
    assert got == brute.vectors(rows)


def test_token_counts(spark, sf, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, sf).collect()}
    for i, t in docs:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)


def test_substrings(spark, sf, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"](spark, sf).collect()}
    assert got == brute.substrings(docs)


def test_mixing(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {r.doc_id: len(brute.words(r.text)) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    per = defaultdict(int)
    for i, n in size.items():
        per[source[i]] += n
    want = brute.targets(dict(per))
    got = QUERIES["op9_mixing"](spark, sf).collect()
    assert {r.doc_id: r["size"] for r in got} == size
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == per[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(130, 0.02 * t)
    again = {r.doc_id: r.taken for r in QUERIES["op9_mixing"](spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in got}
