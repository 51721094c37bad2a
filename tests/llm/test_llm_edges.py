"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from corvid.llm import chat, components, embeddings, licences, mixing, packing, quality, simhash, substrings, textkernel, tokens, toxicity

LONG = " ".join(f"w{k % 977}x{k}" for k in range(20_000))
PASSAGE = " ".join(f"p{k}" for k in range(60))
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r ", None, None),
    (4, LONG, "en", "b"),
    (5, f"one {PASSAGE} two", "en", "a"),
    (6, f"three {PASSAGE} four and more", "en", None),
    (7, f"one {PASSAGE} two", "de", "c"),
    (7, f"one {PASSAGE} two", "de", "c"),
    (7, "other text under the same id", "de", "c"),
    (None, "no id at all but some words", "en", "b"),
    (8, "Ünïcödé 😀 naïve <|endoftext|> Σίσυφος 漢字", "en", "a"),
    (-3, "short", "fr", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, n_words string, size string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", "c", "n", "z", "k") for r in ROWS], SCHEMA).coalesce(2)


def test_quality(docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(docs).collect())
    assert got == sorted((i is None, i or 0, *brute.quality(t)) for i, t, *_ in ROWS)


def test_packing(docs):
    rows = packing.packed(docs).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert len([r for r in rows if r.start == 0]) == len(ROWS)
    assert next(r for r in rows if r.doc_id == 1).ids_crc32 == zlib.crc32(b"\0\0\0\0")


def test_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cache = str(tmp_path / "cache")
    want = sorted((i is None, i or 0, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS)
    for _ in range(2):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.counted(docs, cache).collect())
        assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second call encoded nothing anew


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.learned(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.without_toxic(docs, toxicity.Model(((" short ", 9.0),), 1.0, -1.0)).count() == len(ROWS) - 1


def test_simhash(docs):
    rows = simhash.grouped(docs).collect()
    assert len(rows) == len(ROWS)
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1}
    assert {r.component_id for r in rows if r.doc_id == 7} == {5, 7}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id == 7) == [(7, "other text under the same id")]


@pytest.mark.parametrize("most", [2, 5, 2000])
def test_simhash_large_buckets(spark, most):
    """Buckets above the limit are dealt anew and cut into blocks without losing a link."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4)
    fps = {int(np.int64(b) ^ np.int64(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)))) for b in base for _ in range(60)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in components.components(simhash.links(df, most=most)).collect()}
    mask = (1 << 64) - 1
    ids = sorted(fps)
    want = brute.components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ((a ^ b) & mask).bit_count() <= 3])
    assert {f: got.get(f, f) for f in ids} == want


def test_substrings(docs):
    rows = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.measured(docs).collect() if r.doc_id is not None)
    by = {}
    for i, n, gone in rows:
        by.setdefault(i, []).append((n, gone))
    assert by[4] == [(20_000, 0)] and by[5] == [(62, 0)] and by[6] == [(64, 60)] and sorted(by[7]) == [(6, 0), (62, 62), (62, 62)]
    assert by[1] == by[2] == by[3] == [(0, 0)]
    cut = substrings.removed(docs)
    assert cut.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert (6, "three four and more") in texts and (5, f"one {PASSAGE} two") in texts and (1, None) in texts
    assert not any(i == 7 and PASSAGE in (t or "") for i, t in texts)


@pytest.mark.parametrize("shape", [substrings.Shape(window=6, gram=3, long_gram=5, hot=2, chunk=40), substrings.Shape(window=4, gram=4, long_gram=4, hot=1, chunk=7), substrings.Shape(window=6, gram=3, long_gram=5, hot=2, crowd=1, chunk=40), substrings.Shape(window=5, gram=2, long_gram=3, hot=4, crowd=8, chunk=7)])
def test_substrings_against_brute_force(spark, shape):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(list("abcd"), rng.integers(0, 30)))) for i in range(120)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.measured(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shape).collect()}
    assert got == brute.substrings(rows, shape.window)


def test_mixing(docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=200)
    out = mixing.resampled(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {i for i, *_ in ROWS}


def test_highest_quotients(spark):
    wishes = {"a": 1000.4, "b": 3.2, "c": 3.2, "d": 0.0, "e": 57.7, "f": 0.4}
    for total in (0, 1, 7, 100, 531):
        df = spark.createDataFrame(list(wishes.items()), "s string, w double")
        from pyspark.sql import functions as F

        got = {r.s: r.seats for r in mixing.seats(df, [], ["s"], "w", F.lit(total)).collect()}
        want = dict.fromkeys(wishes, 0)
        for _ in range(total):
            best = max(wishes, key=lambda k: (wishes[k] / (2 * want[k] + 1), [-ord(c) for c in k]))
            want[best] += 1
        assert got == want


def test_licences(docs):
    assert licences.scanned(docs).count() == len(ROWS)


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, []), (8, [1.0, None]), (9, [1e300, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, n_links string, kept string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.deduplicated(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (3, 1), 10: (0, 10), 11: (0, 11), 12: (0, 12)}


def test_embeddings_many_cells_and_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base + 0.12 * rng.normal(size=base.shape) for _ in range(12)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.vectors(rows)
    full = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.deduplicated(df, embeddings.Cells(block=37)).collect()}
    assert full == want
    cells = embeddings.deduplicated(df, embeddings.Cells(target=60, block=50)).collect()
    assert all(r.n_links <= want[r.vec_id][0] for r in cells)
    assert sum(r.n_links for r in cells) >= 0.9 * sum(n for n, _ in want.values())


def test_karmarkar_karp():
    owner, sums = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sums.tolist()) == [14, 16] and len(owner) == 5
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 257, rng.integers(1, 200)).tolist()
        owner, k = packing.windows_of(sizes, 1024)
        total = np.bincount(owner, sizes, k)
        assert total.max() <= 1024 and k <= -(-sum(sizes) // 1024) + 1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="ab'sé1 ́<|>!", max_size=40))
def test_counter_is_the_library(a, b):
    count = _counter()
    for t in (a, b, a + b):
        assert count(t) == count.library(t)


def _counter(kept=[]):  # noqa: B006
    if not kept:
        kept.append(tokens.Counter(public_tokenizers.path("word_bpe_49k.json")))
    return kept[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_rolling(w):
    x = textkernel.WordHasher()(w)
    for width in (1, 3, 5):
        r = textkernel.rolling(x, width)
        seen = {}
        for k, h in enumerate(r.tolist()):
            assert seen.setdefault(tuple(w[k : k + width]), h) == h
        assert len(set(r.tolist())) == len({tuple(w[k : k + width]) for k in range(len(r))})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, sf, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    assert out.count() > 0
    if name != "packing":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for f in (quality.judged, packing.packed, simhash.grouped, substrings.measured, mixing.mixed, licences.scanned):
        assert f(none).count() == 0
    assert embeddings.deduplicated(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.parsed(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0


def test_embeddings_at_the_limit(spark):
    """Pairs just at, below and above 0.95, as floats and as doubles, and repeated vectors without an id."""
    at = [(1, [1.0, 0.0]), (2, [0.95, float(np.sqrt(1 - 0.95**2))]), (3, [0.9499999, float(np.sqrt(1 - 0.9499999**2))]), (4, [0.95, -float(np.sqrt(1 - 0.95**2))]), (5, [19.0, float(np.sqrt(39.0))]), (6, [19.0, float(np.sqrt(39.0))])]
    for kind in ("double", "float"):
        df = spark.createDataFrame(at, f"vec_id long, embedding array<{kind}>")
        want = brute.vectors([(r.vec_id, r.embedding) for r in df.collect()])
        assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.deduplicated(df).collect()} == want
    twice = spark.createDataFrame([(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in embeddings.deduplicated(twice).select("n_links", "component_id").collect()] == [(2, 7)] * 3


def test_nearest_cells():
    rng = np.random.default_rng(8)
    c, x = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(50, 6)), rng.normal(size=(300, 6))))
    got = embeddings.nearest_cells(x, c, 5, 0.2)
    for s, cells in zip(x @ c.T, got, strict=True):
        best = np.argsort(-s)[:5]
        assert cells == sorted(k for k in best if s[k] >= s.max() - 0.2)


def test_many_small_pieces():
    sizes = [1] * 4096
    owner, k = packing.windows_of(sizes, 1024)
    assert k == 4 and np.bincount(owner).tolist() == [1024] * 4


def test_pack_ids_are_the_library(spark):
    from tokenizers import Tokenizer

    ids, tok = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(12)
    letters = [*"abcdeE .,!?0123456789", "\n", "\t", "  ", "é", "ß", "漢", "😀", "<", "|", ">", "'s"]
    for _ in range(2000):
        t = "".join(rng.choice(letters, rng.integers(0, 60)))
        assert ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_very_long_texts(spark):
    """Texts of hundreds of thousands of words go whole through every text operator."""
    long = " ".join(f"w{k % 7919}z{k % 13}" for k in range(250_000))
    docs = spark.createDataFrame([(1, long, "s"), (2, long + " tail", "s"), (3, "short", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_words for r in quality.judged(docs).collect()} == {1: 250_000, 2: 250_001, 3: 1}
    assert {r.doc_id: r.n_removed for r in substrings.measured(docs).collect()} == {1: 0, 2: 250_000, 3: 0}
    assert {r.doc_id: r.component_id for r in simhash.grouped(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sum(r.length for r in packing.packed(docs).where("doc_id = 1").collect()) == packing.packed(docs).where("doc_id = 1").first().doc_tokens
    assert {r.doc_id: r["size"] for r in mixing.mixed(docs).collect()} == {1: 250_000, 2: 250_001, 3: 1}


def test_tokens_of_empty_tables_and_other_tokenizers(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    assert tokens.counted(docs.limit(0), str(tmp_path / "none")).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    text = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, " a b\\n"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.counted(text, str(tmp_path / "bytes"), path).collect()}
    assert got == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in text.collect()}
    model = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r.n_tokens for r in tokens.counted(text, str(tmp_path / "pieces"), model).collect()}
    assert got == {r.doc_id: len(piece.encode(r.text or "")) for r in text.collect()}


def test_token_cache_that_knows_most(spark, tmp_path):
    """New texts among cached ones, old ones among new, and repeated ones, with one row for each digest."""
    cache = str(tmp_path / "cache")
    row = lambda k: (k, f"text number {k % 40} of some words")
    first, more = (spark.createDataFrame([row(k) for k in ks], "doc_id long, text string") for ks in (range(30), range(90)))
    for df, n in ((first, 30), (more, 40), (more, 40)):
        got = {r.doc_id: r.n_tokens for r in tokens.counted(df, cache).collect()}
        assert got == {r.doc_id: _counter().library(r.text) for r in df.collect()}
        assert spark.read.parquet(cache).count() == n


def test_taken_against_a_plain_mix(spark):
    """Who gets how many words, dealt seat by seat and document by document."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 90))), str(rng.choice(["a", "b", "c", "d"]))) for k in range(400)]
    mix = mixing.Mix(block=16, shard_docs=40)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, per_source, _ = mixing._placed(df, mix)
    got = placed.collect()
    sizes = {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in "abcd"}
    want = brute.targets(sizes)
    quota = brute.sainte_lague(want, round(sum(want.values()) / 16))
    for s in "abcd":
        mine = [r for r in got if r.source == s]
        words = {}
        for r in mine:
            words[r.shard] = words.get(r.shard, 0) + r["size"]
        shard_quota = brute.sainte_lague(dict(sorted(words.items())), quota[s])
        for shard, seats in shard_quota.items():
            left, taken = seats * 16, {}
            for _ in range(2):
                for r in sorted((r for r in mine if r.shard == shard), key=lambda r: (r.pick, r.doc_id)):
                    step = min(left, r["size"])
                    taken[r.doc_id] = taken.get(r.doc_id, 0) + step
                    left -= step
            assert {r.doc_id: r.taken for r in mine if r.shard == shard} == taken
    copies = {r.doc_id: r["count"] for r in mixing.resampled(df, mix).groupBy("doc_id").count().collect()}
    half_up = lambda x: int(np.floor(x + 0.5))
    assert copies == {r.doc_id: n for r in got if r["size"] and (n := half_up(r.taken / r["size"]))}


def test_copies_of_repeated_rows(spark):
    """Equal rows on both sides of a shard's fall are told apart by counting, so the mix is not exceeded."""
    rows = [(1, "a b c d", "s")] * 10 + [(2, "x", "t")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(block=4)
    want = sum(int(np.floor(r.taken / r["size"] + 0.5)) for r in mixing.mixed(df, mix).collect())
    assert mixing.resampled(df, mix).count() == want
