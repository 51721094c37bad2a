"""The pipeline's near-dedup stage against exact Jaccard similarity of five-word shingles, pair by pair."""

import random

import brute
import pytest
import corpus_pipeline
from corvid.llm import nearcopies


def _set(t):
    w = t.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies_stage(spark, sf):
    r = random.Random(3)
    base = [[f"w{r.randrange(5000)}" for _ in range(n)] for n in (40, 90, 200, 400, 900) for _ in range(12)]
    texts = []
    for w in base:
        texts.append(" ".join(w))
        for edits in (1, 2, 3):  # shares of one word in 200 to one in 60, so similarities on both sides of 0.8
            v = list(w)
            for _ in range(max(1, edits * len(w) // 200)):
                v[r.randrange(len(v))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(v))
    sets = dict(enumerate(map(_set, texts)))
    pairs = [(i, j) for i in sets for j in range(i + 1, len(texts)) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    group = brute.components(list(sets), pairs)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf).collect()}
    assert kept == {i for i in sets if group[i] == i} and 60 <= len(kept) < 200


def _plain_groups(texts):
    sets = dict(enumerate(map(_set, texts)))
    pairs = [(i, j) for i in sets for j in range(i + 1, len(texts)) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    return brute.components(list(sets), pairs)


def _variants(n, words, edits, seed):
    """Texts that differ from one in some words each, so that pairs are alike on both sides of 0.8."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**5)}" for _ in range(words)]
    out = []
    for _ in range(n):
        v = list(base)
        for k in r.sample(range(words), r.choice(edits)):
            v[k] = f"x{r.randrange(10**6)}"
        out.append(" ".join(v))
    return out


@pytest.mark.parametrize("sizes", [{}, {"most": 20, "shingles": 3000, "whole": 1}, {"most": 30, "shingles": 3000, "whole": 10**6}])
def test_groups_however_blocks_are_cut(spark, sizes, monkeypatch):
    texts = _variants(120, 100, (1, 2, 3, 4), 1) + _variants(60, 200, (2, 3, 4), 2) + ["some words of their own that nobody else has at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = nearcopies.links
    monkeypatch.setattr(nearcopies, "links", lambda d, of: plain(d, of, **sizes))
    want = _plain_groups(texts)
    assert {r.doc_id: r.component_id for r in nearcopies.grouped(docs).collect()} == want
    assert 10 < len(set(want.values())) < 150


def test_rows_grow_with_the_texts(spark, monkeypatch):
    """Texts that are alike below 0.8: twice as many make twice the rows in every table, not four times."""
    told = []
    plain = nearcopies.saved

    def counted(df, name):
        out = plain(df, name)
        told[-1][name] = told[-1].get(name, 0) + out.count()
        return out

    monkeypatch.setattr(nearcopies, "saved", counted)
    for n in (150, 300):
        told.append({})
        texts = _variants(n, 400, (6, 7), 3)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert nearcopies.grouped(docs).groupBy("component_id").count().count() == len(set(_plain_groups(texts).values()))
    assert told[0]["near-clustered"] > 150  # the case is met
    for name, rows in told[1].items():
        assert rows <= 3 * told[0].get(name, 0) + 50, (name, rows, told[0].get(name))
