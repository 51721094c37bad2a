"""Toxicity: folding, exception phrases, and every score against a plain scorer."""

import brute
import pytest

from corvid.llm import toxicity

SCHEMA = "doc_id long, text string, held_out string, score string, predicted string"


def test_every_lookalike_counts():
    for odd, plain in toxicity.LOOKALIKES.items():
        word = f"xq{plain}zw"
        one = toxicity.Scorer(toxicity.Model(((f" {word.lower()} ", 3.0),)))
        assert one.weight(f"you xq{odd}zw") > 0, odd
    one = toxicity.Scorer(toxicity.Model(((" idiot ", 3.0), (" shit ", 2.0), (" ass ", 2.0))))
    for text in ("іdіоt", "ІDІОТ", "ΙDΙΟΤ", "1d10t", "IDI0T", "@idiot", "idiot!!", "ｉｄｉｏｔ", "id​iot", "$hit", "5hit", "$H!T", "a$$", "A55"):
        assert one.weight(text) > 0, text
    for text in ("", None, "hit", "the cost is $5", "10 dots", "idiotic"):
        assert one.weight(text) == 0, text


def test_exception_phrases():
    one = toxicity.Scorer(toxicity.Model(((" clown ", 3.0), (" poubelle ", 3.0))))
    assert one.weight("a clown fish") == one.weight("le sac poubelle") == one.weight("clown car clown fish") == 0 < one.weight("clown fish clown")


def test_exceptions_are_learned(spark):
    rows = [(1000 + i, f"some clean text about word{i % 7} of a person and you", 0) for i in range(400)]
    rows += [(i, f"word{i % 7} grub pie tastes well word{i % 5}", 0) for i in range(12)] + [(100 + i, f"you grub word{i % 7} of a person", 1) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    assert "grub pie" in model.exceptions
    one = toxicity.Scorer(model)
    assert one.weight("a grub pie") == 0 < one.weight("you grub")


@pytest.mark.parametrize("seed", [0])
def test_scores_against_a_plain_scorer(spark, sf, seed):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learned(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(model.lexicon) > 5
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scored(docs, model).collect():
        want = brute.toxicity(text[r.doc_id], model, toxicity.LOOKALIKES, toxicity.SIGNS)
        assert r.score == pytest.approx(want, abs=1e-12) and r.predicted == int(r.score >= 0.5)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i, t in text.items() if brute.toxicity(t, model, toxicity.LOOKALIKES, toxicity.SIGNS) < 0.5}


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, "idiot", "", "", ""), (None, None, "", "", ""), (3, "word " * 300_000 + "!d10t", "", "", "")], SCHEMA)
    assert toxicity.scored(none, toxicity.learned(none, labels)).count() == 0
    assert toxicity.without_toxic(none, toxicity.learned(none, labels)).count() == 0
    rows = toxicity.scored(some, toxicity.learned(some, labels.limit(0))).collect()
    assert sorted((str(r.doc_id), r.predicted) for r in rows) == [("1", 1), ("3", 0), ("None", 0)]


def test_forms_of_a_word():
    """Compatibility letters, accents, combining marks and spaced letters; and what must not be read so."""
    model = toxicity.Model(((" idiot ", 3.0), (" shit ", 2.0)))
    one = toxicity.Scorer(model)
    hits = ("𝐢𝐝𝐢𝐨𝐭", "ⓘⓓⓘⓞⓣ", "ídiot", "id\u0301iot", "i.d.i.o.t", "i d i o t", "you are a i d i o t", "I-D-I-O-T!", "ＩＤＩＯＴ", "such idiöt", "ｓ_ｈ_ｉ_ｔ")
    clean = ("a b c d e", "U.S.A. plan", "1 2 3 4", "idiotic", "Ö is a letter", "i d", "é è ê", "")
    for text in hits:
        assert one.weight(text) > 0, text
    for text in clean:
        assert one.weight(text) == 0, text
    for text in (*hits, *clean, "a  i d i o t", "i d i o tx", "xi d i o t", "i d i o t s h i t", "ídiot idiot ídiotïc", "i.d.i.o.t. s.h.i.t."):
        assert one(text) == pytest.approx(brute.toxicity(text, model, toxicity.LOOKALIKES, toxicity.SIGNS), abs=1e-12), text


def test_lexicon_against_plain_counts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    s = toxicity.Settings()
    used = labels.where(toxicity.remainder(toxicity.F.col("doc_id")) != 0)
    rows = [(r.text, r.toxic) for r in docs.join(used, "doc_id").where("text is not null").collect()]
    model = toxicity.learned(docs, labels, s)
    assert dict(model.lexicon) == pytest.approx(brute.learned(rows, s, lambda t: toxicity._features(t, s))) and model.bound == ()
    assert "entries" in toxicity.learned(docs, labels, toxicity.Settings(entries=3)).bound
