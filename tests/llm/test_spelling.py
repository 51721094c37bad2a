"""Spelling groups against all pairs, and their defined cases."""

import random

import brute
from corvid.llm import spelling

NAMES = ("form", "root", "n", "n_near", "form_n")


def rows_of(df):
    return {r.word: tuple(r[x] for x in NAMES) for r in df.collect()}


def grouped(spark, rows, schema="doc_id long, text string"):
    return rows_of(spelling.grouped(spelling.vocabulary(spark.createDataFrame(rows, schema))))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(7, 9))) for _ in range(12)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: 1 + rng.randrange(12)])
            k = rng.randrange(len(w))
            w = rng.choice([w] * 8 + [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + rng.choice("aby") + w[k + 1 :], w.upper()])
            words.append(w)
        rows.append((doc, " ".join(words)))
    got = grouped(spark, rows)
    assert got == brute.spelling(rows)
    assert any(v[0] for v in got.values()) and max(v[3] for v in got.values()) > 3


def test_chain_of_forms_and_ties(spark):
    """A form of a form, to its root; of two best words the least one is the form; repeated letters give one deletion."""
    number = {"abcdefgh": 4000, "abcdefg": 300, "abcdefx": 20, "abcdexx": 2, "zabcdefgh": 2, "mmmmmmmm": 30, "mmmmmmm": 2, "aaaaaaab": 50, "aaaaaaac": 50, "aaaaaaad": 5}
    words = spark.createDataFrame(list(number.items()), "word string, n long")
    got = rows_of(spelling.grouped(words))
    assert got["abcdexx"][:2] == ("abcdefx", "abcdefgh") and got["abcdefx"][:2] == ("abcdefg", "abcdefgh")
    assert got["abcdefgh"] == (None, "abcdefgh", 4000, 2, None)
    assert got["mmmmmmm"] == ("mmmmmmmm", "mmmmmmmm", 2, 1, 30)
    assert got["aaaaaaad"] == ("aaaaaaab", "aaaaaaab", 5, 2, 50)
    assert got["aaaaaaab"][3] == 2


def test_defined_cases(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names, letters beyond Latin-1, an empty table."""
    long_text = "Lengthy wordier " * 200_000
    rows = [(None, "Wordier Größere", "a", 1), (1, None, "b", 2), (2, "", "c", 3), (3, long_text, "d", 4), (3, long_text, "d", 4), (4, "größere GRÖSSERE Größere ąąwordier Größere", "e", 5)]
    got = grouped(spark, rows, "doc_id long, text string, word string, n long")
    assert got == brute.spelling([r[:2] for r in rows])
    assert max(v[2] for v in got.values()) >= 400_000 and "größere" in got
    assert grouped(spark, []) == {}


def test_tally_comes_in_parts(spark):
    docs = spark.createDataFrame([(i, f"manyletters{chr(97 + i % 26)} otherletters") for i in range(200)], "doc_id long, text string")
    whole = spelling.tallied(docs).groupBy("word").sum("n").collect()
    parts = spelling.tallied(docs, most=5).groupBy("word").sum("n").collect()
    assert sorted(whole) == sorted(parts)
