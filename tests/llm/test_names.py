"""Columns of any names: what operators call things inside must neither break nor change a table's own columns."""

import brute
import pytest
from corvid.llm import chat, mixing, nearcopies, simhash, substrings, tokens, toxicity
from pyspark.sql import functions as F

PASSAGE = " ".join(f"p{k}" for k in range(60))
ROWS = [
    (1, f"one {PASSAGE} two", "a"),
    (2, f"three {PASSAGE} four and more", "a"),
    (3, "a text of its own with some more words in it", "b"),
    (4, "a text of its own with some more words in it", None),
    (5, None, "b"),
    (5, "", "c"),
]
INSIDE = (
    "__key __row __spans __doc __of __k __source __copy __copies __shard __shards __gone __gone_id __gone_hash __given __size __pick __docs __s __h __n __high __low __fall __above "
    "given given_0 row doc first last text_hash node head key unit part c n m low fp keys shared blocks cluster u v copies pick shard times fall above high"
).split()
OPERATORS = {
    "removed": lambda d: substrings.removed(d),
    "resampled": lambda d: mixing.resampled(d),
    "simhash": lambda d: simhash.one_of_each(d),
    "near copies": lambda d: nearcopies.one_of_each(d),
    "toxicity": lambda d: toxicity.without_toxic(d, toxicity.Model(((" idiot ", 3.0),))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_the_operators_names_are_kept(spark, name):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    marked = plain.select("*", *[F.concat(F.lit(f"{x}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(x) for x in INSIDE])
    told = lambda rows: sorted((str(r.doc_id), str(r.text), str(r.source)) for r in rows)
    out = OPERATORS[name](marked)
    assert out.columns == marked.columns
    got = out.collect()
    assert told(got) == told(OPERATORS[name](plain).collect()) and got
    assert all(r[x] == f"{x}-{r.doc_id}" for r in got for x in INSIDE)


def test_chat_and_tokens_ignore_other_columns(spark, tmp_path):
    turns = [(1, 0, "user: how are you\nassistant: fine, thanks"), (1, 1, "user: good\nassistant: yes"), (2, 0, None)]
    plain = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    extra = plain.select("*", *[F.lit(f"x{x}").alias(x) for x in ("role", "line", "tie", "copy", "lines", "block", "at", "n_lines", "rendered", "__key")])
    assert sorted(map(str, chat.parsed(extra).collect())) == sorted(map(str, chat.parsed(plain).collect()))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    more = docs.select("*", *[F.lit(-1).alias(x) for x in ("digest", "n_tokens", "n_bytes", "content", "cached", "tokenizer", "n", "__key")])
    assert sorted(map(str, tokens.counted(more, str(tmp_path / "a")).collect())) == sorted(map(str, tokens.counted(docs, str(tmp_path / "b")).collect()))


def test_very_long_texts(spark, tmp_path):
    """Millions of characters through token counts and near copies."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    long = " ".join(f"w{k % 991}x{k % 77}" for k in range(300_000))
    rows = [(1, long), (2, long + " and one more"), (3, "short text that is not like it at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in tokens.counted(docs, str(tmp_path / "c")).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect()) == [1, 3]
    assert brute.words(long)[:1] == ["w0x0"]
