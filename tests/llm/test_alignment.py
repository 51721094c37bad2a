"""Token alignment against overlapping byte ranges, and its defined cases."""

import brute
import pytest
from corvid.llm import alignment
from corvid.llm.queries import QUERIES

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return {r.doc_id: tuple(r[x] for x in NAMES) for r in df.collect()}


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_token_alignment"](spark, sf)) == brute.alignment(docs)


@pytest.mark.parametrize("hot", [0, 7, 300])
def test_rare_pairs_meet_their_counts(spark, sf, hot):
    """Whatever is told to all tasks, the answer is the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    want = brute.alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(alignment.scored(docs, hot=hot)) == want


def test_defined_cases(spark):
    """Nulls, empty texts, signs that a tokenizer changes, special strings, other scripts, clashing names, very long texts."""
    texts = [None, "", " ", "  two  blanks ", "a▁b", "<|endoftext|> and <s> </s> <0x41>", "Größe 漢字 🙂 naïve\n\n\tend", "x" * 30_000, "many words here " * 40_000, "line\r\nline\x00 null", "١٢٣ é"]
    rows = [(i, t, 1, b"a", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, a binary, n_links int")
    got, want = rows_of(alignment.scored(docs)), brute.alignment([r[:2] for r in rows])
    assert got == want
    assert got[0] == got[1] == got[4] == (0, 0, 0, 0, 0, 0, "") and got[5][0] > 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(alignment.scored(empty)) == {}


def test_repeated_rows_and_rows_without_id(spark):
    docs = spark.createDataFrame([(1, "the same text"), (1, "the same text"), (None, "the same text")], "doc_id long, text string")
    got = alignment.scored(docs).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1
    assert got[0].count_sum == 3 * got[0].n_links and got[0].n_best == got[0].n_links


def test_counts_in_parts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    paths = [alignment.public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    texts = alignment.saved(alignment.aligned(docs, lambda: alignment.Aligner(*paths)), "t")
    lengths = spark.sparkContext.broadcast(alignment.Aligner(*paths).lengths)
    assert sorted(alignment.counts(texts, lengths).collect()) == sorted(alignment.counts(texts, lengths, most=50).collect())
