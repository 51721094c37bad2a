"""The corpus pipeline: toxicity, near-dedup by five-word shingles, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the
columns of ``docs``, whatever there are.  An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm import mixing, nearcopies, packing, substrings, toxicity
from corvid.llm.scratch import fresh, remove, scoped


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half.

    The lexicon is learned from the labels of ``docs``, never from the held-out fifth.  Null and empty texts score as
    without hits and stay; repeated rows are judged alike; a text of any length is matched whole.
    """
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more, that of the smallest doc_id.

    Candidates come from SimHash fingerprints by the pigeonring filter and from MinHash bands, and an exact check
    decides each.  Null and empty texts are copies of each other; repeated rows of one id and text stay together;
    rows without doc_id stay only where no other has one.
    """
    return nearcopies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that a document of smaller doc_id has too.

    A text that loses every word goes; null and short texts stay as they are; rows of one id, and so ties, cut nothing of
    each other; of equal windows the smallest id keeps its own; repeated rows are cut alike; a text of any length is cut
    whole; n_chars, if it is there, follows the text.
    """
    return substrings.removed(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Texts without words, null ones too, are never taken; a null source is a source, the last; of documents of one place in
    the seeded order, as repeated rows are, as many are taken twice as the quota says; a text of any length counts whole.
    """
    return mixing.resampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.

    A null text is the separator alone; a text of any length is cut into full sequences and a rest; repeated rows, and rows
    without doc_id, are packed each; pieces of one size go by their order.
    """
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned scores, fingerprints and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; a stage's intermediate tables, and its input, go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh(spark, name)
        with scoped(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
