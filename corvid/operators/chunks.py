"""Sections to overlapping chunks.

The overlap that a section begins with is the end of the section before it as it was, so a window supplies it,
and sections pack independently of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvid.config import Settings
from corvid.functions.text import SPACE, filled, tail_units, token_estimate, trim, units

LEAST_TOKENS = 20


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, f"(?<=[.!?]){SPACE}+"), lambda s: s.rlike(f"[^{SPACE[1:-1]}]"))


def packed(text: Column, lead: Column, s: Settings) -> Column:
    """An array of chunk texts of one section; ``lead`` is the overlap it begins with, empty for none.

    The fold carries the length of what it holds, so each sentence is measured once and appended once.
    """
    most, overlap, gap = 4 * s.chunk_size, 4 * s.chunk_overlap, int(s.chunk_overlap > 0)
    short = F.array(F.when(lead != "", F.concat(lead, F.lit(" "), text)).otherwise(text))
    state = lambda held, n, done: F.struct(held.alias("held"), n.cast("int").alias("n"), done.alias("done"))

    def step(acc: Column, part: Column) -> Column:
        n = acc["n"] + part["n"] + 1
        again = F.concat(tail_units(acc["held"], overlap), F.lit(" " * gap), part["s"], F.lit(" "))
        cut = state(again, F.least(acc["n"], F.lit(overlap)) + gap + part["n"] + 1, F.array_append(acc["done"], trim(acc["held"])))
        return F.when((n > most) & (acc["n"] > 0), cut).otherwise(state(F.concat(acc["held"], part["s"], F.lit(" ")), n, acc["done"]))

    begun = F.when(lead != "", F.concat(lead, F.lit(" "))).otherwise(F.lit(""))
    start = state(begun, units(begun), F.array().cast("array<string>"))
    parts = F.transform(sentences(text), lambda x: F.struct(x.alias("s"), units(x).alias("n")))
    long = F.aggregate(parts, start, step, lambda acc: F.filter(F.array_append(acc["done"], trim(acc["held"])), lambda x: x != ""))
    return F.when(units(text) <= most, short).otherwise(F.when(F.size(long) > 0, long).otherwise(F.array(text)))


def with_overlap(sections: DataFrame, s: Settings) -> DataFrame:
    """Sections with their trimmed text and the overlap before it; blank sections are left out."""
    rows = sections.withColumn("text", trim(F.col("text"))).where(F.col("text") != "")
    page = W.partitionBy("url").orderBy("pos")
    return rows.withColumn("lead", F.coalesce(F.lag(tail_units(F.col("text"), 4 * s.chunk_overlap)).over(page), F.lit("")))


def chunked(sections: DataFrame, s: Settings = Settings(), *keep: str) -> DataFrame:
    """source_url, ``keep``, title, section, chunk_index, content of every chunk of ``sections`` (url, title, pos, heading, text)."""
    rows = with_overlap(sections, s)
    # the parts have no column of their own, as Spark would pack them twice, once to leave out empty arrays
    parts = F.posexplode(packed(F.col("text"), F.col("lead"), s)).alias("part", "content")
    each = rows.select("url", *keep, "title", filled(F.col("heading"), F.col("title"), F.lit("")).alias("section"), "pos", parts)
    kept = each.where(token_estimate(F.col("content")) >= LEAST_TOKENS)
    index = F.row_number().over(W.partitionBy("url").orderBy("pos", "part")) - 1
    return kept.select(F.col("url").alias("source_url"), *keep, "title", "section", index.cast("int").alias("chunk_index"), trim(F.col("content")).alias("content"))
