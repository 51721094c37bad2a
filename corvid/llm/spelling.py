"""Spelling variant grouping by pairless wildcard groups.

Two words are near if one inserted, deleted or replaced code point makes one of the other.  A word with one place
masked names a group: position, prefix and suffix are the same for all its members, any two of which differ by that
place alone.  As the place holds one letter of the alphabet, a group has no more members than the alphabet has letters
(``LETTERS``), whatever the size of the vocabulary.  Each group keeps its size and its top two words; a member's best
partner is the first, or the second for the first itself.  For inserted and deleted code points each word's distinct
deletions are joined with the vocabulary, at most as many rows as the word is long.  Both kinds add up to a number and a
best partner for each word, and no pair of a group is written out.

A word's form is its near word of most occurrences (ties: the least), if it has ten times the word's own at least.
Forms make trees, as occurrences grow along them; roots come by pointer doubling, whose rounds follow from the largest
number of occurrences.

Defined cases: a null or empty text has no runs; a null doc_id is written as empty text in the digest that decides on
the deletion; repeated rows count each; a text of any length is read whole, and a task adds up its words before they are
shuffled; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvid.llm.arrow import light, small
from corvid.llm.scratch import saved

LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
LETTERS = 26 + 64
#: One byte is one code point: characters beyond U+00FF become a question mark, which no run holds.
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def runs_of(text: str | None) -> list[bytes]:
    """The maximal runs of a text that have ``LEAST_LENGTH`` code points or more, A-Z lowered, in Latin-1; a shorter one never makes a word."""
    return RUN.findall((text or "").encode("latin-1", "replace").translate(LOWER))


def respelled(run: bytes, prefix_crc: int, every: int = EVERY) -> bytes:
    """The run, without one code point where the digest of document and run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix_crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def tallied(docs: DataFrame, every: int = EVERY, most: int = 200_000) -> DataFrame:
    """(word, n) of each task's words, added up to ``most`` distinct ones at a time; a word can have several rows."""

    def rows(tally: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in tally], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(tally.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for b in small(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs_of(text)).items():
                    word = respelled(word, start, every)
                    if len(word) >= LEAST_LENGTH:
                        tally[word] += n
                if len(tally) > most:
                    yield rows(tally)
                    tally.clear()
        if tally:
            yield rows(tally)

    light(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word, n): the words of ``LEAST_COUNT`` occurrences or more."""
    return tallied(docs, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _rank(n: str, word: str):
    """Sorts by occurrences, most first, then by code points."""
    return F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))


def _replaced(words: DataFrame) -> DataFrame:
    """(word, near, best): by wildcard groups, for each member how many others its group has and the best of them."""
    place = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    masked = words.select("word", "n", place).select(F.expr("overlay(word placing '*' from at for 1)").alias("mask"), _rank("n", "word").alias("one"))
    group = masked.groupBy("mask").agg(F.array_sort(F.collect_list("one")).alias("members")).where(F.size("members") > 1)
    top = group.select(F.size("members").cast("long").alias("size"), F.col("members")[0].alias("first"), F.col("members")[1].alias("second"), F.explode("members").alias("one"))
    best = F.when(F.col("one.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first"))
    return top.select(F.col("one.word").alias("word"), (F.col("size") - 1).alias("near"), best.alias("best"))


def _shortened(words: DataFrame) -> DataFrame:
    """(word, near, best): for both words of each deletion that the vocabulary has."""
    cut = F.expr("array_distinct(transform(sequence(1, length(word)), i -> overlay(word placing '' from i for 1)))")
    longer = words.where(F.length("word") > LEAST_LENGTH).select(F.col("word").alias("longer"), F.col("n").alias("n_longer"), F.explode(cut).alias("word"))
    both = longer.join(words, "word")
    sides = F.explode(F.array(
        F.struct(F.col("word"), _rank("n_longer", "longer").alias("best")),
        F.struct(F.col("longer").alias("word"), _rank("n", "word").alias("best")),
    )).alias("side")
    return both.select(sides).select("side.word", F.lit(1).cast("long").alias("near"), "side.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form, form_n).  A chain's occurrences grow ``TIMES``-fold a link, so the largest number bounds its length."""
    now = saved(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    most = forms.agg(F.max("form_n")).first()[0] or 0
    links = math.floor(math.log(max(most, 1) / LEAST_COUNT, TIMES)) + 1 if most else 0
    for _ in range(max(0, math.ceil(math.log2(links))) if links else 0):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        now = saved(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "spelling-roots")
    return now


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n), whose words are distinct."""
    words = saved(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    near = _replaced(words).unionByName(_shortened(words)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = F.when(-F.col("best.minus") >= TIMES * F.col("n"), F.col("best"))
    one = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best.alias("best"))
    one = saved(one.select("word", F.col("best.word").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n")), "spelling-near")
    roots = _roots(one.where("form is not null").select("word", "form", "form_n"))
    return one.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: DuckDB has no crc32: the table of its 256 steps is made by the usual polynomial and folded over a run's UTF-8 bytes.
SQL = """
with recursive step(i, v, k) as (
  select i, cast(i as ubigint), 0 from range(256) r(i)
  union all
  select i, case when v & 1 = 1 then xor(v >> 1, cast(3988292384 as ubigint)) else v >> 1 end, k + 1 from step where k < 8),
steps as (select list(v order by i) t from step where k = 8),
run as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w
  from documents),
per as (select coalesce(cast(doc_id as varchar), '') || ':' s, w, count(*) c from run group by all),
bytes as (
  select w, c, flatten(list_transform(string_split(s || w, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end)) b
  from per),
digest as (
  select w, c, xor(cast(4294967295 as ubigint), list_reduce(list_prepend(cast(4294967295 as ubigint), list_transform(b, lambda x: cast(x as ubigint))),
    lambda a, x: xor(t[cast(1 + (xor(a, x) & 255) as bigint)], a >> 8))) h
  from bytes, steps),
spelt as (
  select case when h % 31 = 0 then substr(w, 1, cast(h % length(w) as bigint)) || substr(w, cast(h % length(w) as bigint) + 2) else w end word, c from digest),
vocab as (select word, cast(sum(c) as bigint) n from spelt where length(word) >= 7 group by word having sum(c) >= 2),
mask as (select word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) m from (select word, n, unnest(range(1, length(word) + 1)) i from vocab)),
cut as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) m from (select word, n, unnest(range(1, length(word) + 1)) i from vocab)),
pair as (
  select a.word u, b.word v, b.n from mask a join mask b on a.m = b.m and a.word <> b.word
  union all select c.word, v.word, v.n from cut c join vocab v on c.m = v.word
  union all select v.word, c.word, c.n from cut c join vocab v on c.m = v.word),
best as (select u, count(*) n_near, max(n) most from pair group by u),
first as (select p.u, min(p.v) v from pair p join best b on p.u = b.u and p.n = b.most group by p.u),
formed as (
  select vocab.word, vocab.n, coalesce(n_near, 0) n_near, case when most >= 10 * vocab.n then v end form, case when most >= 10 * vocab.n then most end form_n
  from vocab left join best on best.u = vocab.word left join first on first.u = vocab.word),
walk(word, top, form) as (
  select word, word, form from formed union all select w.word, w.form, f.form from walk w join formed f on f.word = w.form)
select f.word, f.form, w.top root, f.n, cast(f.n_near as bigint) n_near, cast(f.form_n as bigint) form_n
from formed f join walk w on w.word = f.word and w.form is null"""
