"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

Every window is hashed.  Windows are dealt out by their minimizer, the least mixed hash of the shorter runs of
words inside, so equal windows meet, and a whole stretch of windows with one minimizer travels as one row.
A minimizer that only one document has cannot belong to a repeated window: such stretches stay behind, by a
bitmap of the others.  Where windows meet, one is repeated if a document of smaller id has it too;
repeated windows merge into maximal intervals of words to remove.

Of equal windows within a chunk of a task's rows, all but those of the least id are repeated for certain; they
stay in the task, and only the least goes on.  So a passage that a third of all documents share arrives once a
chunk.  A minimizer of more than ``hot`` documents is joined by that of longer runs of words, which parts the
different surroundings of a common passage.  Stretches that would still meet in a group of more than ``crowd`` are
taken apart: each window's least id is an aggregate, combined before the shuffle, and joined back to the windows.

Defined cases: a null text has no words; a text shorter than a window keeps all its words; rows of one doc_id
never remove each other's words; rows without doc_id count as of the largest id; repeated rows give repeated rows;
a text of any length is taken whole; other columns are ignored by ``measured`` and kept by ``removed``, whatever
their names; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvid.llm.arrow import any_names, light, runs, small
from corvid.llm.bitmap import Bitmap, row_key, suspected
from corvid.llm.scratch import saved
from corvid.llm.textkernel import WORD, WordHasher, covered, mixed, rolling, sliding_min, words

LAST = (1 << 63) - 1
SALTS = 32


@dataclass(frozen=True)
class Shape:
    window: int = 50
    gram: int = 12
    long_gram: int = 40
    hot: int = 200
    crowd: int = 256
    chunk: int = 400_000  # windows judged together in a task


def _minima(x: np.ndarray, gram: int, window: int) -> np.ndarray:
    gram = min(gram, window)
    return sliding_min(mixed(rolling(x, gram)), window - gram + 1).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    light(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), row_key().alias("row"), F.col("text").cast("string").alias("text"))


def _minimizers(docs: DataFrame, s: Shape) -> DataFrame:
    """(m, doc): the distinct minimizers of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in small(batches):
            found = [np.unique(_minima(hasher(words(t)), s.gram, s.window)) for t in b.column(2).to_pylist()]
            if found:
                doc = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(doc)], ["m", "doc"])

    return _keyed(docs).mapInArrow(run, "m long, doc long")


def _repeats(w: np.ndarray, doc: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Which windows also belong to a document of smaller id among those given."""
    order = np.lexsort((doc, w) if key is None else (doc, w, key))
    change = w[order][1:] != w[order][:-1]
    if key is not None:
        change |= key[order][1:] != key[order][:-1]
    first = np.concatenate([[True], change])
    out = np.empty(len(w), bool)
    out[order] = doc[order] > doc[order][first][np.cumsum(first) - 1]
    return out


def _edges(*columns: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every stretch in which all columns stay equal and ``pos`` rises by one."""
    new = pos[1:] != pos[:-1] + 1
    for c in columns:
        new |= c[1:] != c[:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    return first, np.append(first[1:], len(pos)) - 1


_ROWS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("windows", pa.binary())])


def _stretches(docs: DataFrame, s: Shape, shared, hot) -> DataFrame:
    """Stretches of windows that may be repeated, with their hashes as 8-byte integers; without them, stretches known to be repeated."""

    def out(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        w, key, doc, row, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        sure = _repeats(w, doc)
        if sure.any():
            d, r, p = doc[sure], row[sure], pos[sure]
            a, z = _edges(r, d, pos=p)
            yield pa.RecordBatch.from_arrays([pa.array(d[a]), pa.array(d[a]), pa.array(r[a]), pa.array(p[a]), pa.array(p[z]), pa.nulls(len(a), pa.binary())], schema=_ROWS)
        w, key, doc, row, pos = (c[~sure] for c in (w, key, doc, row, pos))
        a, z = _edges(key, row, doc, pos=pos)
        data = w.tobytes()
        for k in range(0, len(a), 20_000):
            i, j = a[k : k + 20_000], z[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(doc[i]), pa.array(row[i]), pa.array(pos[i]), pa.array(pos[j]), pa.array([data[8 * x : 8 * y + 8] for x, y in zip(i.tolist(), j.tolist(), strict=True)], pa.binary())], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, n = WordHasher(), [], 0
        for b in small(batches):
            for doc, row, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = hasher(words(text))
                m = _minima(x, s.gram, s.window)
                pos = np.flatnonzero(shared(m)) if len(m) else m
                if not len(pos):
                    continue
                key = m[pos]
                often = hot(key)
                if often.any():
                    key[often] = mixed((key[often] ^ _minima(x, s.long_gram, s.window)[pos[often]]).view(np.uint64)).view(np.int64)
                parts.append((rolling(x, s.window).view(np.int64)[pos], key, np.full(len(pos), doc), np.full(len(pos), row), pos))
                n += len(pos)
                if n >= s.chunk:
                    yield from out(parts)
                    parts, n = [], 0
        if parts:
            yield from out(parts)

    return _keyed(docs).mapInArrow(run, "key long, doc long, row long, first long, last long, windows binary")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of repeated windows (doc, row, first, last) from stretches sorted by key."""
    for t in runs(batches, "key"):
        data = t.column("windows").to_pylist()
        n = np.fromiter((len(x) // 8 for x in data), np.int64, len(data))
        at = np.repeat(np.arange(len(n)), n)
        key, doc, row, start = (t.column(c).to_numpy() for c in ("key", "doc", "row", "first"))
        pos = start[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(_repeats(np.frombuffer(b"".join(data), np.int64), doc[at], key[at]))
        if len(hit):
            a, z = _edges(at[hit], pos=pos[hit])
            of = at[hit[a]]
            yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(row[of]), pa.array(pos[hit[a]]), pa.array(pos[hit[z]])], ["doc", "row", "first", "last"])


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the stretches as a row of its own."""
    for b in batches:
        data = b.column(4).to_pylist()
        n = np.fromiter((len(x) // 8 for x in data), np.int64, len(data))
        at = np.repeat(np.arange(len(n)), n)
        key, doc, row, start = (b.column(i).to_numpy()[at] for i in range(4))
        pos = start + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(data), np.int64)), *map(pa.array, (key, doc, row, pos))], ["w", "key", "doc", "row", "pos"])


def _crowded(stretches: DataFrame) -> DataFrame:
    """What ``_judge`` finds, for stretches of which very many share a key."""
    one = saved(stretches.select("key", "doc", "row", "first", "windows").mapInArrow(_singles, "w long, key long, doc long, row long, pos long"), "single-windows")
    # a table of its own, so that both sides of the join are plain exchanges and Spark can split a window of very many rows
    low = saved(one.groupBy("w", "key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("w", "key", "low"), "first-documents")
    # a window of very many rows meets its first document in ``SALTS`` tasks
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = one.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int"))
    return one.join(low, ["w", "key", "salt"]).where("doc > low").select("doc", "row", F.col("pos").alias("first"), F.col("pos").alias("last"))


def repeated(docs: DataFrame, s: Shape = Shape()) -> DataFrame:
    """(doc, row, first, last): windows of each row that also start in a document of smaller id."""
    count = _minimizers(docs, s).groupBy("m").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
    shared = saved(count.where("low < high").select("m", "n"), "shared-minimizers")
    many = shared.where(F.col("n") > s.hot)
    stretches = saved(_stretches(docs, s, Bitmap(shared, F.col("m")).tester(), Bitmap(many, F.col("m")).tester()), "stretches")
    sure, left = stretches.where("windows is null").select("doc", "row", "first", "last"), stretches.where("windows is not null")
    crowds = saved(left.groupBy("key").count().where(F.col("count") > s.crowd).select("key"), "crowded-keys")
    if crowds.head(1):  # a key goes one way or the other as a whole, so a bit set by chance does no harm
        bits = Bitmap(crowds, F.col("key"))
        sure = sure.unionByName(_crowded(suspected(left, bits, F.col("key"))))
        left = suspected(left, bits, F.col("key"), False)
    return sure.unionByName(left.repartition("key").sortWithinPartitions("key").mapInArrow(_judge, "doc long, row long, first long, last long"))


def _cleaned(docs: DataFrame, s: Shape, finish, schema) -> DataFrame:
    """``finish(batch, flags)`` over all rows, ``flags(k)`` giving row k's words to remove (None: none); only rows that may lose words are shuffled."""
    spans = saved(repeated(docs, s), "repeated-windows")
    bits = Bitmap(spans, F.col("row"))
    per_row = spans.groupBy(F.col("row").alias("__row"), F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    suspects = suspected(docs, bits, row_key()).withColumn("__key", row_key()).withColumn("__of", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    joined = suspects.join(per_row, (F.col("__key") == F.col("__row")) & (F.col("__of") == F.col("__doc")), "left").drop("__key", "__of", "__row", "__doc")
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            given = b.column(width) if b.num_columns > width else None

            def flags(k: int, n: int) -> np.ndarray | None:
                span = given[k].as_py() if given is not None else None
                if not span:
                    return None
                return covered(np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in span])), s.window, n)

            yield finish(b.select(list(range(width))), flags)

    return suspected(docs, bits, row_key(), False).mapInArrow(run, schema).unionByName(joined.mapInArrow(run, schema))


def measured(docs: DataFrame, s: Shape = Shape()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of ``docs``."""

    def finish(b: pa.RecordBatch, flags) -> pa.RecordBatch:
        rows = []
        for k, text in enumerate(b.column(1).to_pylist()):
            w = words(text)
            f = flags(k, len(w))
            kept = w if f is None else list(compress(w, (~f).tolist()))
            rows.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
        n, gone, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _cleaned(need, s, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@any_names
def removed(docs: DataFrame, s: Shape = Shape()) -> DataFrame:
    """``docs``, all columns, with repeated intervals cut from text (n_chars, if there, follows); a row that loses every word goes.

    A text that loses nothing stays as it is; of another the kept stretches stay as they were, blanks included, one space where a cut was.
    """
    names, schema = docs.columns, docs.schema

    def cut(text: str, k: int, flags) -> str | None:
        """The text without its removed words; None if none is left."""
        ends = [m.span() for m in WORD.finditer(text)]
        f = flags(k, len(ends))
        if f is None:
            return text
        edges = np.flatnonzero(np.diff(np.concatenate([[1], f.astype(np.int8), [1]])))
        return " ".join(text[ends[a][0] : ends[z - 1][1]] for a, z in edges.reshape(-1, 2).tolist()) or None

    def finish(b: pa.RecordBatch, flags) -> pa.RecordBatch:
        texts = b.column(names.index("text")).to_pylist()
        new = [t and cut(t, k, flags) for k, t in enumerate(texts)]
        columns = list(b.columns)
        columns[names.index("text")] = pa.array(new, columns[names.index("text")].type)
        if "n_chars" in names:
            at = names.index("n_chars")
            columns[at] = pa.array([o if n == t else n and len(n) for o, n, t in zip(columns[at].to_pylist(), new, texts, strict=True)], columns[at].type)
        lost = pa.array([bool(t) and n is None for t, n in zip(texts, new, strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays(columns, names).filter(pc.invert(lost))

    return _cleaned(docs, s, finish, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) i from w)),
low as (select h, min(doc_id) d from win group by h),
hit as (select doc_id, list(i) starts from win join low using (h) where doc_id > d group by doc_id),
cov as (select doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) gone from hit),
word as (select w.doc_id, unnest(ws) x, unnest(range(1, len(ws) + 1)) i from w),
flag as (select word.doc_id, x, word.i as i, g.i is not null as gone from word left join (select doc_id, unnest(gone) i from cov) g on g.doc_id = word.doc_id and g.i = word.i),
agg as (select doc_id, count(*) n, count(*) filter (gone) r, coalesce(string_agg(x, ' ' order by i) filter (not gone), '') kept from flag group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(r, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join agg using (doc_id)"""
