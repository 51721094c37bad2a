"""Exact nearest-neighbour search over embedded chunks, for one query or many."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corvid.functions.text import snippet
from corvid.functions.vectors import Asked, cosine_to

RESULT = ("id", "product", "title", "section", "source_url", "chunk_index", "content", "version", "score")
TIES = ("source_url", "chunk_index")
# Queries that a unit of a grid may hold and rows that it may stream, and the parts of rows that are enough for all tasks.
HELD, STREAMED, PARTS = 2048, 1 << 17, 32


def nearest(rows: DataFrame, query: Sequence[float], limit: int = 10, product: str | None = None, min_score: float | None = None, ties: Sequence[str] = TIES, product_col: str = "product", vector_col: str = "embedding") -> DataFrame:
    """The ``limit`` rows most similar to ``query``, best first; ``min_score`` is applied to those, as a limit comes before it.

    Rows without a vector, or with one that has no direction, have no score and are left out.
    """
    out = rows.where(F.col(vector_col).isNotNull())
    if product is not None:
        out = out.where(F.col(product_col) == product)
    score = cosine_to(query)
    out = out.withColumn("score", score(F.col(vector_col))).drop(vector_col).where(F.col("score").isNotNull()).orderBy(F.desc("score"), *ties).limit(limit)
    return out.where(F.col("score") >= min_score) if min_score else out


def _ranked(found: DataFrame, limit: int, key: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= limit)


def segments(b: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a batch in which ``columns`` (whole numbers) stay equal."""
    values = [b.column(b.schema.get_field_index(c)).to_numpy() for c in columns]
    new = np.zeros(b.num_rows, bool)
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
    for at, end in zip(edges, edges[1:], strict=False):
        if end > at:
            yield tuple(int(v[at]) for v in values), b.slice(at, end - at)


def dealt(asked: DataFrame, rows: DataFrame, limit: int, key: str) -> DataFrame:
    """(query, key, score): in each unit the best of its rows for each of its queries.

    ``asked`` (unit, id, v) and ``rows`` (unit, id, v) are dealt by their unit in one shuffle; a task holds a unit's
    queries and streams its rows past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, now = None, [], None
        for b in batches:
            for (u, side), piece in segments(b, "unit", "side"):
                if u != unit:
                    if now is not None:
                        yield now.found(["query", key, "score"])
                    unit, parts, now = u, [], None
                if side == 0:
                    parts.append(piece)
                    continue
                if now is None:
                    t = pa.Table.from_batches(parts or [piece.slice(0, 0)])
                    now = Asked(t.column("id").to_numpy(), t.column("v").combine_chunks(), limit)
                now.meet(piece.column(2).to_numpy(), piece.column(3))
        if now is not None:
            yield now.found(["query", key, "score"])

    sides = asked.select("unit", F.lit(0).alias("side"), "id", "v").unionByName(rows.select("unit", F.lit(1).alias("side"), "id", "v"))
    return sides.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, f"query long, {key} long, score double")


def told(rows: DataFrame, asked: pa.Table, limit: int, key: str, asking: dict | None = None) -> DataFrame:
    """(query, key, score): in each task the best of its rows (id, v, and cell if ``asking``) for each query of ``asked`` (id, v), which goes out with the function."""
    ids, vectors = asked.column(0).to_numpy(), asked.column(1).combine_chunks()
    vectors = vectors if isinstance(vectors, pa.Array) else pa.concat_arrays(vectors.chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Asked(ids, vectors, limit)
        for b in batches:
            if b.num_rows:
                now.meet(b.column(0).to_numpy(), b.column(1), None if asking is None else b.column(2).to_numpy(), asking)
        yield now.found(["query", key, "score"])

    return rows.mapInArrow(run, f"query long, {key} long, score double")


def usable(rows: DataFrame, key: str, vector_col: str, *more: str) -> DataFrame:
    """(id, v) of the rows that have both."""
    out = rows.where(F.col(key).isNotNull() & F.col(vector_col).isNotNull())
    return out.select(F.col(key).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *more)


def grid(queries: int, rows: int, block: int, part: int) -> tuple[int, int]:
    """(blocks of queries, parts of rows); see ``nearest_each``."""
    blocks, parts = -(-queries // block), -(-rows // part) or 1
    return min(blocks, max(2, -(-queries // HELD))), min(parts, max(PARTS, -(-rows // STREAMED)))


def nearest_each(rows: DataFrame, queries: DataFrame, limit: int = 10, key: str = "vec_id", vector_col: str = "embedding", block: int = HELD, part: int = STREAMED) -> DataFrame:
    """(query, key, score, rank): the best rows of each row of ``queries``, which has the same two columns.

    Up to ``block`` queries, a number that is looked at, go out with the function; each task keeps its best of every
    query, so tasks x queries x limit rows are shuffled, however many rows there are.  More queries make a grid: blocks
    of queries x parts of rows, in one shuffle, in which a row goes to each block and a query to each part, and a unit of
    the grid holds ``block`` queries while its rows stream past.  As each further block copies all rows, there are no more
    than two unless ``HELD`` queries a block ask for more, nor more than ``PARTS`` parts unless ``STREAMED`` rows do.  No query passes through the driver then.  Queries and rows
    without direction are paired with none, and rows meet only queries of their length, whatever lengths there are.
    """
    asked, every = usable(queries, key, vector_col), usable(rows, key, vector_col)
    n = asked.count()
    if n <= block:
        return _ranked(told(every, asked.limit(block).toArrow(), limit, key), limit, key)
    blocks, parts = grid(n, every.count(), block, part)
    at = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", at(blocks, 1).alias("block"), each(parts).alias("part"))
    right = every.select("id", "v", at(parts, 2).alias("part"), each(blocks).alias("block"))
    unit = (F.col("block") * F.lit(parts) + F.col("part")).cast("long").alias("unit")
    return _ranked(dealt(left.select(unit, "id", "v"), right.select(unit, "id", "v"), limit, key), limit, key)


def results(found: DataFrame) -> DataFrame:
    """What a search shows of a row: title, snippet, address, product, section and rounded score."""
    return found.select("title", snippet(F.col("content")).alias("snippet"), "source_url", "product", "section", F.round("score", 4).alias("score"))


class Cache:
    """Results by key, least recently used out first, none older than ``seconds``; a hit does not lengthen a life."""

    def __init__(self, entries: int = 200, seconds: float = 3600, clock=time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.kept: OrderedDict = OrderedDict()

    def get(self, key):
        found = self.kept.get(key)
        if found is None:
            return None
        if self.clock() > found[1]:
            del self.kept[key]
            return None
        self.kept.move_to_end(key)
        return found[0]

    def set(self, key, value) -> None:
        if key not in self.kept and len(self.kept) >= self.entries:
            self.kept.popitem(last=False)
        self.kept[key] = (value, self.clock() + self.seconds)
        self.kept.move_to_end(key)

    def clear(self) -> None:
        self.kept.clear()
