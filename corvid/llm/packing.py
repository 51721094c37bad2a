"""Packing: Karmarkar-Karp multiway differencing.

A document's ids (with the separator) are cut into full sequences and a rest; rests are cut into pieces and
gathered into batches.  Within a batch every piece starts as a partition of k windows with one of them filled;
the two partitions of widest imbalance merge again and again, the fullest windows of one with the emptiest of
the other, until one partition is left, whose windows are nearly equal.  If a window exceeds the capacity, the
window count rises by one and the batch is dealt anew.

A batch never leaves its task, so nothing is shuffled and a task holds one batch of piece lengths at a time.

Defined cases: a null or empty text is the separator alone; repeated rows, and rows without doc_id, are packed each;
a text of any length is cut into full sequences as it comes and leaves one rest; pieces of one size go by their
order; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from corvid.llm.arrow import light, small


@dataclass(frozen=True)
class Plan:
    capacity: int = 1024
    piece: int = 256  # rests are cut to this, so that a window holds several pieces
    windows: int = 128  # windows in a batch
    pieces: int = 4096  # pieces in a batch, at most, so that its tables (pieces x windows) stay below 10 MB
    separator: int = 0


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each size, window sums) of a k-way Karmarkar-Karp partition; ties go by position."""
    n = len(sizes)
    left, right = np.zeros(n * k + n + 1, np.int64), np.zeros(n * k + n + 1, np.int64)  # node 0 is empty, nodes 1..n the sizes
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[-1], nodes[-1] = s, i + 1
        state[i] = sums, nodes
        heap.append((-s, i))
    heapq.heapify(heap)
    free, label = n + 1, n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = state.pop(a), state.pop(b)
        sums, x, y = sa + sb[::-1], na, nb[::-1]  # both rise, so the fullest meets the emptiest
        both = (x > 0) & (y > 0)
        nodes = np.where(y > 0, y, x)
        m = int(both.sum())
        left[free : free + m], right[free : free + m] = x[both], y[both]
        nodes[both] = np.arange(free, free + m)
        free += m
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        state[label] = sums, nodes
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), label))
        label += 1
    sums, nodes = state[heap[0][1]]
    owner = np.full(free, -1, np.int64)
    owner[nodes[nodes > 0]] = np.flatnonzero(nodes > 0)
    for node in range(free - 1, n, -1):
        owner[left[node]] = owner[right[node]] = owner[node]
    return owner[1 : n + 1], sums


def windows_of(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Window of each size and the number of windows, none above the capacity.  Sizes are at most the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        owner, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return owner, k
        k += 1


class Ids:
    """Token ids of whole texts as the tokenizers library gives them.  The same vocabulary as ranks is quicker; a text with a special string goes to the library itself."""

    def __init__(self, json_path: str, rank_path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)

    def __call__(self, text: str) -> np.ndarray:
        if "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{x} long" for x in NAMES)


def packed(docs: DataFrame, plan: Plan = Plan(), json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text): where it starts in its document and where it lies in its sequence.

    Sequence ids are unique over the table: the task's partition above the count within it.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, cap = Ids(json_path, rank_path), plan.capacity
        following = TaskContext.get().partitionId() << 36
        done: list[tuple] = []
        rest: list[tuple] = []
        waiting = 0

        def deal() -> None:
            nonlocal following, waiting
            owner, k = windows_of([x[2] for x in rest], cap)
            at = [0] * k
            for x, w in zip(rest, owner.tolist(), strict=True):
                done.append((*x, following + w, at[w]))
                at[w] += x[2]
            following += k
            rest.clear()
            waiting = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

        for b in small(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(ids_of(text or ""), np.uint32(plan.separator)).astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    full = n - start >= cap
                    if full:
                        length = cap
                    else:  # the rest in even pieces
                        parts = -(-(n - start) // plan.piece)
                        length = -(-(n - start) // parts)
                    piece = (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n)
                    if full:
                        done.append((*piece, following, 0))
                        following += 1
                    else:
                        rest.append(piece)
                        waiting += length
                        if waiting >= plan.windows * cap - plan.piece or len(rest) >= plan.pieces:
                            deal()
                    start += length
                if len(done) > 20_000:
                    yield out()
        if rest:
            deal()
        if done:
            yield out()

    light(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
