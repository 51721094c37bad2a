"""Cross-tokenizer alignment by a string of labels, one a byte.

Tokenizer A encodes a space and the text, tokenizer B the text, before which it puts a space itself.  Each byte of that
common string has a label: no token ends with it (0), one of A (1), one of B (2), or one of both (3).  A regular
expression scans the labels for stretches up to each 3; a stretch is a group, and its labels' counts are the numbers of
its tokens.  Every byte with a label ends just one stretch that lies in one token of A and one of B, so the labelled bytes
are the links, with no pairs beyond them.

An id pair's count over the corpus is added up in each task before it is shuffled.  The pairs of most links, of a fixed
number, are then told to all tasks, which judge most links where they lie; links of other pairs are dealt by their pair
and meet their counts in a join.  The best count of each id of B is a table no longer than B's vocabulary.

Defined cases: a null or empty text, and one whose tokens don't give back a space and the text, has no tokens, zeros and
an empty digest; repeated rows, and rows without doc_id, count and answer each; a text of any length is encoded whole;
pairs of equal counts are all best; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvid.llm.arrow import light, small
from corvid.llm.scratch import saved
from corvid.llm.tokens import byte_alphabet

#: A stretch of labels up to and with one where tokens of both end.
STRETCH = re.compile(rb"[^\x03]*\x03")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Pairs that are told to all tasks: 8 bytes of key and 8 of count each.
HOT = 2_000_000


class Aligned(NamedTuple):
    """Numbers of tokens of A and of B and of groups, the groups as ``a1,a2|b1;a3|b2,b3`` in decimal ids, and the ids, four bytes each."""

    n_a: int
    n_b: int
    n_groups: int
    told: str
    a: bytes
    b: bytes


NONE = Aligned(0, 0, 0, "", b"", b"")


def byte_tokens(json_path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; a special token stands for its own UTF-8."""
    spec, letters = json.loads(Path(json_path).read_text()), byte_alphabet()
    out = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
    out |= {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def piece_tokens(model_path: str) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> the byte."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


class Stretches(dict):
    """The numbers of tokens of A and of B in a stretch of labels, as one number; remembered."""

    def __missing__(self, s: bytes) -> int:
        n = self[s] = (s.count(1) + 1) << 32 | (s.count(2) + 1)
        return n


class Aligner:
    """Both tokenizers, and what they make of a text; ``limit`` stretches of labels are remembered."""

    def __init__(self, byte_path: str, rank_path: str, piece_path: str, limit: int = 100_000):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(rank_path).read_bytes().splitlines())}
        self.first = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        tokens = byte_tokens(byte_path), piece_tokens(piece_path)
        self.lengths = tuple(np.array([len(t) for t in x], np.int64) for x in tokens)
        self.starts = tuple(np.cumsum(n) - n for n in self.lengths)
        self.flat = tuple(np.frombuffer(b"".join(x), np.uint8) for x in tokens)
        #: Each id in decimal with each sign that may follow it: B's after A's.
        self.names = [f"{i}{sign}" for x in tokens for i in range(len(x)) for sign in ",|;"]
        self.limit, self.known = limit, Stretches()

    def _gives(self, side: int, ids: np.ndarray, whole: np.ndarray) -> bool:
        """Whether the tokens' bytes are those of ``whole``."""
        n = self.lengths[side][ids]
        if n.sum() != len(whole):
            return False
        at = np.repeat(self.starts[side][ids] - np.cumsum(n) + n, n) + np.arange(len(whole))
        return bool((self.flat[side][at] == whole).all())

    def __call__(self, text: str | None) -> Aligned:
        if not text:
            return NONE
        a = self.first.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        b = np.array(self.second.encode(text), np.int64)
        whole = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), np.uint8)
        if not (self._gives(0, a, whole) and self._gives(1, b, whole)):
            return NONE
        if len(self.known) > self.limit:
            self.known.clear()
        stretches = STRETCH.findall(labelled(a, b, self.lengths).tobytes())
        n = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        return Aligned(len(a), len(b), len(n), self._told(a, b, n >> 32, n & 0xFFFFFFFF), a.astype("<u4").tobytes(), b.astype("<u4").tobytes())

    def _told(self, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> str:
        """Groups of m ids of A and n of B as ``a1,a2|b1;a3|b2,b3``."""
        size = m + n
        end = np.cumsum(size)
        of_a = np.arange(len(a)) + np.repeat(np.cumsum(n) - n, m)  # the places of A's ids: after the groups' ids of B before
        out, sign = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        is_b = np.ones(len(out), bool)
        is_b[of_a] = False
        out[of_a], out[is_b] = a, b + len(self.lengths[0])
        sign[end - n - 1], sign[end - 1] = 1, 2
        return "".join(map(self.names.__getitem__, (3 * out + sign).tolist()))[:-1]


def labelled(a: np.ndarray, b: np.ndarray, lengths: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The label of each byte of the string that both lists of ids stand for."""
    ends = np.cumsum(lengths[0][a]) - 1, np.cumsum(lengths[1][b]) - 1
    labels = np.zeros(int(ends[0][-1]) + 1 if len(a) else 0, np.uint8)
    labels[ends[0]] = 1
    labels[ends[1]] |= 2
    return labels


def linked(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The id pair of each link, as one number: A's id above B's."""
    at = labels[labels > 0]
    i, j = np.cumsum(at & 1) - (at & 1), np.cumsum(at >> 1) - (at >> 1)
    return (a[i].astype(np.int64) << 32) | b[j].astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"


def aligned(docs: DataFrame, make, schema: str = ALIGNED) -> DataFrame:
    """One row for each row of ``docs``: its numbers of tokens, groups and links, its digest and its ids, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, row = make(), TaskContext.get().partitionId() << 36
        for batch in small(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = align(text)
                digest = hashlib.sha256(p.told.encode()).hexdigest() if p.n_groups else ""
                rows.append((row, doc, p.n_a, p.n_b, p.n_groups, p.n_a + p.n_b - p.n_groups, digest, p.a, p.b))
                row += 1
            kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    light(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ordered array, and how often each is in it."""
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    return x[edge[:-1]], np.diff(edge)


class Places:
    """Where numbers are in an ordered array of distinct ones: by a table of one slot a hash, and by bisection for those whose slot another has."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(8, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = self.slots[self._slot(x)]
        hit = self.keys[at] == x
        miss = np.flatnonzero(~hit)
        if len(miss):
            at[miss] = np.minimum(np.searchsorted(self.keys, x[miss]), len(self.keys) - 1)
            hit[miss] = self.keys[at[miss]] == x[miss]
        return at, hit


def counts(texts: DataFrame, lengths: Broadcast, most: int = 1 << 20) -> DataFrame:
    """(pair, n): the links of each id pair over all texts; a task adds up ``most`` links or distinct pairs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, links, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            """What was summed so far with the links that wait; these are put in order first, without their numbers, as that is much quicker."""
            more, times = _runs(np.sort(np.concatenate(links))) if links else (key[:0], n[:0])
            both, count = np.concatenate([key, more]), np.concatenate([n, times])
            order = np.argsort(both, kind="stable")
            both, count = both[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            return both[first], np.add.reduceat(count, first) if len(first) else count

        for batch in small(batches):
            a, b = _ids(batch.column(0)), _ids(batch.column(1))
            links.append(linked(a, b, labelled(a, b, lengths.value)))
            waiting += len(links[-1])
            if waiting > most:
                key, n = summed()
                links, waiting = [], 0
                if len(key) > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])
                    key, n = key[:0], n[:0]
        key, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

    return texts.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _hot(told: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of highest counts, ``most`` at most, in order, with (count << 1 | best): those above the lowest count, on a scale of 16 steps to the doubling, that leaves so many."""
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = most, None
    for r in told.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 1,024 steps at most
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = told.where(step >= least).select("pair", F.expr("shiftleft(n, 1) | int(best)").alias("n")).toArrow()
    key, n = t["pair"].to_numpy(), t["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def scored(docs: DataFrame, byte_path: str | None = None, rank_path: str | None = None, piece_path: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of ``docs``."""
    spark = docs.sparkSession
    paths = byte_path or public_tokenizers.path("byte_bpe_50k.json"), rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    texts = saved(aligned(docs, lambda: Aligner(*paths)), "alignments")
    lengths = spark.sparkContext.broadcast(tuple(np.array([len(t) for t in x], np.int64) for x in (byte_tokens(paths[0]), piece_tokens(paths[2]))))
    number = saved(counts(texts, lengths), "pair-counts")
    of_b = lambda pair: F.col(pair).bitwiseAND(F.lit(0xFFFFFFFF))
    best = number.groupBy(of_b("pair").alias("id")).agg(F.max("n").alias("best"))  # no longer than B's vocabulary
    told = saved(number.join(F.broadcast(best), of_b("pair") == F.col("id")).select("pair", "n", (F.col("n") == F.col("best")).alias("best")), "pairs")
    keys, values = _hot(told, hot)
    shared = spark.sparkContext.broadcast((keys, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        find = Places(keys)
        for batch in small(batches):
            n = batch.column(1).to_numpy()
            a, b = _ids(batch.column(2)), _ids(batch.column(3))
            found = linked(a, b, labelled(a, b, lengths.value))
            at, hit = find(found)
            value = np.where(hit, values[at], 0) if len(keys) else np.zeros(len(found), np.int64)
            edge = np.concatenate([[0], np.cumsum(n)])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total(~hit))]), pa.int32()), pa.array(found[~hit]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total(value & 1)), pa.array(total(value >> 1)), rare], ["row", "n_best", "count_sum", "rare"])

    light(spark)
    judged = saved(texts.select("row", "n_links", "a", "b").mapInArrow(run, "row long, n_best long, count_sum long, rare array<long>"), "judged-links")
    rest = judged.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    rest = rest.join(told, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).cast("long").alias(x)
    sums = judged.select("row", "n_best", "count_sum").join(rest, "row", "left").select("row", plus("n_best", "more_best"), plus("count_sum", "more"))
    return texts.drop("a", "b").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
