"""SimHash near-dedup with a pigeonring filter.

Fingerprints are cut into m segments on a ring.  If two differ at no more than t bits, then from some segment on
every chain of l consecutive segments differs at no more than l * t / m bits (the pigeonring principle).  With
m = 4 and t = 3 the first segment of that chain is equal: it is the join key.  Pairs of a bucket must then pass
the budgets of the chains of two and three segments before the full Hamming check.

Buckets are of distinct fingerprints only.  One above ``most`` is dealt anew by its next segment, of which at
most one bit may differ (chain budget of two): each of its bits in turn is masked.  If such a finer bucket is
still above ``most``, it is cut into blocks and every pair of blocks compared by itself.  Each bucket gives at
most one link per fingerprint, to the least of its cluster, not all pairs; no linked fingerprint is lost.

Defined cases: a null text, or one without words, has fingerprint zero and is linked like any other; fewer words
than a shingle are one shingle; repeated rows give repeated rows; rows without doc_id get a null component only
if no other row is linked with them; a text of any length is taken whole; other columns are ignored, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvid.llm.arrow import any_names, light, runs, small
from corvid.llm.bitmap import text_hash, without_rows
from corvid.llm.components import components
from corvid.llm.scratch import saved

WORD = re.compile(rb"[^ \t-\r]+")
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit majority of the XXH64 (seed 42) of all word shingles, repeats included, A-Z lowered."""
    w = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(UPPER))
    if not w:
        return 0
    n, h = len(w), xxhash.xxh64_intdigest
    if n <= shingle:
        return h(b" ".join(w), 42)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - shingle]]).tolist()
    return majority(np.array([h(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def majority(x: np.ndarray) -> int:
    """Each bit that more than half of the hashes have."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(x), 8192):
        total += np.unpackbits(x[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(x)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp: the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    light(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _close(a: np.ndarray, b: np.ndarray, ring: np.ndarray, near: int) -> np.ndarray:
    """Whether pairs meet the chain budgets from their bucket's first segment on, and then the Hamming bound."""
    x, turn = a ^ b, ring.astype(np.uint64) * np.uint64(16)
    x = (x << turn) | (x >> ((np.uint64(64) - turn) & np.uint64(63)))  # the first segment leads
    ok = np.bitwise_count(x >> np.uint64(32)) <= 2 * near // 4
    ok &= np.bitwise_count(x >> np.uint64(16)) <= 3 * near // 4
    return ok & (np.bitwise_count(x) <= near)


def _forest(key: np.ndarray, fp: np.ndarray, ring: np.ndarray, near: int) -> np.ndarray:
    """For each row the least row, by position, of its cluster within its run of equal keys."""
    n = len(key)
    root = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    longest = int(np.diff(np.append(first, n)).max())
    pairs = []
    for d in range(1, longest):
        at = np.flatnonzero(key[:-d] == key[d:])
        if not len(at):
            break
        at = at[_close(fp[at], fp[at + d], ring[at], near)]
        at = at[root[at] != root[at + d]]  # of links within a cluster known already none is needed
        if len(at):
            pairs.append(np.column_stack([at, at + d]))
            if len(pairs) % 16 == 0:
                root = _roots(np.concatenate(pairs), n)
    return _roots(np.concatenate(pairs), n) if pairs else root


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(distinct: DataFrame, near: int = 3, most: int = 2000) -> DataFrame:
    """(u, v): links between the distinct fingerprints ``fp`` of ``distinct``, enough to connect every cluster."""
    spark = distinct.sparkSession
    ring = F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("ring")
    segment = lambda i: F.shiftrightunsigned(F.col("fp"), (48 - 16 * i)).bitwiseAND(F.lit(0xFFFF))
    pick = lambda k: F.element_at(F.array(*(segment(i) for i in range(4))), ((F.col("ring") + k) % 4 + 1).cast("int"))
    wide = distinct.select("fp", ring).select("fp", "ring", (F.col("ring").cast("long") * 65536 + pick(0)).alias("key"))
    large = saved(wide.groupBy("key").count().where(F.col("count") > most).select("key"), "large-buckets")
    small = wide.join(large, "key", "left_anti")
    parts = [small]
    if large.head(1):
        masked = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("bit")
        over = wide.join(large, "key", "left_semi").select("fp", "ring", "key", pick(1).alias("second"), masked)
        fine = over.select("fp", "ring", F.xxhash64("key", "bit", F.col("second").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))).alias("key"))
        fine = saved(fine, "fine-buckets")
        count = saved(fine.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("blocks")), "larger-buckets")
        parts.append(fine.join(count, "key", "left_anti").select("fp", "ring", "key"))
        if count.head(1):
            block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")
            blocks = fine.join(count, "key").select("fp", "ring", "key", "blocks", block).select("fp", "ring", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            parts.append(blocks.select("fp", "ring", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "key"):
            fp, ring_of, key = (t.column(c).to_numpy() for c in ("fp", "ring", "key"))
            root = _forest(key, fp.view(np.uint64) if fp.flags.c_contiguous else np.ascontiguousarray(fp).view(np.uint64), ring_of, near)
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], ["u", "v"])

    out = None
    for p in parts:
        p = p.select("fp", "ring", F.col("key").cast("long").alias("key")).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")
        out = p if out is None else out.unionByName(p)
    return out


def grouped(docs: DataFrame, near: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id and fp for each row of ``docs``."""
    of = saved(fingerprints(docs), "fingerprints")
    distinct = saved(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    node = components(links(distinct.select("fp"), near))
    members = node.select(F.col("node").alias("fp"), "component").join(distinct, "fp")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = saved(members.select("fp", "component").join(least, "component").select("fp", F.col("component_id").alias("found")), "linked")
    table = saved(distinct.join(linked, "fp", "left").select("fp", F.coalesce("found", "least").alias("component_id")), "groups")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return of.join(table, "fp").select("doc_id", hexed, "component_id", "fp", "text_hash")


@any_names
def one_of_each(docs: DataFrame, near: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, that have the least doc_id of their group of near copies.

    Repeated rows of that id and text stay as they are; rows without doc_id stay only in groups without any id.
    """
    groups = grouped(docs, near)
    dropped = saved(groups.where("component_id is not null and (doc_id is null or doc_id <> component_id)").select("doc_id", "text_hash").distinct(), "near-copies")
    return without_rows(docs, dropped)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp", "text_hash")
