"""A membership bitmap over 64-bit keys, sized by their number.

It prunes work before a shuffle and never decides a result: a clear bit proves absence, a set bit only
sends the row on to an exact join.  It has 16 to 32 bits a key, 1 MB at least and ``MOST_BITS`` (64 MB) at most: with more than
some 30 million keys more rows go the exact way, up to all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LEAST_BITS, MOST_BITS = 1 << 23, 1 << 29


class Bitmap:
    """Bits of the keys in column ``key`` (long) of ``df``, a written table; built by the JVM's bitmap aggregate, 4 KB a group."""

    def __init__(self, df: DataFrame, key: Column):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * df.count()).bit_length()))
        at = (F.pmod(key, F.lit(self.bits)) + 1).alias("at")  # the JVM counts bits from 1
        parts = (
            df.select(at)
            .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
            .toLocalIterator()
        )
        raw = np.zeros(self.bits // 8, np.uint8)
        for p in parts:
            start = (p.bucket - 1) * 4096
            raw[start : start + 4096] = np.frombuffer(p.bits, np.uint8)
        self.shared = df.sparkSession.sparkContext.broadcast(raw)

    def tester(self):
        """A picklable function from keys to booleans, for use in tasks."""
        shared, mask = self.shared, np.int64(self.bits - 1)

        def test(keys: np.ndarray) -> np.ndarray:
            at = np.asarray(keys, np.int64) & mask
            return (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        return test


def text_hash() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text_hash())


def suspected(df: DataFrame, bits: Bitmap, key: Column, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``key`` has its bit set, or those whose bit is clear; only the key goes to Python."""
    test = bits.tester()

    @F.arrow_udf("boolean")
    def held(keys: pa.Array) -> pa.Array:
        return pa.array(test(keys.to_numpy(zero_copy_only=False)) == inside)

    # not marked deterministic, or the optimizer would also run it on whatever the key is joined with
    return df.where(held.asNondeterministic()(key))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text hash are in ``dropped``; only suspects are shuffled."""
    bits = Bitmap(dropped, F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_hash"))
    gone = dropped.select(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_hash").alias("__gone"), F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash"))
    suspects = suspected(docs, bits, row_key())
    match = (row_key() == F.col("__gone")) & suspects["doc_id"].cast("long").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(suspects["text"].cast("string")) == F.col("__gone_hash"))
    return suspected(docs, bits, row_key(), False).unionByName(suspects.join(gone, match, "left_anti"))
