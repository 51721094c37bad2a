"""Helpers for Arrow-batched operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def any_names(operator):
    """``operator``, which keeps the columns of its first argument: those that begin with two underscores, as its own do, have other names meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        mark = "given"
        while any(c.lower().startswith(mark) for c in docs.columns):
            mark += "-"
        other = {c: f"{mark} {k}" for k, c in enumerate(docs.columns) if c.startswith("__")}
        out = operator(docs.withColumnsRenamed(other), *args, **options)
        return out.withColumnsRenamed({new: c for c, new in other.items()})

    return run


def light(spark: SparkSession, rows: int = 512) -> None:
    """Smaller Arrow batches for the session, unless it already has a setting below the default: rows here may be whole long texts,
    and a batch lies in the executor's memory on either side of the pipe."""
    if int(spark.conf.get(BATCH)) >= 10_000:
        spark.conf.set(BATCH, str(rows))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key`` from a stream sorted by it; a run never straddles two tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = k[-1]
        if k[0] == last and held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == last:
            held.append(b)
            continue
        cut = int(np.searchsorted(k == last, True)) if k[0] != last else 0
        if cut:
            held.append(b.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held)
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that what Python makes of texts is held for few of them at a time.

    At the end a worker, which Spark keeps for further tasks, gives back the memory it no longer uses.
    """
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)
