"""Intermediate tables in the folder that the session's executors share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The paths of the innermost scope; each thread has its own.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("corvid-scope", default=None)


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of our own, which only a local session may use."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"/tmp/checkpoints/corvid-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has.  Within ``scoped`` it goes at the end."""
    path = f"{folder(spark)}/corvid/{name}-{uuid.uuid4().hex}"
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)
    return path


@contextlib.contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """What is put in the shared folder within the block goes at its end; write results elsewhere, or take their path before."""
    paths: list[str] = []
    before = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in paths:
            remove(spark, path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Drop every intermediate table of this library from the shared folder."""
    remove(spark, f"{folder(spark)}/corvid")
