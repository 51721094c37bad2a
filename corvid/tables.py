"""Intermediate tables in the folder that the session's executors share, and rows in order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the checkpoint folder that was set.  Where there is neither, a local folder, which only a local session may use."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (where or "/tmp/checkpoints").rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has."""
    return f"{shared_folder(spark)}/corvid-engine/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Staged:
    """Tables written to the shared folder and read back: computed once, and not lost with an executor.  They go with the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *_) -> None:
        for p in self.paths:
            remove(self.spark, p)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = fresh(self.spark, name), df.schema
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, keep, *order: Column, as_col: str = "ordinal", first: int = 0) -> DataFrame:
    """``df`` with each row's place in a total order, from ``first`` on.  ``keep``: a function that stages a table.

    Rows are dealt by ranges of the order; each range counts by itself and the driver adds one number a range.
    """
    dealt = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "in-order")
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    ahead = {k: first + sum(n for j, n in counts.items() if j < k) for k in counts}
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    if len(ahead) > 1:
        offset = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(ahead.items()) for x in kv)), F.col("_range"))
    else:
        offset = F.lit(first)
    return dealt.select(*df.columns, (place + offset).cast("long").alias(as_col))
