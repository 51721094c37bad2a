"""Incremental ingest as a stream: what is new in a folder goes through the same function as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, folder: str, schema: str, checkpoint: str, take: Callable[[DataFrame, int], object], files_per_batch: int = 1000, only: str = "*") -> None:
    """Hand all files that came to ``folder`` since the last call to ``take``, in batches, and return.

    ``take`` gets a batch and its number.  A batch that fails comes again with the next call under the same number, so that
    one whose work was done, but not yet noted by the stream, can be told.
    """
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", only).parquet(folder)
    query = pages.writeStream.foreachBatch(lambda df, number: take(df, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
