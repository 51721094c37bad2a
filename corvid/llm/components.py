"""Connected components of an undirected graph by alternating large and small stars.

Every step is a map-side-combined minimum per node and a join with those minima, so a node of very many
neighbours neither meets in one list nor in one task.  Each step ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvid.llm.scratch import fresh, remove


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _star(edges: DataFrame, large: bool, saved) -> DataFrame:
    """One star step over edges (u > v), which it returns in the same form."""
    if large:  # every larger neighbour of u moves to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(_minima(both).select("u", F.least("u", "m").alias("m")), "minima")
        out = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # every smaller neighbour of u, and u itself, moves to the least of them
        least = saved(_minima(edges), "minima")
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long), component being the least node reachable.

    Loops and repeated edges don't matter; an empty table gives an empty table.  A round's tables go once the next
    round's are written; the last round's stay in the shared folder, as the result reads them.
    """
    spark, kept = edges.sparkSession, []

    def saved(df: DataFrame, name: str) -> DataFrame:
        path, schema = fresh(spark, name), df.schema
        df.write.parquet(path)
        kept.append(path)
        return spark.read.schema(schema).parquet(path)

    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = saved(_star(saved(_star(now, True, saved), "large"), False, saved), "small")
        for path in kept[:-1]:
            remove(spark, path)
        del kept[:-1]
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
