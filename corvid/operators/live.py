"""The store's own index of cells, kept up by each write.

A cell is a list of folders, each with the number of the version that wrote it, its number of rows and the least cosine of
its rows to the cell's centroid.  A write adds a folder to the cells that its new chunks fall in, and to no others;
rows that a later version replaces or drops are told by the store's deltas, as chunks are.  A cell that has grown far
beyond the others is split in two.  A search is that of ``cells``: a few cells at first, then those whose bound leaves room.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corvid.operators import search
from corvid.operators.cells import SLACK, Cells, fitted, placed, sampled

ENTRY = "source_url string, chunk_index int, product string, embedding array<float>"
NAMES = ("source_url", "chunk_index", "product", "embedding")


def _centroids(store, tag: str) -> np.ndarray:
    rows = store.spark.read.schema("cell int, v array<double>").parquet(f"{store.path}/centroids/tag={tag}").orderBy("cell").collect()  # one row a cell
    return np.array([r.v for r in rows], float) if rows else np.zeros((0, store.dimensions))


def _keep_centroids(store, centroids: np.ndarray) -> str:
    tag = uuid.uuid4().hex[:12]
    store.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, v array<double>").coalesce(1).write.parquet(f"{store.path}/centroids/tag={tag}")
    return tag


def _written(store, rows: DataFrame, seq: int, most_rows: int = 500_000) -> dict[str, dict]:
    """``rows`` (of ENTRY, cell, cosine) as new folders, one a cell."""
    tag = uuid.uuid4().hex[:12]
    path = f"{store.path}/index/tag={tag}"
    out = rows.select(*NAMES, "cosine", "cell")
    out.repartition("cell").write.option("maxRecordsPerFile", most_rows).partitionBy("cell").parquet(path)
    stored = store.spark.read.schema(out.schema).parquet(path).groupBy("cell").agg(F.count("*").alias("rows"), F.min("cosine").alias("least"))
    return {str(r.cell): {"tag": tag, "seq": seq, "rows": r.rows, "least": r.least} for r in stored.collect()}  # one row a cell


def _rows(store, m: dict, cells=None, alive: bool = True) -> DataFrame:
    """The entries (ENTRY, cosine, cell) of some cells, or of all."""
    of = {c: x for c, x in m["index"]["cells"].items() if cells is None or int(c) in cells}
    paths = [f"{store.path}/index/tag={p['tag']}/cell={c}" for c, x in of.items() for p in x]
    if not paths:
        return store.spark.createDataFrame([], f"{ENTRY}, cosine double, cell int, _seq int")
    seqs = {p["tag"]: p["seq"] for x in of.values() for p in x}
    read = store.spark.read.schema(f"{ENTRY}, cosine double, tag string, cell int").option("basePath", f"{store.path}/index").parquet(*paths)
    rows = read.withColumn("_seq", store.seq_of(seqs)).drop("tag")
    return store.live(rows, m) if alive else rows


def built(store, m: dict, lists: int, sample: int = 20_000, rounds: int = 10, seed: int = 5, split: int = 4, split_from: int = 1000) -> dict | None:
    """The index of a version's chunks, if it has vectors; a cell of more than ``split`` times the mean and ``split_from`` rows is split when it is written to."""
    rows = store._read("chunks", m).where(F.col("embedding").isNotNull()).select(*NAMES)
    centroids = fitted(sampled(rows, "embedding", sample, seed), lists, rounds)
    if not len(centroids):
        return None
    cells = {c: [x] for c, x in _written(store, placed(rows, centroids, "embedding"), m["version"]).items()}
    return {"centroids": _keep_centroids(store, centroids), "cells": cells, "split": [split, split_from]}


def added(store, m: dict, new: DataFrame, seq: int) -> dict:
    """The index with the chunks ``new`` of version ``seq``."""
    index = m["index"]
    centroids = _centroids(store, index["centroids"])
    made = _written(store, placed(new.where(F.col("embedding").isNotNull()).select(*NAMES), centroids, "embedding"), seq)
    index = {**index, "cells": {**index["cells"], **{c: [*index["cells"].get(c, []), x] for c, x in made.items()}}}
    return _split(store, {**m, "index": index}, set(made), centroids)


def _split(store, m: dict, touched: set[str], centroids: np.ndarray) -> dict:
    """The index with those of the ``touched`` cells that are far too large in two."""
    index = m["index"]
    size = {c: sum(p["rows"] for p in x) for c, x in index["cells"].items()}
    bound = max(index["split"][1], index["split"][0] * sum(size.values()) / max(1, len(centroids)))
    large = [int(c) for c in touched if int(c) >= 0 and size[c] > bound]
    cells = dict(index["cells"])
    for c in large:
        rows = _rows(store, {**m, "index": {**index, "cells": cells}}, {c}).drop("cell", "cosine", "_seq")
        two = fitted(sampled(rows, "embedding", 20_000, 5), 2, 10)
        if len(two) < 2:
            continue
        made = _written(store, placed(rows, two, "embedding").withColumn("cell", F.when(F.col("cell") == 0, F.lit(c)).otherwise(F.lit(len(centroids)))), m["version"] + 1)
        if len(made) < 2:  # equal vectors
            continue
        centroids = np.concatenate([centroids, two[1:]])
        centroids[c] = two[0]
        del cells[str(c)]
        cells |= {k: [x] for k, x in made.items()}
    return {**index, "cells": cells, "centroids": _keep_centroids(store, centroids) if large else index["centroids"]}


def purged(store, m: dict, only: set[int] | None) -> dict:
    """The index without entries that the deltas of some buckets, or of all, replace or drop; cells without such stay as they are."""
    index, every = m["index"], _rows(store, m, alive=False)
    left = store.live(every, m, only)
    keys = ["source_url", "chunk_index", "cell", "_seq"]
    dead = every.select(*keys).join(left.select(*keys), keys, "left_anti").select("cell").distinct()
    cells = {r.cell for r in dead.collect()}  # a row a cell
    if not cells:
        return index
    # rows of several versions will share a folder, whose number is that of the newest, so none that any delta drops may be among them
    made = _written(store, _rows(store, m, cells), m["version"])
    return {**index, "cells": {c: x for c, x in index["cells"].items() if int(c) not in cells} | {c: [x] for c, x in made.items()}}


def nearest(store, m: dict, vector, limit: int, product: str | None, min_score: float | None, first: int = 4) -> DataFrame:
    """As ``search.nearest`` over all chunks of the version.  ``store.cells_read`` tells how many cells were read."""
    q = np.asarray(vector, float)
    size = float(np.sqrt(q @ q))
    stats = {int(c): (sum(p["rows"] for p in x), min(p["least"] for p in x)) for c, x in m["index"]["cells"].items()}
    cells = Cells(_centroids(store, m["index"]["centroids"]), stats)
    order, bounds = cells.order(q / size if size > 0 else q)
    n = cells.first(order, limit, first) if len(order) else 0
    best = lambda k: search.nearest(_rows(store, m, set(order[:k].tolist())), vector, limit, product)
    found = best(n).collect()  # ``limit`` rows
    least = found[-1].score if len(found) == limit else -2.0
    more = int((bounds[n:] >= max(least, min_score or -2.0) - SLACK).sum())
    if more:
        found = best(n + more).collect()
    store.cells_read = n + more
    keys = store.spark.createDataFrame([(r.source_url, r.chunk_index, r.score) for r in found], "source_url string, chunk_index int, score double")
    rows = store._read("chunks", m, store._buckets(keys, "source_url", m["buckets"])).drop("embedding")
    out = rows.join(F.broadcast(keys), ["source_url", "chunk_index"]).orderBy(F.desc("score"), *search.TIES)
    return out.where(F.col("score") >= min_score) if min_score else out
