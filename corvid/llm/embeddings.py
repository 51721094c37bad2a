"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Equal vectors are one row first, with a count.  Centroids are fitted on a sample of the rest, one for every
``target`` vectors and ``most_centroids`` at most; every vector is then put into the cells of its nearest centroids,
all that are within ``margin`` of the best (by cosine) and ``cells`` at most.  A pair that shares cells is judged in
the first of them only.  A cell above ``block`` vectors is cut into blocks, and each pair of blocks is a unit of work
of its own.  A unit gives link counts and at most one link a vector to the least of its cluster, never all pairs.

The sample is of ``fit`` vectors, or of ``fit_each`` for every centroid where that is more (131,072 at the most
centroids).  Vectors travel as they came, floats as floats.  Cosines are taken in double precision, and a pair below
the limit is never linked.  A near pair whose vectors share no cell is missed; with few cells none is.  Measured
recall is in the README.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite components, or of another
dimension than a pair's other, link with nothing; equal vectors link; a pair at the limit links as its cosine in
double precision says; repeated rows are vectors of their own; rows without vec_id count as links of others but name
no component; other columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvid.llm.arrow import runs
from corvid.llm.components import components
from corvid.llm.scratch import saved


@dataclass(frozen=True)
class Cells:
    limit: float = 0.95
    fit: int = 20_000
    fit_each: int = 4
    target: int = 500  # vectors whose nearest centroid a cell's is
    most_centroids: int = 32_768
    margin: float = 0.2
    cells: int = 8
    block: int = 2000
    rounds: int = 12
    seed: int = 7


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _step(k: int) -> int:
    """Vectors that are compared with ``k`` centroids at a time, so that their products stay below 32 MB."""
    return max(16, (1 << 22) // k)


def nearest_cells(x: np.ndarray, centroids: np.ndarray, cells: int, margin: float) -> list[list[int]]:
    """For each unit vector the centroids within ``margin`` of the best, ``cells`` at most, in their order."""
    out, step, m = [], _step(len(centroids)), min(cells, len(centroids))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ centroids.T
        top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(centroids) else np.broadcast_to(np.arange(m), (len(s), m))
        ok = np.take_along_axis(s, top, axis=1) >= s.max(axis=1, keepdims=True) - margin
        out += [sorted(r[o].tolist()) for r, o in zip(top, ok, strict=True)]
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k unit centroids of unit vectors; an emptied centroid is set on the vector that fits worst."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.empty(len(x), np.int64)
        fit = np.empty(len(x))
        step = _step(k)
        for a in range(0, len(x), step):
            s = x[a : a + step] @ c.T
            own[a : a + step] = s.argmax(axis=1)
            fit[a : a + step] = s.max(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        size = np.sqrt((new * new).sum(axis=1))
        empty = np.flatnonzero(size < 1e-12)
        new[empty] = x[np.argsort(fit)[: len(empty)]]
        size[empty] = 1.0
        new /= size[:, None]
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 1))


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, key1, key2, v): sound vectors scaled by a power of two, and a 128-bit digest of them; null for others.

    Such a scale leaves cosines as they are and keeps the squares of very large or small components finite.
    """
    kind = vectors.schema["v"].dataType.simpleString()
    made = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[list] = [[], []]
            out = []
            for v in b.column(1):
                x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid else np.zeros(0)
                peak = np.abs(x).max(initial=0.0)
                if not 0 < peak < np.inf:  # NaN compares false
                    keys[0].append(None)
                    keys[1].append(None)
                    out.append(None)
                    continue
                x = np.ldexp(x, -int(np.frexp(peak)[1])) + 0.0  # and no negative zeros
                h = xxhash.xxh3_128_digest(x.tobytes())
                for k, part in zip(keys, (h[:8], h[8:]), strict=True):
                    k.append(int.from_bytes(part, "little", signed=True))
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(k, pa.int64()) for k in keys), pa.array([x if x is None else x.astype(made.value_type.to_pandas_dtype()) for x in out], made)], ["vec_id", "key1", "key2", "v"])

    return vectors.mapInArrow(run, f"vec_id long, key1 long, key2 long, v {kind}")


def _judge(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "unit"):
            unit = t.column("unit").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
            t = t.combine_chunks()
            out: list[list[np.ndarray]] = [[], [], [], []]
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = t.slice(a, z - a)
                cell = part.column("cell")[0].as_py()
                side = part.column("side").to_numpy()
                gid, n = part.column("gid").to_numpy(), part.column("n").to_numpy()
                of = part.column("of").to_pylist()
                x = _units(_matrix(part.column("v").combine_chunks()))
                shared = np.array([[c if c >= 0 else -1 for c in (o + [-1] * cells.cells)[: cells.cells]] for o in of])
                low, high = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
                both = bool((side == 0).all())
                links = np.zeros(len(gid), np.int64)
                root = np.arange(len(gid))
                for r in range(0, len(low), 512):
                    rows = low[r : r + 512]
                    near = x[rows] @ x[high].T >= cells.limit
                    if both:
                        near &= gid[rows][:, None] < gid[high][None, :]
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    i, j = rows[i], high[j]
                    ok = np.ones(len(i), bool)  # judged here only if no earlier cell holds both
                    for p in range(cells.cells):
                        for q in range(cells.cells):
                            ok &= ~((shared[i, p] == shared[j, q]) & (shared[i, p] >= 0) & (shared[i, p] < cell))
                    i, j = i[ok], j[ok]
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    while len(i):
                        least = np.minimum(root[i], root[j])
                        new = root.copy()
                        np.minimum.at(new, root[i], least)
                        np.minimum.at(new, root[j], least)
                        new = new[new]
                        if (new == root).all():
                            break
                        root = new
                hit = np.flatnonzero(links)
                for o, v in zip(out, (gid[hit], gid[root[hit]], links[hit]), strict=False):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out[:3]], ["gid", "root", "links"])

    return run


def deduplicated(vectors: DataFrame, cells: Cells = Cells(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors``."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = saved(_prepared(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))), "prepared-vectors")
    groups = saved(rows.where("v is not null").groupBy("key1", "key2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("gid", F.xxhash64("key1", "key2")), "vectors")
    total = groups.count()
    if total:
        k = max(1, min(cells.most_centroids, round(total / cells.target)))
        order = F.xxhash64(F.lit(cells.seed), "gid")
        sample = groups.select("v", order.alias("o")).orderBy("o").limit(max(cells.fit, cells.fit_each * k)).select("v").toArrow()["v"]
        sizes = np.concatenate([c.value_lengths().to_numpy() for c in sample.chunks])
        dim = int(np.bincount(sizes).argmax())
        x = _units(_matrix(pa.concat_arrays([c.filter(pa.array(c.value_lengths().to_numpy() == dim)) for c in sample.chunks])))
        shared = spark.sparkContext.broadcast(spherical_kmeans(x, min(k, len(x)), cells.rounds, cells.seed))
    else:
        dim, shared = 0, spark.sparkContext.broadcast(np.ones((1, 1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _units(_matrix(b.column(1)))
            of = nearest_cells(x, shared.value, cells.cells, cells.margin)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(of, pa.list_(pa.int32()))], ["gid", "n", "v", "of"])

    schema = f"gid long, n long, v {kind}, of array<int>"
    usual = groups.where(F.size("v") == dim).select("gid", "v", "n").mapInArrow(place, schema)
    # vectors of another dimension than most: one cell for each such dimension
    odd = groups.where(F.size("v") != dim).select("gid", "n", "v", F.array((F.lit(1 << 20) + F.size("v")).cast("int")).alias("of"))
    placed = saved(usual.unionByName(odd), "placed")
    members = placed.withColumn("cell", F.explode("of"))
    count = saved(placed.select(F.explode("of").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / cells.block).cast("int").alias("blocks")), "cell-blocks")
    at = F.pmod(F.xxhash64("gid", F.lit(3)), F.col("blocks")).cast("int")
    dealt = members.join(F.broadcast(count), "cell").withColumn("own", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    units = dealt.select(unit.alias("unit"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "cell", "gid", "n", "v", "of")
    found = saved(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_judge(cells), "gid long, root long, links long"), "vector-links")
    node = components(found.select(F.col("gid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    owned = saved(groups.select("gid", "least").join(node, F.col("gid") == F.col("node")).select("gid", "least", "component"), "members")
    least = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    of = owned.join(least, "component").select("gid", "component_id")
    table = groups.select("gid", "key1", "key2", "n", "least").join(of, "gid", "left").join(links, "gid", "left")
    table = saved(table.select("key1", "key2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "vector-groups")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = rows.where("v is not null").select("vec_id", "key1", "key2").join(table, ["key1", "key2"]).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return linked.unionByName(alone)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive unit as (select vec_id, cast(embedding as double[]) v from embeddings),
link as (select a.vec_id u, b.vec_id w from unit a join unit b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (select vec_id, vec_id r from unit union select reach.vec_id, link.w from reach join link on link.u = reach.r),
comp as (select vec_id, min(r) c from reach group by vec_id),
cnt as (select u, count(*) n from link group by u)
select comp.vec_id, cast(coalesce(n, 0) as bigint) n_links, c component_id, comp.vec_id = c kept from comp left join cnt on u = comp.vec_id"""
