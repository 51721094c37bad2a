"""An exact index of cells: rows by their nearest of some unit centroids, and a bound that tells which cells a query needs.

Each cell knows its angular radius, the greatest angle between its centroid and one of its rows.  By the triangle
inequality for angles, no row of a cell is more similar to a query than the cosine of (angle to the centroid - radius).
A query reads its most promising cells first, as many as hold enough rows; then those others whose bound is not below its
k-th best score.  Cells left out hold nothing better, so the answer is that of a search over all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corvid.functions.vectors import pieces, units
from corvid.operators.search import _ranked, dealt, nearest, told, usable
from corvid.tables import fresh

#: Added to a radius, as arc cosines near 1 are exact to about 1.5e-8 only.
SLACK = 1e-7


def fitted(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Unit centroids of unit rows."""
    c = sample[: max(1, min(lists, len(sample)))]
    for _ in range(rounds if len(sample) else 0):
        own = (sample @ c.T).argmax(axis=1)
        c = np.stack([sample[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-300)
    return c


def sampled(rows: DataFrame, vector_col: str, number: int, seed: int, most_bytes: int = 64 << 20) -> np.ndarray:
    """Unit vectors of the rows of least hash, ``number`` of them or as many as take ``most_bytes``, of the length that most of them have."""
    size = rows.select(F.size(vector_col).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return np.zeros((0, 1))
    number = max(1, min(number, most_bytes // (8 * max(1, size.n))))
    t = rows.where(F.size(vector_col) == size.n).select(F.col(vector_col).cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), vector_col).alias("o")).orderBy("o").limit(number).select("v").toArrow()
    parts = [units(c, size.n) for c in t["v"].chunks]
    return np.concatenate([x[ok] for x, ok in parts]) if parts else np.zeros((0, size.n))


def placed(rows: DataFrame, centroids: np.ndarray, vector_col: str) -> DataFrame:
    """``rows`` that have a direction, with their ``cell`` and ``cosine`` to its centroid; of another length than the centroids': minus the length, and 1."""
    dim = centroids.shape[1]

    @F.arrow_udf("struct<cell: int, cosine: double>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in (p for b in batches for p in pieces(b)):
            x, ok = units(v, dim)
            cosine = x @ centroids.T if len(centroids) else np.zeros((len(x), 1))
            cell, best = cosine.argmax(axis=1).astype(np.int32), cosine.max(axis=1)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[~np.isnan(sizes.astype(float))]).astype(int).tolist():
                if n != dim:
                    fine = units(v, n)[1]
                    cell[fine], best[fine] = -n, 1.0
                    ok = ok | fine
            yield pa.StructArray.from_arrays([pa.array(cell, mask=~ok), pa.array(best, mask=~ok)], ["cell", "cosine"])

    out = rows.where(F.col(vector_col).isNotNull()).withColumn("_place", place.asNondeterministic()(F.col(vector_col)))
    return out.where("_place.cell is not null").withColumns({"cell": F.col("_place.cell"), "cosine": F.col("_place.cosine")}).drop("_place")


class Cells:
    """Centroids with the number of rows and the least cosine of each cell; cells of other lengths have negative numbers and no centroid."""

    def __init__(self, centroids: np.ndarray, stats: dict[int, tuple[int, float]]):
        self.centroids, self.stats = centroids, stats
        self.held = np.array([k for k in stats if k >= 0], int)
        self.rows = np.array([stats[k][0] for k in self.held.tolist()], int)
        self.radius = np.arccos(np.clip([stats[k][1] for k in self.held.tolist()], -1, 1)) + SLACK if len(self.held) else np.zeros(0)

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, bounds) of one unit query, the greatest bound first."""
        if len(q) != self.centroids.shape[1]:
            own = [-len(q)] if -len(q) in self.stats else []
            return np.array(own, int), np.ones(len(own))
        if not len(self.held):
            return np.zeros(0, int), np.zeros(0)
        angle = np.arccos(np.clip(self.centroids[self.held] @ q, -1, 1))
        bound = np.cos(np.maximum(0, angle - self.radius))
        at = np.lexsort((self.held, angle, -bound))
        return self.held[at], bound[at]

    def first(self, cells: np.ndarray, limit: int, least: int) -> int:
        """How many of ``cells`` a query reads first: ``least``, or as many as hold ``limit`` rows."""
        n = np.cumsum([self.stats[int(c)][0] for c in cells])
        return min(len(cells), max(least, int(np.searchsorted(n, limit)) + 1))


class CellIndex:
    """A stored index: a folder for each cell.  Rows without a direction are in none, as they have no score."""

    def __init__(self, spark: SparkSession, path: str, vector_col: str = "embedding"):
        """An index that ``build`` has written to ``path``."""
        self.path, self.vector_col, self.spark = path.rstrip("/"), vector_col, spark
        told = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # one row a cell
        made = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        self.cells = Cells(np.array([r.v for r in made], float) if made else np.zeros((0, 1)), {r.cell: (r.n, r.least) for r in told})
        about = spark.read.parquet(f"{self.path}/about").first()  # an index without rows has no files to tell their columns
        self.rows = spark.read.schema(StructType.fromJson(json.loads(about.columns))).parquet(f"{self.path}/rows")

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int = 100, sample: int = 20_000, rounds: int = 10, seed: int = 5, vector_col: str = "embedding", most_rows: int = 500_000) -> CellIndex:
        """Fit on the ``sample`` rows of least hash, give every row with a direction its cell, and write all once, in files of about ``most_rows`` rows."""
        spark, path = rows.sparkSession, path.rstrip("/")
        held = rows.where(F.col(vector_col).isNotNull())
        centroids = fitted(sampled(held, vector_col, sample, seed), lists, rounds)
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, v array<double>").write.parquet(f"{path}/centroids")
        salts = max(1, -(-held.count() // (max(1, len(centroids)) * most_rows)))
        out = placed(held, centroids, vector_col).repartition("cell", F.pmod(F.xxhash64(vector_col), F.lit(salts)))
        out.write.option("maxRecordsPerFile", most_rows).partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(out.schema.json(),)], "columns string").write.parquet(f"{path}/about")
        stored = spark.read.schema(out.schema).parquet(f"{path}/rows")
        stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).write.parquet(f"{path}/cells")
        return cls(spark, path, vector_col)

    def _in(self, cells: Sequence[int]) -> DataFrame:
        return self.rows.where(F.col("cell").isin([int(c) for c in cells])).drop("cell", "cosine")

    def search(self, query: Sequence[float], limit: int = 10, first: int = 2, **options) -> DataFrame:
        """As ``search.nearest`` over all rows; ``cells_read`` of this object tells how many cells were."""
        q = np.asarray(query, float)
        size = float(np.sqrt(q @ q))
        cells, bounds = self.cells.order(q / size if size > 0 else q)
        n = self.cells.first(cells, limit, first) if len(cells) else 0
        near = lambda c: nearest(self._in(c), query, limit, vector_col=self.vector_col, **options)
        floor = options.pop("min_score", None)
        best = near(cells[:n]).select("score").collect()  # ``limit`` rows at most
        least = best[-1].score if len(best) == limit else -2.0
        more = int((bounds[n:] >= max(least, floor or -2.0) - SLACK).sum())
        self.cells_read = n + more
        options["min_score"] = floor
        return near(cells[: n + more])

    def search_each(self, queries: DataFrame, limit: int = 10, key: str = "vec_id", block: int = 2048, first: int = 2, part: int = 1 << 17) -> DataFrame:
        """(query, key, score, rank, cells): as ``search.nearest_each`` over all rows, and of how many cells each query read the rows."""
        spark, cells = queries.sparkSession, self.cells

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near, bound, turn, keep = [], [], [], []
                for v in b.column(1).to_pylist():
                    x, ok = units(pa.array([v], pa.list_(pa.float64())), len(v))
                    c, w = cells.order(x[0]) if ok[0] else (np.zeros(0, int), np.zeros(0))
                    keep.append(len(c) > 0)
                    near.append(c.tolist())
                    bound.append(w.tolist())
                    turn.append(cells.first(c, limit, first) if len(c) else 0)
                columns = [b.column(0), b.column(1), pa.array(near, pa.list_(pa.int32())), pa.array(bound, pa.list_(pa.float64())), pa.array(turn, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "near", "bound", "turn"]).filter(pa.array(keep, pa.bool_()))

        def stage(df: DataFrame, name: str) -> DataFrame:
            path, schema = fresh(spark, name), df.schema
            df.write.parquet(path)
            return spark.read.schema(schema).parquet(path)

        planned = stage(usable(queries, key, self.vector_col).mapInArrow(plan, "id long, v array<double>, near array<int>, bound array<double>, turn int"), "asked-cells")
        n = planned.count()
        every = usable(self.rows, key, self.vector_col, "cell")

        def met(asked: DataFrame) -> DataFrame:
            """The best of the rows of the ``cells`` that each query asks for."""
            if n <= block:  # looked at, so bounded
                t = asked.toArrow()
                asking: dict[int, list[int]] = {}
                for at, mine in enumerate(t["cells"].to_pylist()):
                    for c in mine:
                        asking.setdefault(c, []).append(at)
                wanted = every.where(F.col("cell").isin(sorted(asking)))
                return told(wanted, t.select(["id", "v"]), limit, key, asking)
            blocks = -(-n // block)
            parts = F.element_at(F.create_map(*(F.lit(x) for c, (rows, _) in cells.stats.items() for x in (c, -(-rows // part)))), F.col("cell"))
            at = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
            left = asked.select("id", "v", at.alias("block"), F.explode("cells").alias("cell")).select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
            right = every.select("id", "v", "cell", F.pmod(F.xxhash64("id", F.lit(2)), parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
            unit = F.xxhash64("cell", F.col("part").cast("int"), F.col("block").cast("int")).alias("unit")
            wanted = left.select("cell").distinct()
            return dealt(left.select(unit, "id", "v"), right.join(wanted, "cell", "left_semi").select(unit, "id", "v"), limit, key)

        begun = stage(_ranked(met(planned.select("id", "v", F.slice("near", F.lit(1), F.col("turn")).alias("cells"))), limit, key).drop("rank"), "first-cells")
        last = begun.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("found"))
        kth = F.when(F.col("found") == limit, F.col("kth") - SLACK).otherwise(-2.0)
        left = F.transform(F.filter(F.arrays_zip(F.slice("near", F.col("turn") + 1, F.size("near")), F.slice("bound", F.col("turn") + 1, F.size("near"))), lambda x: x["1"] >= F.col("kth")), lambda x: x["0"])
        rest = planned.join(last, planned["id"] == last["query"], "left").withColumn("kth", F.coalesce(kth, F.lit(-2.0)))
        rest = stage(rest.select("id", "v", "turn", left.alias("cells")), "further-cells")
        found = begun.unionByName(met(rest.where(F.size("cells") > 0).select("id", "v", "cells")))
        read = rest.select(F.col("id").alias("query"), (F.col("turn") + F.size("cells")).alias("cells"))
        return _ranked(found, limit, key).join(read, "query")
