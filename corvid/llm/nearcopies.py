"""Near copies: pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash fingerprints of those sets, linked within 3 bits by the pigeonring filter of
``simhash``.  At 0.8 about 10 of 64 bits differ, and up to 20, a bound that no segment index can serve; so MinHash adds
the rest: ``BANDS`` bands of ``ROWS`` minima, of which a pair at 0.8 shares none with a chance of 9e-12.  Every candidate
is then decided by the exact similarity of the two sets.

Texts with one set are one node.  First each node of a band's bucket, and each that the fingerprints link, is compared
with the least of it, its head; a head's set travels once for so many shingles of its members, so a head of very many
meets them in many tasks.  What is still in different components is then told apart in two steps.  Within a bucket, nodes
of different components whose minima may belong to a pair at 0.8 (211 of 320 agree; such a pair has fewer with a chance of
about 1e-9) are joined to clusters, by one link for each two components that meet, not one for each pair.  Within a
cluster all sets meet in blocks of a bounded number of shingles, where similarities of nodes in different components are
counted exactly; a block gives at most one link for each two components again.  A cluster of many blocks is taken bucket
by bucket instead.  So no step has more rows than nodes, buckets and blocks, however many pairs are alike below 0.8.

Defined cases: words and case are as in ``simhash``; fewer words than a shingle are one shingle; texts without words,
null ones too, have the empty set and are copies of each other; repeated rows of one id and text stay together; rows
without doc_id stay only in groups without any id; a text of any length is taken whole; other columns are kept,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corvid.llm.arrow import any_names, light, runs, small
from corvid.llm.bitmap import Bitmap, row_key, suspected, text_hash, without_rows
from corvid.llm.components import components
from corvid.llm.scratch import saved
from corvid.llm import simhash
from corvid.llm.simhash import UPPER, WORD, majority

BANDS, ROWS = 64, 5
LEAST_EQUAL = 211
_RNG = np.random.default_rng(42)
TIMES = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
TURN = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 (seed 42) of the word shingles, as uint64."""
    w = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(UPPER))
    if not w:
        return np.zeros(0, np.uint64)
    n, h, line = len(w), xxhash.xxh64_intdigest, b" ".join(w)
    if n <= shingle:
        return np.array([h(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - shingle]]).tolist()
    return np.unique(np.array([h(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def node_of(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes(), 42)


def minima(x: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    y = (x >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(y), 256):
        np.minimum(least, ((y[k : k + 256, None] ^ TURN) * TIMES).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band, of the minima of its rows."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _texts(docs: DataFrame, *first: Column) -> DataFrame:
    light(docs.sparkSession)
    return docs.select(*first, F.col("text").cast("string").alias("text"))


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, n: shingles of its set, keys, low: a byte of each minimum, fp: its SimHash) of each row; the empty set has no keys, as it only equals itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            node = pa.array(np.array([node_of(x) for x in sets], np.uint64).view(np.int64))
            least = [minima(x) for x in sets]
            keys = pa.array([band_keys(m).view(np.int64) if len(x) else [] for x, m in zip(sets, least, strict=True)], pa.list_(pa.int64()))
            low = pa.array([m.astype(np.uint8).tobytes() for m in least], pa.binary())
            fp = pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, pa.array([len(x) for x in sets], pa.int64()), keys, low, fp], ["doc_id", "text_hash", "node", "n", "keys", "low", "fp"])

    first = F.col("doc_id").cast("long").alias("doc_id"), text_hash()
    return _texts(docs, *first).mapInArrow(run, "doc_id long, text_hash long, node long, n long, keys array<long>, low binary, fp long")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, n, items: the set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 32):
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            node = pa.array(np.array([node_of(x) for x in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([node, pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "n", "items"])

    return _texts(docs).mapInArrow(run, "node long, n long, items array<long>")


def _parts(t: pa.Table, key: str) -> Iterator[pa.Table]:
    """The runs of equal ``key`` of a table sorted by it, one by one."""
    k = t.column(key).to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        yield t.slice(a, b - a)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column of lists, and where each list begins."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy()
    return lists.flatten().to_numpy(), np.cumsum(size) - size


def _starred(star: DataFrame, sets: DataFrame, name: str, most: int) -> DataFrame:
    """Links (u, v) between the rows of ``star`` (head, node) whose similarity is 0.8 or more: shared / (n + m - shared) >= 4 / 5.

    A head is dealt with its members to as many units as these have ``most`` shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "unit"):
            for t in _parts(table, "unit"):
                node, head = t.column("node").to_numpy(), t.column("head").to_numpy()
                items, at = _flat(t.column("items"))
                n = np.diff(np.append(at, len(items)))
                for h in np.unique(head).tolist():  # one, but for a chance clash of units
                    own = np.flatnonzero((head == h) & (node == h))[:1]
                    if not len(own):
                        continue
                    mine = np.sort(items[at[own[0]] : at[own[0]] + n[own[0]]])
                    place = np.minimum(np.searchsorted(mine, items), len(mine) - 1)
                    shared = np.add.reduceat((mine[place] == items).astype(np.int64), at)
                    near = (head == h) & (node != h) & (9 * shared >= 4 * (n + len(mine)))
                    if near.any():
                        yield pa.RecordBatch.from_arrays([pa.array(head[near]), pa.array(node[near])], ["u", "v"])

    units = saved(star.groupBy("head").agg(F.ceil(F.sum("n") / most).cast("int").alias("units")), "near-units")
    members = star.join(units, "head").select("head", "node", F.pmod(F.xxhash64("node"), F.col("units")).cast("int").alias("part"))
    heads = units.select("head", F.col("head").alias("node"), F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("part"))
    dealt = members.unionByName(heads).join(sets.select("node", "items"), "node").select(F.xxhash64("head", "part").alias("unit"), "head", "node", "items")
    return saved(dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long"), name)


def _blocked(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (key, node, blocks, ...) dealt to every pair of the blocks of their key: (key: of the pair, group: the key, ...)."""
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("block")
    wide = rows.select("key", "node", "blocks", *columns, block).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")
    return wide.select(pair, F.col("key").alias("group"), "node", *columns).repartition("key").sortWithinPartitions("key", "group", "node")


def _united(node: np.ndarray, n: np.ndarray, c: np.ndarray, near) -> tuple[list[int], list[int]]:
    """Index pairs that join components ``c`` of rows that are alike; ``near(i, at)`` tells those rows of ``at`` that row i is alike.

    Rows of one component are not compared, and a pair that would join what is joined is not told.
    """
    root, left, right = c.copy(), [], []
    for i in range(len(node) - 1):
        at = np.flatnonzero((root[i + 1 :] != root[i]) & (5 * np.minimum(n[i], n[i + 1 :]) >= 4 * np.maximum(n[i], n[i + 1 :]))) + i + 1
        if not len(at):
            continue
        at = near(i, at)
        if len(at):
            joined, first = np.unique(root[at], return_index=True)
            left += [i] * len(first)
            right += at[first].tolist()
            root[np.isin(root, joined)] = root[i]
    return left, right


def _alike(left: DataFrame) -> DataFrame:
    """(u, v): components whose nodes, in a bucket, have minima that don't rule out 0.8; enough of them to connect all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key"):
            for t in (x for y in _parts(table, "key") for x in _parts(y, "group")):
                node, n, c = (t.column(x).to_numpy() for x in ("node", "n", "c"))
                low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(len(node), -1)
                u, v = _united(node, n, c, lambda i, at: at[(low[at] == low[i]).sum(axis=1) >= LEAST_EQUAL])  # noqa: B023
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(c[u]), pa.array(c[v])], ["u", "v"])

    return _blocked(left, "n", "c", "low").mapInArrow(run, "u long, v long")


def _exact(rows: DataFrame) -> DataFrame:
    """(u, v): nodes of different components ``c`` of a key whose similarity is 0.8 or more, enough of them to connect all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key"):
            for t in (x for y in _parts(table, "key") for x in _parts(y, "group")):
                node, n, c = (t.column(x).to_numpy() for x in ("node", "n", "c"))
                items, begin = _flat(t.column("items"))
                every, at_item = np.unique(items, return_inverse=True)
                held = np.zeros(len(every), bool)

                def near(i: int, at: np.ndarray) -> np.ndarray:
                    own = at_item[begin[i] : begin[i] + n[i]]  # noqa: B023
                    held[own] = True  # noqa: B023
                    if 8 * len(at) < len(n):  # noqa: B023
                        shared = np.array([held[at_item[begin[j] : begin[j] + n[j]]].sum() for j in at.tolist()], np.int64)  # noqa: B023
                    else:
                        shared = np.add.reduceat(held[at_item].astype(np.int32), begin)[at]  # noqa: B023
                    held[own] = False  # noqa: B023
                    return at[9 * shared >= 4 * (n[i] + n[at])]  # noqa: B023

                u, v = _united(node, n, c, near)
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return _blocked(rows, "n", "c", "items").mapInArrow(run, "u long, v long")


def _printed(one: DataFrame) -> DataFrame:
    """(node, n, head, m): pairs of nodes whose fingerprints the pigeonring filter links, each fingerprint standing for its least node; with the numbers of shingles of both."""
    per = saved(one.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("of")).select("fp", F.col("of.node").alias("head"), F.col("of.n").alias("m")), "distinct-fingerprints")
    same = one.join(per, "fp").where("node <> head").select("node", "n", "head", "m")
    near = simhash.links(per.select("fp"))
    far = near.join(per.select(F.col("fp").alias("u"), F.col("head").alias("node"), F.col("m").alias("n")), "u").join(per.select(F.col("fp").alias("v"), "head", "m"), "v")
    return same.unionByName(far.select("node", "n", "head", "m"))


def _heads(one: DataFrame, bands: int = 16) -> DataFrame:
    """(key, head: its least node, m: shingles of that) of each band's key that several nodes have; by some bands at a time, as a task's table of keys grows with their number."""
    parts = []
    for k in range(0, BANDS, bands):
        wide = one.select(F.struct("node", "n").alias("of"), F.explode(F.slice("keys", k + 1, bands)).alias("key"))
        few = wide.groupBy("key").agg(F.count("*").alias("rows"), F.min("of").alias("of")).where("rows > 1").select("key", F.col("of.node").alias("head"), F.col("of.n").alias("m"))
        parts.append(saved(few, "near-heads"))
    return reduce(DataFrame.unionByName, parts)


def _met(one: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, n, low, shared: those of its keys that ``heads`` has, and some by chance) of the nodes that have any.

    Most keys are one node's only, and no table but the count of them is dealt out with them.
    """
    first, second = Bitmap(heads, F.col("key")).tester(), Bitmap(heads, F.shiftright("key", 32)).tester()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            keys = b.column(3).flatten().to_numpy().reshape(-1, BANDS)
            hit = first(keys) & second(keys >> 32)
            at = np.flatnonzero(hit.any(axis=1))
            ends = np.concatenate([[0], np.cumsum(hit[at].sum(axis=1))])
            shared = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[at][hit[at]]))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[:3]), shared], ["node", "n", "low", "shared"])

    rows = one.where("n > 0").select("node", "n", "low", "keys")
    return rows.mapInArrow(run, "node long, n long, low binary, shared array<long>")


def links(docs: DataFrame, of: DataFrame, most: int = 1000, shingles: int = 400_000, whole: int = 8) -> DataFrame:
    """(u, v): links between nodes, enough to connect every group of near copies.

    ``most``: sketches of a block; ``shingles``: of a block of sets; ``whole``: blocks up to which a cluster is taken as one.
    """
    one = saved(of.groupBy("node").agg(F.min(F.struct("n", "keys", "low", "fp")).alias("s"), F.min(F.struct("doc_id", "text_hash")).alias("at")).select("node", "s.*", "at"), "sets-of-shingles")
    heads = _heads(one)
    met = saved(_met(one, heads), "near-sketches")
    bucket = saved(met.select("node", "n", F.explode("shared").alias("key")).join(heads, "key"), "near-buckets")
    printed = saved(_printed(one.where("n > 0")), "near-fingerprints")
    nodes = saved(bucket.select("node").unionByName(printed.select(F.col("node"))).unionByName(printed.select(F.col("head").alias("node"))).distinct(), "near-nodes")
    rows = one.join(nodes, "node", "left_semi").select(F.xxhash64(F.coalesce("at.doc_id", F.lit(-1)), "at.text_hash").alias("row"))
    items = _sets(suspected(docs, Bitmap(rows, F.col("row")), row_key())).dropDuplicates(["node"]).join(nodes, "node", "left_semi")
    sets = saved(items, "near-sets")
    size = 5 * F.least("n", "m") >= 4 * F.greatest("n", "m")
    star = bucket.where("node <> head").select("node", "n", "head", "m").unionByName(printed).where(size).select("head", "node", "n").distinct()
    first = _starred(saved(star, "near-stars"), sets, "near-links", shingles)
    part = saved(components(first), "near-parts")
    left = bucket.where("node <> head").join(part, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    several = left.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("greatest"), F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("least <> greatest").select("key", "blocks")
    left = saved(left.join(several, "key"), "near-rest")
    alike = saved(_alike(left.join(met.select("node", "low"), "node")), "near-alike")
    cluster = saved(components(alike).select(F.col("node").alias("c"), F.col("component").alias("cluster")), "near-clusters")
    left = saved(left.drop("blocks").join(cluster, "c"), "near-clustered")
    blocks = F.ceil(F.sum("n") / shingles).cast("int").alias("blocks")
    # one unit of each cluster, or its buckets where it has many blocks
    members = left.select("cluster", "node", "n", "c").distinct()
    weight = saved(members.groupBy("cluster").agg(blocks), "near-weights")
    small, large = weight.where(F.col("blocks") <= whole), weight.where(F.col("blocks") > whole).select("cluster")
    units = members.join(small, "cluster").select(F.col("cluster").alias("key"), "node", "n", "c", "blocks")
    by_key = left.join(large, "cluster", "left_semi").select(F.xxhash64("cluster", "key").alias("key"), "node", "n", "c")
    units = units.unionByName(by_key.join(by_key.groupBy("key").agg(blocks), "key").select("key", "node", "n", "c", "blocks"))
    second = saved(_exact(units.join(sets.select("node", "items"), "node")), "near-links")
    return first.unionByName(second)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and component_id (the least doc_id of its group) for each row of ``docs``."""
    of = saved(_sketches(docs), "sketches")
    node = components(links(docs, of))
    least = of.groupBy("node").agg(F.min("doc_id").alias("least")).join(node, "node", "left")
    least = saved(least.select("node", "least", F.coalesce("component", "node").alias("component")), "near-groups")
    table = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return of.select("doc_id", "text_hash", "node").join(table, "node").select("doc_id", "text_hash", "component_id")


@any_names
def one_of_each(docs: DataFrame) -> DataFrame:
    """As ``simhash.one_of_each``, for groups of near copies by five-word shingles."""
    groups = grouped(docs)
    dropped = saved(groups.where("component_id is not null and (doc_id is null or doc_id <> component_id)").select("doc_id", "text_hash").distinct(), "near-copies")
    return without_rows(docs, dropped)
