"""The chunk store: versioned Parquet tables of chunks and page state, in buckets by address, merged on read.

A version is a small manifest that names, for each bucket, the folder that holds it, and the deltas since: folders of new
chunks, and of addresses whose older chunks are gone.  A write makes a delta of what it brings, in the buckets that it
touches, and no others; a delete writes addresses only.  A chunk is read unless a later delta has its place again or drops
its page.  A bucket of more than ``most_deltas`` deltas is written anew with the next version, as ``compact`` does.  Page
state, which is small, is written anew bucket by bucket.

The manifest of the next number must not exist yet: readers see all of a write or none, a write that fails leaves the old
version in place, and of two writers at a time the later one starts again from what the earlier one left.  Folders are
never changed once a manifest names them; ``vacuum`` removes those that no recent one names.  The number of buckets
follows the number of rows.  A stream's batch is marked in the version that it makes, so that it is taken once.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvid.operators import live, search

CHUNKS = "id string, product string, title string, section string, source_url string, chunk_index int, content string, version string, content_hash string, embedding array<float>, created_at timestamp, updated_at timestamp"
STATE = "url string, page_hash string, last_crawled timestamp, chunk_count int"
KEY = ("source_url", "chunk_index")


def chunk_id():
    """The same chunk place has the same id in every run."""
    return F.sha2(F.concat_ws("\u0001", "source_url", F.col("chunk_index").cast("string")), 256)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with ``new`` put in: a row of the same key keeps its id and its creation time, all else is replaced.

    Of repeated keys within ``new`` the greatest row stays, so the outcome doesn't depend on their order.
    """
    fresh = put(old, new)
    kept = old.join(fresh.select(*KEY), list(KEY), "left_anti")
    return kept.select(old.columns).unionByName(fresh)


def put(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that ``new`` puts in the place of those of ``old``; see ``merged``."""
    return settled(offered(old, new)).select(old.columns)


def offered(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new``, and what a row keeps of the one in ``old`` that it replaces, as one table for ``settled``."""
    columns = [c for c in old.columns if c not in ("id", "created_at", "updated_at", *KEY)]
    fresh = new.select(*KEY, F.struct(*[F.col(c) for c in columns]).alias("_row"), F.lit(True).alias("_new"))
    before = old.dropna(subset=list(KEY)).select(*KEY, F.col("id").alias("_id"), F.col("created_at").alias("_created"))
    return fresh.unionByName(before, allowMissingColumns=True)


def settled(offers: DataFrame, *by: str) -> DataFrame:
    """One row for each new key of ``offers``.  Rows that lie together by the columns ``by`` are not moved again."""
    now = F.current_timestamp()
    one = offers.groupBy(*by, *KEY).agg(*(F.max(c).alias(c) for c in ("_row", "_new", "_id", "_created"))).where("_new")
    return one.select(*by, F.coalesce("_id", chunk_id()).alias("id"), *KEY, "_row.*", F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"))


def alive(rows: DataFrame, *by: str) -> DataFrame:
    """As ``Store.live``, of chunks and drops (``_gone``) in one table.  Rows that lie together by the columns ``by`` are not moved again."""
    known = lambda kept: F.col("source_url").isNull() | F.coalesce(kept, F.lit(True))
    page, last = W.partitionBy(*by, "source_url"), F.col("_seq") >= F.col("_last")
    newest = rows.withColumn("_last", F.max("_seq").over(W.partitionBy(*by, *KEY))).where(known(last))
    left = newest.withColumn("_last", F.max(F.when(F.col("chunk_index").isNull(), F.col("_seq"))).over(page)).where(known(last))
    return left.where(F.col("_gone").isNull()).drop("_last", "_seq", "_gone")


def replaced(old: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """``old`` without any chunk of ``pages`` (url), and with ``new``."""
    now = F.current_timestamp()
    kept = old.join(pages.select(F.col("url").alias("source_url")).distinct(), "source_url", "left_anti").select(old.columns)
    return kept.unionByName(new.withColumns({"id": chunk_id(), "created_at": now, "updated_at": now}).select(old.columns))


def changed(pages: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Pages that are new or whose hash differs from the stored one; all of them by ``force``."""
    if force:
        return pages
    known = state.select(F.col("url").alias("_url"), F.col("page_hash").alias("_hash"))
    return pages.join(known, (pages["url"] == F.col("_url")) & (pages["content_hash"] == F.col("_hash")), "left_anti")


def state_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Page state with ``new`` (url, page_hash, chunk_count) put in, crawled now."""
    kept = old.join(new.select("url"), "url", "left_anti")
    return kept.select("url", "page_hash", "last_crawled", "chunk_count").unionByName(new.select("url", "page_hash", F.current_timestamp().alias("last_crawled"), F.col("chunk_count").cast("int").alias("chunk_count")))


class Conflict(RuntimeError):
    """Other writers were always faster."""


class Store:
    def __init__(self, spark: SparkSession, path: str, dimensions: int = 768, buckets: int = 8, most_rows: int = 200_000, most_deltas: int = 8):
        """``most_rows``: chunks of a bucket, on average, above which there are more; ``most_deltas``: of a bucket, before it is written anew."""
        self.spark, self.path, self.most_rows, self.most_deltas = spark, path.rstrip("/"), most_rows, most_deltas
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        if self._newest() is None:
            self._publish({"version": 0, "dimensions": dimensions, "buckets": buckets, "chunks": {}, "state": {}, "deltas": [], "batches": {}, "index": None})

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        p = self._at("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _newest(self) -> int | None:
        return max(self._versions(), default=None)

    def _manifest(self, version: int | None = None) -> dict:
        """Read by the file system, without a Spark job."""
        stream = self._fs.open(self._at(f"versions/{self._newest() if version is None else version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest became the version of its number; not if another one has."""
        new, final = self._at(f"versions/.next-{uuid.uuid4().hex}"), self._at(f"versions/{manifest['version']:012d}.json")
        out = self._fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(files.makeQualified(new), files.makeQualified(final), kinds)
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    @property
    def version(self) -> int:
        return self._newest()

    @property
    def dimensions(self) -> int:
        return self._manifest()["dimensions"]

    def _folders(self, name: str, schema: str, seqs: dict[str, int], paths: list[str]) -> DataFrame:
        """The rows of some folders of buckets, with the number ``_seq`` of the version that wrote them."""
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, _seq int")
        read = self.spark.read.schema(f"{schema}, tag string, bucket int").option("basePath", f"{self.path}/{name}").parquet(*paths)
        return read.select(*_names(schema), self.seq_of(seqs).alias("_seq"))

    @staticmethod
    def seq_of(seqs: dict[str, int]):
        return F.element_at(F.create_map(*(F.lit(x) for kv in sorted(seqs.items()) for x in kv)), F.col("tag")).cast("int")

    def _every(self, name: str, m: dict, only: set[int] | None) -> DataFrame:
        """The rows of a version, or of some of its buckets; chunks with those that a later delta replaces or drops."""
        seqs = {x["tag"]: 0 for x in m[name].values()}
        paths = [f"{self.path}/{name}/tag={x['tag']}/bucket={b}" for b, x in sorted(m[name].items()) if only is None or int(b) in only]
        if name == "state":
            return self._folders(name, STATE, seqs, paths)
        for d in m["deltas"]:
            paths += [f"{self.path}/chunks/tag={d['tag']}/bucket={b}" for b in d["chunks"] if only is None or int(b) in only]
            seqs[d["tag"]] = d["seq"]
        return self._folders(name, CHUNKS, seqs, paths)

    def _gone(self, m: dict, only: set[int] | None) -> DataFrame:
        """What deltas drop of a version, or of some of its buckets."""
        paths = [f"{self.path}/drops/tag={d['tag']}/bucket={b}" for d in m["deltas"] for b in d["drops"] if only is None or int(b) in only]
        return self._folders("drops", "source_url string, chunk_index int", {d["tag"]: d["seq"] for d in m["deltas"]}, paths)

    def _read(self, name: str, manifest: dict | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        m = manifest or self._manifest()
        rows = self._every(name, m, only)
        return (self.live(rows, m, only) if name == "chunks" else rows).drop("_seq")

    def live(self, rows: DataFrame, m: dict, only: set[int] | None = None) -> DataFrame:
        """``rows`` (source_url, chunk_index, _seq, ...) that no later delta replaces or drops."""
        later = [d for d in m["deltas"] if any(only is None or int(b) in only for kind in ("chunks", "drops") for b in d[kind])]
        if not later:
            return rows
        seqs, seen = {d["tag"]: d["seq"] for d in later}, lambda b: only is None or int(b) in only
        again = self._folders("chunks", "source_url string, chunk_index int", seqs, [f"{self.path}/chunks/tag={d['tag']}/bucket={b}" for d in later for b in d["chunks"] if seen(b)])
        after = again.unionByName(self._gone(m, only)).groupBy("source_url", "chunk_index").agg(F.max("_seq").alias("_last"))
        after = after.select(F.col("source_url").alias("_url"), F.col("chunk_index").alias("_index"), "_last")
        match = (F.col("source_url") == F.col("_url")) & (F.col("_index").isNull() | (F.col("_index") == F.col("chunk_index"))) & (F.col("_last") > F.col("_seq"))
        return rows.join(after, match, "left_anti")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def state(self) -> DataFrame:
        return self._read("state")

    def page_hash(self, url: str) -> str | None:
        m = self._manifest()
        mine = self._buckets(self.spark.createDataFrame([(url,)], "url string"), "url", m["buckets"])
        r = self._read("state", m, mine).where(F.col("url") == url).select("page_hash").first()
        return r[0] if r else None

    def crawled(self) -> DataFrame:
        """All page state, newest first."""
        return self.state().orderBy(F.desc("last_crawled"), "url")

    def _buckets(self, rows: DataFrame, address: str, n: int) -> set[int]:
        return {r[0] for r in rows.select(_bucket(F.col(address), n)).distinct().collect()}

    def changed(self, pages: DataFrame, force: bool = False) -> DataFrame:
        """As the function of this name, against the state of those buckets that ``pages`` fall in."""
        if force:
            return pages
        m = self._manifest()
        return changed(pages, self._read("state", m, self._buckets(pages, "url", m["buckets"])))

    def find(self, content_hash: str) -> DataFrame:
        """The chunks of a content; a Bloom filter in each file tells whether it can hold it."""
        return self.chunks().where(F.col("content_hash") == content_hash)

    def _written(self, name: str, rows: DataFrame, address: str, n: int, tag: str | None = None, settle=None) -> dict[str, dict]:
        """``rows`` as new folders, one a bucket, sorted by address for pruning; chunks within it by product.

        Each row moves once, to the task of its bucket.  ``settle`` makes of the rows there (with ``bucket``) those to write.
        """
        tag = tag or uuid.uuid4().hex[:12]
        parts = ["bucket", "product"] if name == "chunks" else ["bucket"]
        order = [*parts, *(KEY if name == "chunks" else (address,))]
        path = f"{self.path}/{name}/tag={tag}"
        dealt = rows.withColumn("bucket", _bucket(F.col(address), n)).repartitionById(n, "bucket")
        out = (settle(dealt) if settle else dealt).sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy(*parts)
        out = out.option("parquet.bloom.filter.adaptive.enabled", "true")  # a filter has the least size that its values need, of 1 KB to 1 MB
        for column in ("content_hash", "source_url") if name == "chunks" else ():
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.candidates.number#{column}", "11")
        out.parquet(path)
        held = self.spark.read.schema("bucket int").option("basePath", path).parquet(path) if self._fs.globStatus(self._at(f"{name}/tag={tag}/bucket=*")) else None
        return {str(r["bucket"]): {"tag": tag, "rows": r["count"]} for r in held.groupBy("bucket").count().collect()} if held is not None else {}

    def _change(self, make, attempts: int = 20) -> bool:
        """Write the next version: ``make`` gives what is new in the manifest that it is given, or None for no change; whether there was one.

        When another writer was faster, all is made anew from what it left.
        """
        for _ in range(attempts):
            old = self._manifest()
            new = make(old)
            if new is None:
                return False
            if self._publish(self._tidied({**old, **new, "version": old["version"] + 1})):
                return True
        raise Conflict(f"version {old['version'] + 1} of {self.path}")

    def _tidied(self, m: dict) -> dict:
        """The manifest with more buckets, or with buckets written anew, where it is time for that."""
        rows = sum(x["rows"] for x in m["chunks"].values()) + sum(n for d in m["deltas"] for n in d["chunks"].values())
        more = m["buckets"]
        while rows > self.most_rows * more:
            more *= 2
        if more > m["buckets"]:
            return self._compacted(m, None, more)
        often = Counter(b for d in m["deltas"] for b in {*d["chunks"], *d["drops"]})
        full = {int(b) for b, n in often.items() if n > self.most_deltas}
        return self._compacted(m, full) if full else m

    def _compacted(self, m: dict, only: set[int] | None, buckets: int | None = None) -> dict:
        """The manifest with some buckets, or all, written anew without deltas."""
        if m["index"]:
            m = {**m, "index": live.purged(self, m, only)}
        n = buckets or m["buckets"]
        every = self._every("chunks", m, only).unionByName(self._gone(m, only).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        made = self._written("chunks", every, "source_url", n, settle=lambda rows: alive(rows, "bucket"))
        kept = {b: x for b, x in m["chunks"].items() if only is not None and int(b) not in only}
        left = lambda part: {b: k for b, k in part.items() if only is not None and int(b) not in only}
        deltas = [{**d, "chunks": left(d["chunks"]), "drops": left(d["drops"])} for d in m["deltas"]]
        new = {**m, "chunks": kept | made, "deltas": [d for d in deltas if d["chunks"] or d["drops"]]}
        return {**new, "buckets": n, "state": self._written("state", self._read("state", m), "url", n)} if n != m["buckets"] else new

    def compact(self) -> bool:
        """Write all buckets that have deltas anew; whether there were any."""
        return self._change(lambda m: self._compacted(m, {int(b) for d in m["deltas"] for b in {*d["chunks"], *d["drops"]}}) if m["deltas"] else None)

    def _delta(self, m: dict, put: DataFrame | None, drops: DataFrame | None, settle=None) -> dict:
        """What a delta of new chunks and of dropped pages (source_url) changes in the manifest.  A first write, which is no delta, has buckets by its rows.

        ``settle``: see ``_written``; it leaves one chunk a key.
        """
        if put is not None and not m["chunks"] and not m["deltas"]:
            n = m["buckets"]
            rows = (put.select(*KEY).distinct() if settle else put).count()
            while rows > self.most_rows * n:
                n *= 2
            state = {"state": self._written("state", self._read("state", m), "url", n)} if n != m["buckets"] and m["state"] else {}
            new = {"chunks": self._written("chunks", put, "source_url", n, settle=settle), "buckets": n, **state}
            return new | {"index": live.added(self, {**m, **new}, self._read("chunks", {**m, **new}), 0)} if m["index"] else new
        tag, seq, n = uuid.uuid4().hex[:12], m["version"] + 1, m["buckets"]
        count = lambda made: {b: x["rows"] for b, x in made.items()}
        chunks = count(self._written("chunks", put, "source_url", n, tag, settle)) if put is not None else {}
        gone = drops.select("source_url", F.lit(None).cast("int").alias("chunk_index")).distinct() if drops is not None else None
        dropped = count(self._written("drops", gone, "source_url", n, tag)) if gone is not None else {}
        new = {"deltas": [*m["deltas"], {"tag": tag, "seq": seq, "chunks": chunks, "drops": dropped}]}
        if m["index"] and chunks:
            stored = self._folders("chunks", CHUNKS, {tag: seq}, [f"{self.path}/chunks/tag={tag}/bucket={b}" for b in chunks])
            new["index"] = live.added(self, {**m, **new}, stored, seq)
        return new

    def _state(self, m: dict, rows: DataFrame) -> dict[str, dict]:
        """The state's folders with ``rows`` (url, page_hash, chunk_count) put in."""
        touched = self._buckets(rows, "url", m["buckets"])
        made = self._written("state", state_merged(self._read("state", m, touched), rows), "url", m["buckets"])
        return {b: x for b, x in m["state"].items() if int(b) not in touched} | made

    def upsert(self, chunks: DataFrame) -> None:
        if chunks.isEmpty():
            return

        def make(m: dict) -> dict:
            touched = self._buckets(chunks, "source_url", m["buckets"])
            one = lambda rows: settled(rows, "bucket").select(*_names(CHUNKS), "bucket")
            return self._delta(m, offered(self._read("chunks", m, touched), chunks), None, one)

        self._change(make)

    def put_state(self, rows: DataFrame) -> None:
        """Set the state of pages (url, page_hash, chunk_count)."""
        self._change(lambda m: {"state": self._state(m, rows)})

    def replace_pages(self, chunks: DataFrame | None, pages: DataFrame | None, batch: tuple[str, int] | None = None) -> bool:
        """All chunks of ``pages`` (url, content_hash) replaced and their state set, in one version; whether there was one.

        A page without chunks stays as it was.  With a ``batch`` (stream, number) the version also marks it, and a batch
        that is marked changes nothing; without chunks that mark is all.
        """

        def make(m: dict) -> dict | None:
            if batch and batch[1] <= m["batches"].get(batch[0], -1):
                return None
            mark = {"batches": {**m["batches"], batch[0]: batch[1]}} if batch else {}
            if chunks is None:
                return mark or None
            counts = chunks.groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("chunk_count"))
            done = pages.select("url", F.col("content_hash").alias("page_hash")).join(counts, "url")
            now = F.current_timestamp()
            new = chunks.withColumns({"id": chunk_id(), "created_at": now, "updated_at": now})
            out = self._delta(m, new.select(*_names(CHUNKS)), done.select(F.col("url").alias("source_url")))
            return out | {"state": self._state({**m, **out}, done)} | mark

        return self._change(make)

    def taken(self, batch: tuple[str, int]) -> bool:
        """Whether a stream's batch is in the store already."""
        return batch[1] <= self._manifest()["batches"].get(batch[0], -1)

    def delete(self, url: str) -> int:
        """Drop a page's chunks; how many there were.  No chunk is written for it."""
        page = self.spark.createDataFrame([(url,)], "source_url string")
        m = self._manifest()
        gone = self._read("chunks", m, self._buckets(page, "source_url", m["buckets"])).where(F.col("source_url") == url).count()
        if gone:
            self._change(lambda m: self._delta(m, None, page))
        return gone

    def set_page_hash(self, url: str, page_hash: str, count: int) -> None:
        self.put_state(self.spark.createDataFrame([(url, page_hash, count)], "url string, page_hash string, chunk_count int"))

    def build_index(self, lists: int = 100, **options) -> None:
        """Give the store an exact index of cells, which each write keeps up from then on; not while it has no vectors."""
        self._change(lambda m: (made := live.built(self, m, lists, **options)) and {"index": made})

    def nearest(self, vector, limit: int = 10, product: str | None = None, min_score: float | None = None) -> DataFrame:
        """The chunks most similar to a vector, with their score: through the index where there is one, else over all."""
        m = self._manifest()
        if m["index"]:
            return live.nearest(self, m, vector, limit, product, min_score)
        return search.nearest(self._read("chunks", m), vector, limit, product, min_score)

    def counts(self) -> DataFrame:
        return counts(self.chunks())

    def stats(self) -> dict:
        by = {r.product: r.n for r in self.counts().collect()}
        return {"total_chunks": sum(by.values()), "by_product": by}

    def migrate(self, dimensions: int) -> bool:
        """A store of another vector size loses its vectors, which are then made anew; whether that was so.

        Page state goes as well, so that the next ingest makes all pages anew.
        """
        if dimensions == self.dimensions:
            return False

        def make(m: dict) -> dict:
            bare = self._read("chunks", m).withColumn("embedding", F.lit(None).cast("array<float>"))
            return {"dimensions": dimensions, "chunks": self._written("chunks", bare, "source_url", m["buckets"]), "deltas": [], "state": {}, "index": None}

        return self._change(make)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions and the folders that only they name; how many folders.  No write may be under way."""
        versions = self._versions()
        used = set()
        for v in versions[-keep:]:
            m = self._manifest(v)
            used |= {(name, x["tag"]) for name in ("chunks", "state") for x in m[name].values()}
            used |= {(name, d["tag"]) for d in m["deltas"] for name in ("chunks", "drops") if d[name]}
            if m["index"]:
                used |= {("index", x["tag"]) for parts in m["index"]["cells"].values() for x in parts} | {("centroids", m["index"]["centroids"])}
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"versions/{v:012d}.json"), False)
        gone = 0
        for name in ("chunks", "state", "drops", "index", "centroids"):
            folders = self._fs.listStatus(self._at(name)) if self._fs.exists(self._at(name)) else []
            for f in folders:
                tag = f.getPath().getName().removeprefix("tag=")
                if (name, tag) not in used:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone

    def check(self) -> bool:
        return self.spark.sql("select 1").first()[0] == 1 and self._newest() is not None


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _bucket(address, n: int):
    return F.pmod(F.xxhash64(address), F.lit(n)).cast("int").alias("bucket")


def counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("product").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product")
