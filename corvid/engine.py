"""The engine: ingest, search, guided and concept lookups, products and statistics."""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvid.config import Settings
from corvid.functions.text import doc_url
from corvid.operators import embed, search
from corvid.operators.ingest import COUNTS, ingest, ingested
from corvid.operators.store import Store
from corvid.sources import web
from corvid.streaming.incremental import run_available
from corvid.tables import Staged, shared_folder

# The bounds of a limit, and the numbers of results of a search, a guide and an explanation.
LEAST, MOST = 1, 20
DEFAULT, GUIDE, EXPLAIN = 5, 5, 8
EMPTY = "Nothing found. The store may be empty: run the crawl command first."
NOTE = "Full pages are at the source_url of each entry."
PRODUCT = "id string, name string, base_url string, sitemap_url string, description string, version string, git_source struct<owner: string, repo: string, branch: string, docs_path: string>"


@dataclass(frozen=True)
class Product:
    """A documentation source.  With ``git_source`` (owner, repo, branch, docs_path) its Markdown files are read, else its web pages."""

    id: str
    name: str
    base_url: str
    sitemap_url: str = ""
    description: str = ""
    version: str | None = None
    git_source: tuple[str, str, str, str] | None = None


class Engine:
    def __init__(self, spark: SparkSession, products: Sequence[Product], settings: Settings = Settings(), provider: embed.Provider | None = None):
        settings = replace(settings, store_path=settings.store_path or f"{shared_folder(spark)}/corvid-store")
        self.spark, self.settings = spark, settings
        self.by_id = {p.id: p for p in products}
        self.provider = (provider or embed.provider(settings.provider, dimensions=settings.dimensions, **settings.provider_options())).resolved()
        self.store = Store(spark, settings.store_path, self.provider.dimensions)
        self.cache = search.Cache(settings.cache_entries, settings.cache_seconds)

    def products(self) -> DataFrame:
        rows = [(p.id, p.name, p.base_url, p.sitemap_url, p.description, p.version, p.git_source) for p in self.by_id.values()]
        return self.spark.createDataFrame(rows, PRODUCT).select("id", "name", "description", "base_url", "version")

    def _check(self, text: str, product: str | None = None, limit: int = DEFAULT) -> None:
        if not isinstance(text, str) or not text:
            raise ValueError("the text asked for must not be empty")
        if product is not None and product not in self.by_id:
            raise ValueError(f"unknown product {product!r}")
        if isinstance(limit, bool) or not isinstance(limit, int) or not LEAST <= limit <= MOST:
            raise ValueError(f"limit must be a whole number from {LEAST} to {MOST}")

    def similar(self, vector: Sequence[float], limit: int | None = None, product: str | None = None, min_score: float | None = None) -> list:
        """Rows most similar to a vector.  Kept by the whole question and the store's version, so a write makes old answers unreachable."""
        limit = limit or self.settings.top_k
        key = (self.store.version, tuple(vector), product, limit, min_score)
        found = self.cache.get(key)
        if found is None:
            found = self.store.nearest(vector, limit, product, min_score).select(*search.RESULT).collect()
            self.cache.set(key, found)
        return found

    def _ask(self, text: str, limit: int, product: str | None = None) -> DataFrame:
        rows = self.similar(self.provider.embed([text])[0], limit, product)
        schema = "id string, product string, title string, section string, source_url string, chunk_index int, content string, version string, score double"
        return search.results(self.spark.createDataFrame(rows, schema))

    def search(self, query: str, product: str | None = None, limit: int = DEFAULT) -> DataFrame:
        self._check(query, product, limit)
        return self._ask(query, limit, product)

    def guide(self, topic: str, product: str) -> DataFrame:
        self._check(topic, product)
        return self._ask(f"{self.by_id[product].name}: {topic}", GUIDE, product)

    def explain(self, concept: str) -> DataFrame:
        self._check(concept)
        return self._ask(concept, EXPLAIN)

    def _product(self, product: str) -> Product:
        if product not in self.by_id:
            raise ValueError(f"unknown product {product!r}")
        return self.by_id[product]

    def _limited(self, pages: DataFrame, product: str | None, limit: int | None) -> DataFrame:
        if product is not None:
            pages = pages.where(pages["product"] == self._product(product).id)
        return web.first_n(pages, limit, "ordinal").drop("ordinal") if limit else pages

    def ingest(self, pages: DataFrame, product: str | None = None, limit: int | None = None, force: bool = False) -> dict:
        """Bring ``pages`` (url, product, version, content_hash, html or markdown; ordinal if ``limit`` is given) into the store."""
        return ingest(self._limited(pages, product, limit), self.store, self.provider, self.settings, force)

    def ingested(self, pages: DataFrame, product: str | None = None, limit: int | None = None, force: bool = False) -> DataFrame:
        """As ``ingest``, and what was done as a table, one row a product."""
        return ingested(self._limited(pages, product, limit), self.store, self.provider, self.settings, force)

    def _fetching(self) -> dict:
        return {"retries": self.settings.fetch_retries, "delay": self.settings.fetch_delay, "partitions": self.settings.fetch_partitions}

    def web_pages(self, p: Product, keep: Staged, limit: int | None = None) -> DataFrame:
        """A product's web pages: those of its sitemap, or else those that a walk over links finds; with an error each that could not be read.

        A sitemap of which any file could not be read, be it a nested one, counts as none, and as an error.  A site of
        which there is neither a sitemap nor a page can't be listed.
        """
        site, get = p.base_url, self._fetching()
        start = p.sitemap_url or "/".join(site.split("/")[:3]) + "/sitemap.xml"
        maps = web.fetched_sitemaps(self.spark, start, keep, **get)
        listed = keep(web.sitemap_urls(maps.where("xml is not null"), start), "listed")
        unread = maps.where("error is not null").select("url", F.col("xml").alias("body"), "error")
        if listed.isEmpty() or not unread.isEmpty():
            found = web.walked(self.spark, site, keep, self.settings.most_links, **get)
            if found.isEmpty() and unread.isEmpty():
                raise OSError(f"{site}: neither a sitemap nor a page")
            lost = found.where("error is not null").select("url", "body", "error").unionByName(unread)
            got = web.first_n(found.where("error is null"), limit, "ordinal").select("url", "body", "error").unionByName(lost)
        else:
            urls = web.first_n(web.filter_urls(listed, site, "ordinal"), limit, "ordinal")
            got = keep(web.fetched(urls.select("url"), **get), "fetched-pages")
        got = got.where("error is not null or body <> ''")
        return got.select("url", F.lit(p.id).alias("product"), F.lit(p.version).cast("string").alias("version"), F.sha2("body", 256).alias("content_hash"), F.col("body").alias("html"), "error")

    def repository_files(self, p: Product, keep: Staged, limit: int | None = None) -> DataFrame:
        """A product's Markdown files, by the tree listing of its repository; with an error each that could not be read."""
        owner, repo, branch, root = p.git_source
        s, get = self.settings, self._fetching()
        listing = f"{s.git_api}/repos/{owner}/{repo}/git/trees/{branch}?recursive=1"
        tree = keep(web.fetched(self.spark.createDataFrame([(listing,)], "url string"), **get), "tree-listing")
        error = tree.first()
        if error["body"] is None:
            raise OSError(f"{listing}: {error['error'] or 'gone'}")
        parsed = tree.select(F.from_json("body", "tree array<struct<path: string, type: string>>").alias("t")).select("t.tree")
        paths = web.first_n(web.tree_files(parsed, root), limit, "pos")
        raw = F.concat(F.lit(f"{s.git_raw}/{owner}/{repo}/{branch}/"), "path").alias("url")
        got = keep(web.fetched(paths.select(raw, "path"), **get), "fetched-files").withColumnRenamed("body", "markdown")
        fine = web.sized(got.where("error is null"))
        files = fine.unionByName(got.where("error is not null").withColumn("content_hash", F.lit(None).cast("string")))
        url = doc_url(F.col("path"), root, p.base_url)
        return files.select(url.alias("url"), F.col("path").alias("file_path"), F.lit(p.id).alias("product"), F.lit(p.version).cast("string").alias("version"), "content_hash", "markdown", "error")

    def crawl(self, product: str | None = None, limit: int | None = None, force: bool = False) -> dict:
        """Fetch one product, or all, and bring what changed into the store; ``limit`` is of pages for each product.

        A product whose source can't be listed counts one error and does not stop the others.  Where there are errors,
        ``reason`` is one of them.
        """
        out = {}
        for p in [self._product(product)] if product is not None else self.by_id.values():
            with Staged(self.spark) as keep:
                try:
                    pages = self.repository_files(p, keep, limit) if p.git_source else self.web_pages(p, keep, limit)
                except OSError as e:
                    out[p.id] = dict.fromkeys(COUNTS, 0) | {"errors": 1, "reason": str(e)}
                    continue
                done = ingest(pages, self.store, self.provider, self.settings, force)
                out[p.id] = {n: done[n] for n in COUNTS}
                if done["errors"]:
                    out[p.id]["reason"] = pages.where("error is not null").agg(F.min(F.concat_ws(": ", "url", "error"))).first()[0]
        return {n: sum(r[n] for r in out.values()) for n in COUNTS} | {"by_product": out}

    def reindex(self, product: str | None = None, limit: int | None = None) -> dict:
        """What a scheduled run does: ``crawl`` of all products, unchanged pages left as they are."""
        return self.crawl(product, limit)

    def reindex_daily(self, hour: int = 2, minute: int = 0, times: int | None = None, now: Callable = datetime.datetime.now, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
        """``reindex`` each day at a time of day, ``times`` times or for good.  A run that fails is reported and does not end the schedule."""
        done: list[dict] = []
        while times is None or len(done) < times:
            at = now()
            due = at.replace(hour=hour, minute=minute, second=0, microsecond=0)
            sleep(((due if due > at else due + datetime.timedelta(days=1)) - at).total_seconds())
            try:
                result = self.reindex()
            except Exception as e:  # noqa: BLE001 - the next day's run may succeed
                result = {"failed": str(e)}
            done = [*done, result] if times is not None else []
        return done

    def follow(self, folder: str, schema: str, checkpoint: str, only: str = "*", prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Ingest what has come to a folder of page files since the last call, each batch once.

        ``prepare`` makes pages of the files' rows.  A batch is marked in the version that it makes; one that comes again, as
        after a failure between that version and the stream's own note of it, changes nothing.
        """

        def take(rows: DataFrame, number: int) -> None:
            batch = (checkpoint, number)
            if not self.store.taken(batch):
                ingest(prepare(rows), self.store, self.provider, self.settings, batch=batch)

        run_available(self.spark, folder, schema, checkpoint, take, only=only)

    def migrate(self) -> bool:
        return self.store.migrate(self.provider.dimensions)

    def index(self, lists: int | None = None) -> None:
        """Give the store an index of ``lists`` cells; searches are exact with it and without."""
        self.store.build_index(lists or self.settings.lists)

    def stats(self) -> dict:
        return self.store.stats()


def as_json(rows: DataFrame, concept: str | None = None, empty: str = EMPTY) -> str:
    """A bounded result as indented JSON; nulls are left out.  An empty one is a sentence that says what to do."""
    out = [{k: v for k, v in r.asDict().items() if v is not None} for r in rows.limit(MOST).collect()]
    if not out:
        return empty
    return json.dumps({"concept": concept, "context": out, "note": NOTE} if concept is not None else out, indent=2, ensure_ascii=False)
