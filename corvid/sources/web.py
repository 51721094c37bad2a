"""Where pages and files come from: address filters, sitemaps, link graphs, tree listings, folders and HTTP."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corvid.functions.text import doc_url, trim, units
from corvid.operators import html
from corvid.tables import Staged, fresh, numbered

# What is no documentation.
SKIPPED_PARTS = ("/assets/", "/images/", "/img/", "/static/", "/includes/", "/overrides/", "/theme/", "/apis/", "page-not-found", "index.md")
SKIPPED_ENDS = (".pdf", ".zip")
LEAST_FILE = 50
GONE = {403, 404, 410}
# How much fetched text a task gathers, and the addresses of a sitemap file, which may have 50,000.
HELD = 1 << 20
MAP = 10_000


def wanted_url(url: Column, base_url: str) -> Column:
    low = F.lower(url)
    return low.startswith(base_url.lower()) & ~low.endswith(SKIPPED_ENDS[0]) & ~low.endswith(SKIPPED_ENDS[1]) & ~low.contains("/assets/") & ~low.contains("/images/")


def filter_urls(urls: DataFrame, base_url: str, order: str | None = None) -> DataFrame:
    """Each wanted address once; with ``order``, where it was first seen."""
    kept = urls.where(wanted_url(F.col("url"), base_url))
    return kept.groupBy("url").agg(F.min(order).alias(order)) if order else kept.select("url").distinct()


def first_n(rows: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first ``n`` rows of a listing by its ordinal; all of them without a limit."""
    return rows.orderBy(order).limit(n) if n else rows


def _located(of: str) -> Column:
    """Trimmed, non-empty addresses directly in elements of that name; patterns, since real files are not always well-formed."""
    parts = F.regexp_extract_all("xml", F.lit(f"(?is)<{of}(?:\\s[^>]*)?>(.*?)</{of}\\s*>"), F.lit(1))
    loc = "(?is)<loc(?:\\s[^>]*)?>(?:\\s*<!\\[CDATA\\[)?(.*?)(?:\\]\\]>\\s*)?</loc\\s*>"
    inner = F.transform(parts, lambda x: F.regexp_extract(x, loc, 1))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        inner = F.transform(inner, lambda x: F.replace(x, F.lit(entity), F.lit(sign)))  # noqa: B023 - called at once
    return F.filter(F.transform(inner, trim), lambda x: x != "")


def named_maps(maps: DataFrame) -> DataFrame:
    """Addresses of the sitemaps that sitemap files (url, xml) name."""
    return maps.where("xml is not null").select(F.explode(_located("sitemap")).alias("url")).distinct()


def sitemap_urls(maps: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """(url, ordinal) that the sitemap at address ``start`` lists, by way of its index files, ``depth`` levels deep.

    ``maps`` (url, xml) holds the fetched sitemap files.  A file that names further sitemaps counts as an index only.
    """
    read = maps.select("url", _located("sitemap").alias("nested"), _located("url").alias("pages"))
    level = read.sparkSession.createDataFrame([(start, "")], "at string, path string")
    out = None
    for _ in range(depth):
        here = level.join(read, level["at"] == read["url"]).select("path", "nested", "pages")
        found = here.where(F.size("nested") == 0).select("path", F.posexplode("pages").alias("n", "url"))
        found = found.select("url", F.concat("path", F.format_string("%010d", "n")).alias("ordinal"))
        out = found if out is None else out.unionByName(found)
        level = here.select("path", F.posexplode("nested").alias("n", "at")).select("at", F.concat("path", F.format_string("%010d/", "n")).alias("path"))
    return out


def discovered(maps: DataFrame, start: str, base_url: str, links: DataFrame, most: int = 500) -> DataFrame:
    """Addresses of the sitemap, filtered; if it has none at all, those reachable by links, unfiltered."""
    listed = sitemap_urls(maps, start)
    if listed.isEmpty():
        return reachable(links, base_url, most).select("url", F.col("ordinal").cast("string").alias("ordinal"))
    return filter_urls(listed, base_url, "ordinal")


def followed(links: DataFrame, start: str) -> DataFrame:
    """The links (src, pos, dst) that a walk from ``start`` follows: to the same origin, and to no archive."""
    origin = "/".join(start.split("/")[:3])
    return links.where(F.col("dst").startswith(origin) & ~F.col("dst").endswith(SKIPPED_ENDS[0]) & ~F.col("dst").endswith(SKIPPED_ENDS[1]))


def reachable(links: DataFrame, start: str, most: int | None = 500) -> DataFrame:
    """(url, ordinal): pages reachable from ``start`` over ``links`` (src, pos, dst), breadth first, the first ``most`` if given.

    Every page with a row in ``links`` as src exists; others can't be read, and are left out before anything is counted.
    A level is a join with the level before and an anti-join with what was seen, each a table in the shared folder.
    """
    spark = links.sparkSession
    path = fresh(spark, "walk")
    with Staged(spark) as keep:
        there = keep(links.select("src").distinct(), "sources")
        good = keep(followed(links, start).join(there.select(F.col("src").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.min("pos").alias("pos")), "links")
        level = there.where(F.col("src") == start).select(F.col("src").alias("url"), F.lit(0).cast("long").alias("ordinal"))
        seen, n = 0, level.count()
        level.write.parquet(path)
        while n and (most is None or seen + n < most):
            seen += n
            known = spark.read.schema(level.schema).parquet(path)
            at = known.where(F.col("ordinal") >= seen - n)
            found = at.join(good, F.col("url") == F.col("src")).groupBy("dst").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
            new = found.join(known, F.col("dst") == F.col("url"), "left_anti").select(F.col("dst").alias("url"), "at")
            ranked = numbered(new, keep, F.col("at").asc(), F.col("url").asc(), first=seen).select("url", "ordinal")
            ranked = keep(ranked if most is None else ranked.where(F.col("ordinal") < most), "level")
            n = ranked.count()
            ranked.write.mode("append").parquet(path)
    return spark.read.schema(level.schema).parquet(path)


def link_graph(parsed_pages: DataFrame) -> DataFrame:
    """(src, pos, dst) of parsed pages; a page without links has one row with no dst."""
    return parsed_pages.select(F.col("url").alias("src"), F.posexplode_outer("page.links").alias("pos", "dst"))


def wanted_file(path: Column, root: str) -> Column:
    skipped = F.lit(False)
    for p in SKIPPED_PARTS:
        skipped = skipped | path.contains(p)
    return path.endswith(".md") & path.startswith(f"{root}/") & ~skipped


def tree_files(listing: DataFrame, root: str) -> DataFrame:
    """(path, pos) of the Markdown files in a tree listing (tree: array of path and type).

    A listing of several rows says by ``part`` how they follow each other.
    """
    part = F.col("part").cast("long") if "part" in listing.columns else F.lit(0).cast("long")
    items = listing.select(part.alias("part"), F.posexplode("tree").alias("at", "item"))
    return items.select((F.shiftleft("part", 32) + F.col("at")).alias("pos"), "item").where(F.col("item.type") == "blob").select(F.col("item.path").alias("path"), "pos").where(wanted_file(F.col("path"), root))


def sized(files: DataFrame, text_col: str = "markdown") -> DataFrame:
    """Files with content hashes, without those whose trimmed text is below the least size."""
    return files.where(F.col(text_col).isNotNull() & (units(trim(F.col(text_col))) >= LEAST_FILE)).withColumn("content_hash", F.sha2(text_col, 256))


def markdown_folder(spark: SparkSession, folder: str, root: str, base_url: str) -> DataFrame:
    """url, file_path, markdown, content_hash of the wanted files below ``folder``/``root``."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(f"{folder}/{root}", wholetext=True)
    at = F.concat(F.lit(f"{root}/"), F.substring_index(F.input_file_name(), f"/{root}/", -1))
    files = read.select(at.alias("file_path"), F.col("value").alias("markdown")).where(wanted_file(F.col("file_path"), root))
    return sized(files).select(doc_url(F.col("file_path"), root, base_url).alias("url"), "file_path", "markdown", "content_hash")


def spread(rows: DataFrame) -> DataFrame:
    """A stored table over all cores, for work that is heavy in the row; one that is already in enough parts stays as it is."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def pages(spark: SparkSession, path: str) -> DataFrame:
    """url, html, content_hash of stored pages; a page without a body is none."""
    return spread(spark.read.parquet(path).select("url", "html").where("html is not null and html <> ''")).withColumn("content_hash", F.sha2("html", 256))


def fetch(url: str, retries: int = 3, delay: float = 1.0, timeout: float = 30, most: int = 10 << 20, sleep=time.sleep) -> tuple[str | None, str | None]:
    """(body, error) of an address.  A page that is gone has neither."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                body = r.read(most + 1)
            return (None, f"more than {most} bytes") if len(body) > most else (body.decode("utf-8", "replace"), None)
        except urllib.error.HTTPError as e:
            if e.code in GONE:
                return None, None
            error = f"HTTP {e.code}"
        except (OSError, ValueError) as e:
            error = str(e)
        if attempt < retries:
            sleep(delay * 2**attempt)
    return None, error


def fetched(urls: DataFrame, retries: int = 3, delay: float = 1.0, partitions: int = 10) -> DataFrame:
    """``urls`` (url, ...) with body and error of each address, errors as rows; each task fetches its share one after the other.

    What a server answers may differ the next time: write the result before it is used twice.
    """
    at, names = urls.columns.index("url"), urls.columns
    types = {f.name: f for f in urls.schema}
    out = T.StructType([*(types[n] for n in names), T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held, got = 0, 0, []
            for k in range(b.num_rows):  # handed on by their size, as a page may be as large as ten megabytes
                got.append(fetch(b.column(at)[k].as_py(), retries, delay))
                held += len(got[-1][0] or "")
                if held >= HELD or k + 1 == b.num_rows:
                    bodies, errors = (pa.array(x, pa.string()) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([*b.slice(first, k + 1 - first).columns, bodies, errors], [*names, "body", "error"])
                    first, held, got = k + 1, 0, []

    return urls.repartition(partitions).mapInArrow(run, out)


def published(files: DataFrame, folder: str) -> int:
    """Write each row's ``body`` to the file ``path`` below a folder that all tasks see; how many there are.

    A file is made beside its place and moved there, so that a task may come again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, body in zip(b.column("path"), b.column("body"), strict=True):
                at = f"{folder}/{path.as_py()}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                made = f"{at}.{uuid.uuid4().hex}"
                with open(made, "wb") as f:
                    f.write(body.as_buffer())
                os.replace(made, at)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("path", F.col("body").cast("binary").alias("body")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def published_sitemaps(listed: DataFrame, n: int, folder: str, base: str) -> str:
    """Write sitemap files of the ``n`` addresses ``listed`` (url) and an index of them below ``folder``, which is at ``base``; the index's address."""
    maps = -(-n // MAP)
    entry = lambda tag, url: F.concat(F.lit(f"<{tag}><loc>"), url, F.lit(f"</loc></{tag}>"))
    at = F.format_string("map-%d.xml", "map")
    body = F.array_join(F.collect_list(entry("url", F.col("url"))), "\n")
    published(listed.groupBy(F.pmod(F.xxhash64("url"), F.lit(maps)).alias("map")).agg(body.alias("body")).select(at.alias("path"), "body"), folder)
    names = listed.sparkSession.range(maps).withColumnRenamed("id", "map").select(entry("sitemap", F.concat(F.lit(f"{base}/"), at)).alias("entry"))
    published(names.agg(F.array_join(F.collect_list("entry"), "\n").alias("body")).select(F.lit("sitemap.xml").alias("path"), "body"), folder)
    return f"{base}/sitemap.xml"


def fetched_sitemaps(spark: SparkSession, start: str, keep, depth: int = 3, **options) -> DataFrame:
    """(url, xml, error) of the sitemap at ``start`` and of those that it names, ``depth`` levels deep."""
    level = spark.createDataFrame([(start,)], "url string")
    out = None
    for _ in range(depth):
        got = keep(fetched(level, **options).select("url", F.col("body").alias("xml"), "error"), "sitemaps")
        level = keep(named_maps(got).join(got if out is None else out.unionByName(got), "url", "left_anti"), "named-maps")
        out = got if out is None else out.unionByName(got)
        if level.isEmpty():
            break
    return out


def walked(spark: SparkSession, start: str, keep, most: int = 500, block: int = 100, **options) -> DataFrame:
    """(url, ordinal, body, error): the first ``most`` pages that a walk over live links finds, breadth first.

    Candidates of a level are fetched in their order, ``block`` at a time, until there are enough; a page that can't
    be read is no page and has no place, but a row with its error, unless it is gone or empty.  The number visited is
    bounded by ``most`` and the links of its pages.
    """
    found, lost, seen = None, None, None
    level, have = spark.createDataFrame([(start, 0)], "url string, place long"), 0
    while have < most and not level.isEmpty():
        seen = keep(level.select("url") if seen is None else seen.unionByName(level.select("url")), "visited")
        total, got_all = level.count(), None
        for low in range(0, total, block):
            part = level.where((F.col("place") >= low) & (F.col("place") < low + block))
            got = keep(fetched(part, **options).where("error is not null or body <> ''"), "walked")
            got_all = got if got_all is None else got_all.unionByName(got)
            if have + got_all.where("error is null").count() >= most:
                break
        bad = got_all.where("error is not null").select("url", F.lit(None).cast("long").alias("ordinal"), "body", "error")
        lost = bad if lost is None else lost.unionByName(bad)
        here = numbered(got_all.where("error is null").select("url", "body", "place"), keep, F.col("place").asc(), first=have).where(F.col("ordinal") < most)
        here = keep(here.select("url", "ordinal", "body"), "level")
        found = here if found is None else found.unionByName(here)
        have += here.count()
        links = followed(link_graph(html.parsed(here.withColumnRenamed("body", "html"), keep_noindex=True)), start)
        new = links.join(here.select(F.col("url").alias("src"), "ordinal"), "src").groupBy("dst").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
        new = new.join(seen.select(F.col("url").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("url"), "at")
        level = keep(numbered(new, keep, F.col("at").asc(), F.col("url").asc(), as_col="place").select("url", "place"), "candidates")
    if found is None:
        return spark.createDataFrame([], "url string, ordinal long, body string, error string")
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(lost)
