"""Pages or files to embedded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvid.config import Settings
from corvid.operators import chunks, embed, html, markdown, store
from corvid.tables import Staged

COUNTS = ("updated", "skipped", "empty", "errors", "chunks")


def sections(pages: DataFrame, *keep: str) -> DataFrame:
    """Sections of HTML pages and Markdown files alike, by which of the columns html and markdown there is."""
    if "html" in pages.columns:
        return html.sections(html.parsed(pages), *keep)
    return markdown.sections(pages, *keep)


def chunked(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Chunks of ``pages`` (url, product, version, and html or markdown)."""
    out = chunks.chunked(sections(pages, "product", "version"), s, "product", "version")
    return out.withColumn("content_hash", F.sha2("content", 256))


def one_each(pages: DataFrame) -> DataFrame:
    """One row an address; of several the greatest in the order of their columns, so the choice does not depend on how they lie."""
    first = ["content_hash", *(c for c in pages.columns if c not in ("url", "content_hash"))]
    rows = pages.groupBy("url").agg(F.max(F.struct(*first)).alias("row"))
    return rows.select("url", "row.*").select(pages.columns)


def ingested(pages: DataFrame, to: store.Store, provider: embed.Provider, s: Settings = Settings(), force: bool = False, batch: tuple[str, int] | None = None) -> DataFrame:
    """Bring changed pages into the store.  What was done, one row a product: product, updated, skipped, empty, errors, chunks.

    The join with known hashes comes before parsing and embedding, so unchanged pages cost neither; parsing and
    embedding run once, into a table in the shared folder.  A page without chunks is left as it was, and tried again
    next time.  A stream's ``batch`` (stream, number) is marked in the version it makes.  Rows with an ``error`` (if there is such a column) are counted and go no further.
    """
    if provider.dimensions != to.dimensions:
        raise ValueError(f"the store holds vectors of {to.dimensions}, the provider makes {provider.dimensions}; migrate first")
    spark = pages.sparkSession
    failed = F.col("error").isNotNull() if "error" in pages.columns else F.lit(False)
    with Staged(spark) as keep:
        totals = pages.groupBy("product").agg(F.count_if(~failed).alias("total"), F.count_if(failed).alias("errors"))
        totals = keep(totals, "ingest-totals")
        usable = pages.where(~failed).drop("error") if "error" in pages.columns else pages
        new = keep(one_each(to.changed(usable, force)), "changed-pages")
        made = keep(embed.embedded(chunked(new, s), provider), "embedded-chunks")
        some = not made.isEmpty()
        if some or batch:
            to.replace_pages(made if some else None, new, batch)
        done = made.groupBy("product").agg(F.countDistinct("source_url").alias("updated"), F.count("*").alias("chunks"))
        asked = new.groupBy("product").agg(F.count("*").alias("asked"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        for name, part in (("asked_of", asked), ("done_of", done)):
            part = part.withColumnRenamed("product", name)
            totals = totals.join(part, totals["product"].eqNullSafe(part[name]), "left").drop(name)
        asked_n, updated = zero(F.col("asked")), zero(F.col("updated"))
        rows = totals.select("product", updated.alias("updated"), (F.col("total") - asked_n).alias("skipped"), (asked_n - updated).alias("empty"), "errors", zero(F.col("chunks")).alias("chunks"))
        return spark.createDataFrame(rows.orderBy("product").collect(), rows.schema)  # one row a product


def ingest(pages: DataFrame, to: store.Store, provider: embed.Provider, s: Settings = Settings(), force: bool = False, batch: tuple[str, int] | None = None) -> dict:
    """As ``ingested``; the counts over all products, and by product."""
    rows = [r.asDict() for r in ingested(pages, to, provider, s, force, batch).collect()]
    by = {r["product"]: {n: r[n] for n in COUNTS} for r in rows}
    return {n: sum(r[n] for r in rows) for n in COUNTS} | {"by_product": by}
