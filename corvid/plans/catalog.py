"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvid.config import Settings
from corvid.engine import Engine, Product
from corvid.functions import text as T
from corvid.functions.vectors import cosine
from corvid.operators.cells import CellIndex
from corvid.operators import chunks, embed, html, markdown, search, store
from corvid.operators.ingest import chunked, one_each
from corvid.sources import web
from corvid.streaming.incremental import run_available
from corvid.tables import Staged, fresh

SMALL = Settings(chunk_size=100, chunk_overlap=20)
WHOLE = Settings()
DIM = 768
LISTS = 100
SP = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def heavy(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    """A table for work that is heavy in the row."""
    return web.spread(read(spark, sf, table).select(*columns))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the first part of their path as product."""
    return web.pages(spark, f"{sf}/pages.parquet").select("url", "html", "content_hash", F.element_at(F.split("url", "/"), 4).alias("product"), F.lit(None).cast("string").alias("version"))


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages, each non-empty line a section."""
    rows = heavy(spark, sf, "documents", "doc_id", "source", "text")
    rows = rows.select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("product"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.withColumns({"title": F.col("url"), "heading": F.lit("")})


def markdown_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown files: a heading and its text before every third line, a fence around every seventh."""
    heading = lambda x, i: F.concat(F.lit("## Part *"), i.cast("string"), F.lit("*\n"), x)
    fence = lambda x: F.concat(F.lit("```\n"), x, F.lit("\n```"))
    kind = lambda x, i: F.when(i % 3 == 0, heading(x, i)).when(i % 7 == 1, fence(x)).otherwise(F.concat(F.lit("- "), x))
    made = F.array_join(F.transform(F.split("text", "\n"), kind), "\n")
    url = F.col("doc_id").cast("string")
    front = F.concat(F.lit('---\ntitle: "Doc '), url, F.lit('"\ndescription: d'), F.col("source"), F.lit("\n---\n"))
    return heavy(spark, sf, "documents", "doc_id", "source", "text").select(url.alias("url"), F.concat(front, made).alias("markdown"))


# --- vector search

_KNN = """
with q as (select cast(embedding as double[]) v from embeddings where vec_id = 0),
s as (select vec_id, label, list_cosine_similarity(cast(embedding as double[]), q.v) score from embeddings, q where embedding is not null {where})
select vec_id, label, round(score, 6) score from (select * from s order by score desc, vec_id limit {k}) {after}"""


def _knn(spark: SparkSession, sf: str, k: int, label: int | None = None, least: float | None = None) -> DataFrame:
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    found = search.nearest(e, q, k, label, least, ties=("vec_id",), product_col="label")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(_KNN.format(where="", k=10, after=""))
def knn_topk(spark, sf):
    return _knn(spark, sf, 10)


@query(_KNN.format(where="and label = 3", k=5, after=""))
def knn_topk_filtered(spark, sf):
    return _knn(spark, sf, 5, 3)


@query(_KNN.format(where="", k=20, after="where score >= 0.3"))
def knn_min_score(spark, sf):
    return _knn(spark, sf, 20, least=0.3)


@query("""
with q as (select vec_id query, cast(embedding as double[]) v from embeddings where vec_id % 50 = 0),
s as (select query, e.vec_id, list_cosine_similarity(cast(e.embedding as double[]), q.v) score from embeddings e, q)
select query, vec_id, round(score, 6) score, cast(r as integer) as rank from (select *, row_number() over (partition by query order by score desc, vec_id) r from s) where r <= 10""")
def knn_batch(spark, sf):
    """Every fiftieth row against all rows, a block of queries to a pass."""
    e = read(spark, sf, "embeddings")
    return search.nearest_each(e, e.where("vec_id % 50 = 0"), 10).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""
select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) score
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def _through_cells(spark: SparkSession, sf: str, **options) -> DataFrame:
    e = read(spark, sf, "embeddings")
    index = CellIndex.build(e, fresh(spark, "cells"), lists=LISTS)
    found = index.search_each(e.where("vec_id % 50 = 0"), 10, **options)
    return found.select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(ORACLES["knn_batch"])
def ivf_exact(spark, sf):
    """Every fiftieth row through all cells of the index at once."""
    return _through_cells(spark, sf, first=LISTS)


@query(ORACLES["knn_batch"])
def ivf_topk(spark, sf):
    """Every fiftieth row through the cells that its bounds leave, a few at first."""
    return _through_cells(spark, sf)


@query(ORACLES["knn_batch"])
def knn_grid(spark, sf):
    """As ``knn_batch``, with more queries than go out at once: blocks of them meet parts of the rows in one shuffle."""
    e = read(spark, sf, "embeddings")
    return search.nearest_each(e, e.where("vec_id % 50 = 0"), 10, block=4, part=200).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- hashes, addresses, sources

@query("select url, sha256(html) content_hash from pages where html <> ''")
def page_hash(spark, sf):
    return pages(spark, sf).select("url", "content_hash")


@query("select doc_id, sha256(text) content_hash from documents where length(trim(text)) >= 50")
def doc_hash(spark, sf):
    return web.sized(read(spark, sf, "documents"), "text").select("doc_id", "content_hash")


@query("""
select distinct url from (select url from pages union all select url || '.pdf' from pages union all select replace(url, '.net/', '.net/assets/') from pages)
where starts_with(lower(url), 'http://') and not lower(url) like '%.pdf' and not lower(url) like '%.zip' and not contains(lower(url), '/assets/') and not contains(lower(url), '/images/')""")
def page_url_filter(spark, sf):
    url = read(spark, sf, "pages").select("url")
    more = url.select(F.concat("url", F.lit(".pdf")).alias("url")).unionByName(url.select(F.regexp_replace("url", "\\.net/", ".net/assets/").alias("url")))
    return web.filter_urls(url.unionByName(more), "HTTP://")


@query("""
with l as (select url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href from pages)
select url, regexp_replace(case when starts_with(href, '/') then regexp_extract(url, '^(https?://[^/]+)', 1) || href else href end, '#.*', '') link from l""")
def page_links(spark, sf):
    return html.parsed(pages(spark, sf)).select("url", F.explode("page.links").alias("link"))


@query("select 'http://h.example/' || page_id as url, page_id as ordinal from pages where html <> ''")
def link_bfs(spark, sf):
    """A site in which page n links to pages 3n + 1 to 3n + 3, back to its own parent, to missing pages, to archives and elsewhere."""
    n, at = F.col("page_id"), lambda k: F.concat(F.lit("http://h.example/"), k.cast("string"))
    away = F.array(at(F.floor((n - 1) / 3).cast("long")), at(n + 1_000_000_000), F.concat(at(n + 1), F.lit(".pdf")), F.concat(F.lit("http://other.example/"), n.cast("string")))
    ahead = F.array(*(at(3 * n + k) for k in (1, 2, 3)))
    stored = read(spark, sf, "pages").where("html <> ''")
    links = stored.select(at(n).alias("src"), F.posexplode(F.concat(away, ahead)).alias("pos", "dst"))
    return web.reachable(links, "http://h.example/0", most=None)


@query("select 'https://docs.example.org/v1/' || source || '/' || doc_id || '/' as url, source || ' ' || doc_id as title from documents")
def file_urls(spark, sf):
    path = F.concat(F.lit("en/docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    named = F.concat(F.lit("x/"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, sf, "documents").select(T.doc_url(path, "en/docs", "https://docs.example.org/v1/").alias("url"), T.path_title(named).alias("title"))


@query("""
select url, cast(dense_rank() over (order by product, part) - 1 as bigint) map, row_number() over (partition by product, part order by url) - 1 as place
from (select distinct url, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) product, page_id // 1000 part from pages where html <> '')""")
def sitemap_places(spark, sf):
    """Where an index of sitemaps, a thousand pages each, lists each page: the sitemap's place and the page's place in it."""
    p = read(spark, sf, "pages").where("html <> ''").select("url", F.element_at(F.split("url", "/"), 4).alias("product"), F.floor(F.col("page_id") / 1000).alias("part")).distinct()
    joined = lambda column, tag: F.array_join(F.transform(column, lambda u: F.concat(F.lit(f"<{tag}><loc> "), u, F.lit(f" </loc></{tag}>"))), "")
    name = F.concat(F.lit("map-"), "product", F.lit("-"), F.col("part").cast("string"))
    each = p.groupBy("product", "part").agg(joined(F.array_sort(F.collect_list("url")), "url").alias("xml")).select(name.alias("url"), F.concat(F.lit("<urlset>"), "xml", F.lit("</urlset>")).alias("xml"))
    names = F.transform(F.array_sort(F.collect_set(F.struct("product", "part"))), lambda x: F.concat(F.lit("map-"), x["product"], F.lit("-"), x["part"].cast("string")))
    index = p.agg(joined(names, "sitemap").alias("xml")).select(F.lit("index").alias("url"), F.concat(F.lit("<sitemapindex>"), "xml", F.lit("</sitemapindex>")).alias("xml"))
    steps = F.split("ordinal", "/")
    return web.sitemap_urls(index.unionByName(each), "index").select("url", F.get(steps, 0).cast("long").alias("map"), F.get(steps, 1).cast("long").alias("place"))


@query("select url from pages")
def sitemap(spark, sf):
    """An index of sitemaps, one for each product, that lists all pages."""
    p = pages(spark, sf)
    each = p.groupBy("product").agg(F.concat(F.lit("<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">"), F.array_join(F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))), ""), F.lit("</urlset>")).alias("xml")).select(F.concat(F.lit("map-"), F.col("product")).alias("url"), "xml")
    index = p.select("product").distinct().agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(F.collect_list("product"), lambda u: F.concat(F.lit("<sitemap><loc>map-"), u, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.lit("index").alias("url"), "xml")
    return web.sitemap_urls(index.unionByName(each), "index").select("url")


@query("""
select 'docs/' || source || '/' || doc_id || '.md' as path from documents
where doc_id % 5 not in (1, 2, 3)""")
def tree_listing(spark, sf):
    """A repository tree of one file per document, some of them pictures, folders or of skipped folders."""
    kind = F.col("doc_id") % 5
    name = F.concat(F.lit("docs/"), F.when(kind == 1, F.lit("assets/")).otherwise(F.lit("")), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(kind == 2, F.lit(".png")).otherwise(F.lit(".md")))
    item = F.struct(name.alias("path"), F.when(kind == 3, F.lit("tree")).otherwise(F.lit("blob")).alias("type"))
    listing = read(spark, sf, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.collect_list(item).alias("tree"))
    return web.tree_files(listing, "docs").select("path")


# --- parsing

_UNTAG = "replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&amp;', '&')"
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_H1 = f"trim(regexp_replace(regexp_replace({_UNTAG.format(f'''regexp_extract({_ARTICLE}, '(?s)<h1>(.*?)</h1>', 1)''')}, '&amp?', '&', 'g'), '\\s+', ' ', 'g'))"


@query("select url, trim(regexp_replace(regexp_replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '\"'), '&amp;', '&'), '&amp?', '&', 'g'), '\\s+', ' ', 'g')) title, '' as description from pages")
def page_title(spark, sf):
    return html.parsed(pages(spark, sf)).select("url", F.regexp_replace("page.title", "\\s+", " ").alias("title"), F.col("page.description").alias("description"))


@query("""
select url, case page_id % 4 when 0 then 'About page ' || page_id when 1 then 'Seen on page ' || page_id when 2 then 'About page ' || page_id else '' end as description
from pages where html <> ''""")
def page_descriptions(spark, sf):
    """Pages that are given a description of either kind, both kinds, or none."""
    n = F.col("page_id").cast("string")
    about = F.concat(F.lit('<meta name="description" content=" About page '), n, F.lit('">'))
    seen = F.concat(F.lit('<meta property="og:description" content="Seen on page '), n, F.lit(' ">'))
    kind = F.col("page_id") % 4
    given = F.when(kind == 0, about).when(kind == 1, seen).when(kind == 2, F.concat(seen, about)).otherwise(F.lit(""))
    told = read(spark, sf, "pages").where("html <> ''").select("url", F.concat(F.lit("<html><head>"), given, F.lit("</head></html>"), "html").alias("html"))
    return html.parsed(told).select("url", F.col("page.description").alias("description"))


_SECTIONS = f"""
with a as (select url, {_ARTICLE} x, {_H1} heading from pages),
p as (select url, heading, list_filter(list_transform(string_split(regexp_replace(x, '(?s)<h1>.*?</h1>', ''), '<p>'),
  lambda y: trim(regexp_replace(regexp_replace({_UNTAG.format('y')}, '&amp?', '&', 'g'), '\\s+', ' ', 'g'))), lambda y: y <> '') ps from a)
select url, cast(0 as integer) pos, heading, array_to_string(ps, ' ') as text, cast(1 as integer) as level from p where length(array_to_string(ps, ' ')) > 20"""


@query(_SECTIONS)
def page_sections(spark, sf):
    return html.sections(html.parsed(pages(spark, sf))).select("url", "pos", "heading", "text", "level")


@query("select url from pages where html <> '' and page_id % 4 <> 0")
def noindex_pages(spark, sf):
    """Pages with a robots directive of three kinds; only the one in small letters keeps a page out."""
    kind = F.when(F.col("page_id") % 4 == 0, "noindex, follow").when(F.col("page_id") % 4 == 1, "NOINDEX").otherwise("all")
    rows = heavy(spark, sf, "pages", "page_id", "url", "html").where("html <> ''")
    return html.parsed(rows.withColumn("html", F.concat(F.lit('<meta name="robots" content="'), kind, F.lit('">'), "html"))).select("url")


@query("""
select 'http://h/' || doc_id as url, 'http://h/' || doc_id as heading, text, cast(1 as integer) as level from
  (select doc_id, repeat('word ', cast(doc_id % 20 as integer)) || 'end' as text from documents) where length(text) > 50""")
def html_fallback(spark, sf):
    """Pages without any block element, of 3 to 98 characters: one section of all text, if it is long enough."""
    made = F.concat(F.lit("<body><div>"), F.repeat(F.lit("word "), (F.col("doc_id") % 20).cast("int")), F.lit("end</div></body>"))
    rows = heavy(spark, sf, "documents", "doc_id").select(F.concat(F.lit("http://h/"), F.col("doc_id").cast("string")).alias("url"), made.alias("html"))
    return html.sections(html.parsed(rows)).select("url", "heading", "text", "level")


@query(_SECTIONS.replace("select url, cast(0 as integer) pos, heading, array_to_string(ps, ' ') as text, cast(1 as integer) as level", "select url, heading || chr(10) || array_to_string(ps, ' ') as raw"))
def raw_text(spark, sf):
    return html.parsed(pages(spark, sf)).select("url", html.raw_text(F.col("page.sections")).alias("raw")).where("raw <> ''")


def _duck_clean(c: str) -> str:
    for a, b in T.CLEAN:
        a = a.replace(T.SPACE, SP).replace("'", "''")
        c = f"regexp_replace({c}, '{a}', '{b.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


@query(f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) raw, unnest(range(len(string_split(text, chr(10))))) pos from documents),
m as (select doc_id, pos, '- **' || raw || '** [a](b) `c` <i>d</i>' as raw from l),
c as (select doc_id, pos, {_duck_clean('raw')} as text from m)
select doc_id, cast(pos as integer) pos, text from c where length(text) > 3""")
def md_clean_lines(spark, sf):
    lines = heavy(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return lines.select("doc_id", "pos", markdown.kept_line(F.concat(F.lit("- **"), F.col("raw"), F.lit("** [a](b) `c` <i>d</i>"))).alias("text"))


@query(f"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) raw, unnest(range(len(string_split(text, chr(10))))) i from documents),
m as (select *, i - i % 3 as head, case when i % 3 <> 0 and i % 7 = 1 then 1 else 0 end code, regexp_replace(raw, '{SP}+$', '') as line from l),
t as (select doc_id, head, i, case when code = 1 and trim(line) <> '' then '[code: ' || substr(line, 1, 200) || ']'
  when code = 1 or line = '' then null
  else {_duck_clean("case when i % 3 = 0 then line else '- ' || line end")} end x, code from m),
s as (select doc_id, head, trim(regexp_replace(coalesce(string_agg(x, ' ' order by i) filter (code = 1 or length(x) > 3), ''), '{SP}+', ' ', 'g')) as text from t group by doc_id, head),
b as (select doc_id, string_agg(case when i % 3 = 0 then '## Part *' || i || '*' || chr(10) || raw when i % 7 = 1 then '```' || chr(10) || raw || chr(10) || '```' else '- ' || raw end, chr(10) order by i) body from l group by doc_id),
w as (select doc_id, {_duck_clean("regexp_replace(body, '^' || '" + SP + "+|" + SP + "+$', '', 'g')")} as text from b where doc_id not in (select doc_id from s where length(text) > 20))
select cast(doc_id as varchar) url, 'Doc ' || doc_id title, 'Part ' || head as heading, text, cast(2 as integer) as level from s where length(text) > 20
union all select cast(doc_id as varchar), 'Doc ' || doc_id, 'Doc ' || doc_id, text, 1 from w where length(text) > 30""")
def md_sections(spark, sf):
    return markdown.sections(markdown_files(spark, sf)).select("url", "title", "heading", "text", "level")


@query("""
select 'docs/my-file_' || doc_id || '.md' as url, 'my file ' || doc_id as title, 'my file ' || doc_id as heading, trim(repeat('ab ', n)) as text, cast(1 as integer) as level
from (select doc_id, cast(1 + doc_id % 20 as integer) n from documents) where n >= 11""")
def md_fallback(spark, sf):
    """Files of lines too short to count one by one: one section of all text, if that is long enough; titles from the path."""
    url = F.concat(F.lit("docs/my-file_"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = read(spark, sf, "documents").select(url.alias("url"), F.repeat(F.lit("ab\n"), (1 + F.col("doc_id") % 20).cast("int")).alias("markdown"))
    return markdown.sections(rows).select("url", "title", "heading", "text", "level")


@query(f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) raw, unnest(range(len(string_split(text, chr(10))))) pos from documents),
c as (select doc_id, pos, {_duck_clean('raw')} as text from l where pos % 3 = 0 and not starts_with(trim(raw), '<!--'))
select doc_id, cast(pos as integer) pos, text from c where length(text) > 3""")
def md_skipped_lines(spark, sf):
    """Of three lines one is a comment, one a picture, and one text."""
    lines = heavy(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    kind = F.when(F.col("pos") % 3 == 1, F.concat(F.lit(" <!-- "), "raw", F.lit(" -->"))).when(F.col("pos") % 3 == 2, F.lit("  ![a picture](of/it.png) ")).otherwise(F.col("raw"))
    return lines.select("doc_id", "pos", markdown.kept_line(kind).alias("text"))


# --- chunks

@query(f"""
with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1))) sentence from documents)
select doc_id, sentence from s where trim(sentence) <> '' and regexp_matches(sentence, '[^\\s]')""")
def doc_sentences(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(chunks.sentences(F.col("text"))).alias("sentence"))


_PARTS = f"""
with l as (select cast(doc_id as varchar) url, source product, unnest(string_split(text, chr(10))) raw, unnest(range(len(string_split(text, chr(10))))) pos from documents),
x as (select url, product, pos, regexp_replace(raw, '^{SP}+|{SP}+$', '', 'g') as text from l),
y as (select * from x where text <> ''),
o as (select *, coalesce(lag(right(text, 80)) over (partition by url order by pos), '') as lead from y)"""


@query(_PARTS + " select url, cast(pos as integer) pos, lead from o")
def overlap_tail(spark, sf):
    return chunks.with_overlap(paragraphs(spark, sf), SMALL).select("url", "pos", "lead")


_CHUNKS = _PARTS + f""",
s as (select *, list_filter(string_split(regexp_replace(text, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z) <> '') ss from o),
f as (select *, list_reduce(list_concat([{{'cur': case when lead <> '' then lead || ' ' else '' end, 'out': cast([] as varchar[])}}], list_transform(ss, lambda z: {{'cur': z, 'out': cast([] as varchar[])}})),
  lambda a, b: case when ceil(length(a.cur || b.cur || ' ') / 4.0) > 100 and trim(a.cur) <> ''
    then {{'cur': right(a.cur, 80) || ' ' || b.cur || ' ', 'out': list_append(a.out, trim(a.cur))}} else {{'cur': a.cur || b.cur || ' ', 'out': a.out}} end) r from s),
c as (select url, product, pos, case when ceil(length(text) / 4.0) <= 100 then [case when lead <> '' then lead || ' ' || text else text end]
  else list_append(r.out, trim(r.cur)) end parts from f),
e as (select url, product, pos, unnest(parts) content, unnest(range(len(parts))) part from c),
k as (select *, row_number() over (partition by url order by pos, part) - 1 i from e where ceil(length(content) / 4.0) >= 20)"""


@query(_CHUNKS + " select url source_url, product, url title, url section, cast(i as integer) chunk_index, trim(content) as content from k")
def doc_chunks(spark, sf):
    return chunks.chunked(paragraphs(spark, sf), SMALL, "product")


@query(_CHUNKS + " select url, count(*) chunk_count from k group by url")
def chunk_counts(spark, sf):
    return chunks.chunked(paragraphs(spark, sf), SMALL).groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("chunk_count"))


# --- embedding and search over pages

_PAGE_CHUNKS = f"""
with a as (select url, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) product, html, {_ARTICLE} x, {_H1} heading,
  trim(regexp_replace(regexp_replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '&amp?', '&', 'g'), '\\s+', ' ', 'g')) title from pages where html <> ''),
p as (select *, list_filter(list_transform(string_split(regexp_replace(x, '(?s)<h1>.*?</h1>', ''), '<p>'),
  lambda y: trim(regexp_replace(regexp_replace({_UNTAG.format('y')}, '&amp?', '&', 'g'), '\\s+', ' ', 'g'))), lambda y: y <> '') ps from a),
sec as (select url, product, html, title, case when heading <> '' then heading else title end as section, array_to_string(ps, ' ') as text from p where length(array_to_string(ps, ' ')) > 20),
ss as (select *, list_filter(string_split(regexp_replace(text, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z) <> '') parts from sec),
fold as (select *, list_reduce(list_concat([{{'cur': '', 'out': cast([] as varchar[])}}], list_transform(parts, lambda z: {{'cur': z, 'out': cast([] as varchar[])}})),
  lambda a, b: case when ceil(length(a.cur || b.cur || ' ') / 4.0) > 800 and trim(a.cur) <> ''
    then {{'cur': right(a.cur, 400) || ' ' || b.cur || ' ', 'out': list_append(a.out, trim(a.cur))}} else {{'cur': a.cur || b.cur || ' ', 'out': a.out}} end) r from ss),
cut as (select url, product, html, title, section, case when ceil(length(text) / 4.0) <= 800 then [text] else list_append(r.out, trim(r.cur)) end pieces from fold),
each as (select url, product, html, title, section, unnest(pieces) content, unnest(range(len(pieces))) part from cut),
page_chunks as (select url source_url, product, html, title, section, trim(content) as content, row_number() over (partition by url order by part) - 1 chunk_index from each where ceil(length(content) / 4.0) >= 20)"""

_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_BUCKET = "('0x' || substr(md5(w), 1, 8))::bigint % 768"


def _bag(query: str, key: str = "source_url") -> str:
    """Scores ``s`` of the texts ``docs`` (key, product, t) for a question, by counts of hash buckets."""
    words, asked = _WORDS.format("t"), _WORDS.format(query)
    return f"""
d as (select {key}, product, 'b' || cast(b as varchar) as b, count(*) n from (select {key}, product, {_BUCKET} b from (select {key}, product, unnest({words}) w from docs)) group by all),
q as (select 'b' || cast(b as varchar) as b, count(*) n from (select {_BUCKET} b from (select unnest({asked}) w)) group by all),
aa as (select {key}, sum(n * n) aa from d group by all),
s as (select {', '.join('d.' + k for k in key.split(', '))}, any_value(d.product) product, sum(coalesce(d.n * q.n, 0)) / sqrt(any_value(aa.aa) * (select sum(n * n) from q)) score from d left join q using (b) join aa using ({key}) group by {', '.join('d.' + k for k in key.split(', '))})"""


_DOCS = "with docs as (select cast(doc_id as varchar) source_url, source product, text t from documents where text <> ''),"
_QUESTION = "(select min(text) from benchmark)"


def _asked(k: int, question: str, where: str = "") -> str:
    """The ``k`` best page chunks for a question, as a search shows them."""
    docs = "docs as (select source_url, chunk_index, product, title || chr(10) || section || chr(10) || content t from page_chunks),"
    best = f"best as (select * from s {where} order by score desc, source_url, chunk_index limit {k})"
    shown = "case when length(content) > 800 then substr(content, 1, 800) || '…' else content end"
    return f"{_PAGE_CHUNKS}, {docs} {_bag(question, 'source_url, chunk_index')}, {best} select c.title, {shown} snippet, c.source_url, c.product, c.section, round(best.score, 4) score from best join page_chunks c using (source_url, chunk_index)"


def doc_vectors(spark: SparkSession, sf: str, p: embed.Provider) -> DataFrame:
    """Documents as one chunk each."""
    d = heavy(spark, sf, "documents", "doc_id", "source", "text").where("text <> ''")
    return d.select(F.col("doc_id").cast("string").alias("source_url"), F.col("source").alias("product"), F.lit(0).alias("chunk_index"), p.column(F.col("text")).alias("embedding"))


_ENGINES: dict = {}


def page_engine(spark: SparkSession, sf: str) -> Engine:
    """An engine whose products are those of the pages, with an empty store of its own."""
    ids = [r[0] for r in pages(spark, sf).select("product").distinct().orderBy("product").collect()]
    found = [Product(i, i.upper(), f"https://docs.example.org/{i}", description=f"Pages in {i}", version="1") for i in ids]
    return Engine(spark, found, Settings(dimensions=DIM, store_path=fresh(spark, "store")))


def searchable(spark: SparkSession, sf: str) -> Engine:
    """As ``page_engine``, with all pages parsed, chunked, embedded and stored; once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ENGINES or _ENGINES[key].store.version is None:  # the shared folder may have been cleared since
        engine = page_engine(spark, sf)
        engine.ingest(pages(spark, sf))
        _ENGINES[key] = engine
    return _ENGINES[key]


def forget() -> None:
    """Drop the answers that engines keep, so that the next question is a search again."""
    for engine in _ENGINES.values():
        engine.cache.clear()


def _question(spark, sf) -> str:
    return read(spark, sf, "benchmark").agg(F.min("text")).first()[0]


def _shown(rows: DataFrame) -> DataFrame:
    """Titles with their white space as SQL has it."""
    return rows.withColumn("title", F.regexp_replace("title", "\\s+", " "))


@query(_asked(5, _QUESTION))
def search_indexed(spark, sf):
    """As ``search_docs``, through the store's index of cells, which was made of half of the pages and kept up by the writes of the rest."""
    engine = page_engine(spark, sf)
    every = pages(spark, sf).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(2)))
    engine.ingest(every.where("part = 0").drop("part"))
    engine.index(16)
    engine.ingest(every.where("part = 1").drop("part"))
    return _shown(engine.search(_question(spark, sf), limit=5))


@query(_asked(5, _QUESTION))
def search_docs(spark, sf):
    return _shown(searchable(spark, sf).search(_question(spark, sf), limit=5))


@query(_asked(5, f"'DE: ' || {_QUESTION}", "where product = 'de'"))
def guide(spark, sf):
    return _shown(searchable(spark, sf).guide(_question(spark, sf), "de"))


@query(_asked(8, _QUESTION))
def explain(spark, sf):
    return _shown(searchable(spark, sf).explain(_question(spark, sf)))


@query(_DOCS + _bag("''").split("q as")[0].rstrip().rstrip(",") + " select source_url, cast(sum(n) as bigint) words, cast(sum(n * n) as bigint) squares, count(*) buckets from d group by 1")
def chunk_embed(spark, sf):
    """The embedding of every document, as its sum, its squared length and its number of filled buckets."""
    v = F.transform("embedding", lambda x: x.cast("long"))
    rows = doc_vectors(spark, sf, embed.Hashing(DIM)).select("source_url", v.alias("v"))
    total = lambda f: F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + f(x))
    return rows.select("source_url", total(lambda x: x).alias("words"), total(lambda x: x * x).alias("squares"), total(lambda x: F.when(x > 0, 1).otherwise(0).cast("long")).alias("buckets")).where("words > 0")


@query(_asked(20, "'the and of gateway'"))
def page_search(spark, sf):
    """Pages parsed, chunked, embedded, stored and searched, for as many results as a search may ask."""
    return _shown(searchable(spark, sf).search("the and of gateway", limit=20))


# --- store

def _old_new(spark, sf):
    """Two snapshots of the documents: the old one lacks every fifth, and has other text in every third."""
    d = read(spark, sf, "documents")
    old = d.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("url"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("page_hash"), F.timestamp_seconds("doc_id").alias("last_crawled"), F.lit(1).alias("chunk_count"))
    new = d.select(F.col("doc_id").cast("string").alias("url"), F.sha2("text", 256).alias("content_hash"), "text", F.col("source").alias("product"))
    return old, new


def _chunk_rows(d: DataFrame, text) -> DataFrame:
    blank = {k: F.lit(None).cast("string") for k in ("title", "section", "version", "content_hash")}
    return d.select(F.col("doc_id").cast("string").alias("source_url"), F.lit(0).alias("chunk_index"), F.col("source").alias("product"), text.alias("content")).withColumns({**blank, "embedding": F.lit(None).cast("array<float>"), "id": F.concat(F.lit("i"), "source_url"), "created_at": F.timestamp_seconds(F.lit(0)), "updated_at": F.timestamp_seconds(F.lit(0))})


@query("select cast(doc_id as varchar) url from documents where doc_id % 5 = 0 or doc_id % 3 = 0")
def changed_pages(spark, sf):
    old, new = _old_new(spark, sf)
    return store.changed(new, old).select("url")


_STATE = "select cast(doc_id as varchar) url, sha256(text) page_hash from documents"


@query(_STATE)
def crawl_state_upsert(spark, sf):
    old, new = _old_new(spark, sf)
    put = store.changed(new, old).select("url", F.col("content_hash").alias("page_hash"), F.lit(2).alias("chunk_count"))
    return store.state_merged(old, put).select("url", "page_hash")


@query("""
select cast(doc_id as varchar) source_url, case when doc_id % 2 = 0 or doc_id % 3 = 0 then text || '!' else text end as content,
  case when doc_id % 3 = 0 then 'new' else 'kept' end as origin from documents""")
def upsert_chunks(spark, sf):
    """Two of three documents are stored; every second, and all that are not stored, come anew: ids survive, contents are replaced."""
    d = read(spark, sf, "documents")
    out = store.merged(_chunk_rows(d.where("doc_id % 3 <> 0"), F.col("text")), _chunk_rows(d.where("doc_id % 2 = 0 or doc_id % 3 = 0"), F.concat("text", F.lit("!"))))
    return out.select("source_url", "content", F.when(F.col("id") == F.concat(F.lit("i"), "source_url"), "kept").otherwise("new").alias("origin"))


@query("select cast(doc_id as varchar) source_url, source product from documents where doc_id % 4 <> 1")
def replace_pages(spark, sf):
    """Every fourth page is replaced by nothing, the page after it by new chunks."""
    d = read(spark, sf, "documents")
    out = store.replaced(_chunk_rows(d, F.col("text")), _chunk_rows(d.where("doc_id % 4 = 2"), F.col("text")), d.where("doc_id % 4 in (1, 2)").select(F.col("doc_id").cast("string").alias("url")))
    return out.select("source_url", "product")


@query("select source product, count(*) n from documents group by 1")
def stats_by_product(spark, sf):
    return store.counts(_chunk_rows(read(spark, sf, "documents"), F.col("text")))


@query(_PAGE_CHUNKS + """,
asked as (select url, product, page_id % 5 = 0 or page_id % 3 = 0 as new from (select *, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) product from pages where html <> '')),
n as (select source_url url, count(*) chunks from page_chunks group by 1)
select product, cast(count(*) filter (new and chunks > 0) as bigint) updated, cast(count(*) filter (not new) as bigint) skipped,
  cast(count(*) filter (new and chunks is null) as bigint) empty, cast(0 as bigint) errors, cast(coalesce(sum(chunks) filter (new), 0) as bigint) chunks
from asked left join n using (url) group by product""")
def ingest_report(spark, sf):
    """Pages ingested into a store that knows four of five already, some of those by an older text."""
    engine = page_engine(spark, sf)
    known = read(spark, sf, "pages").where("html <> '' and page_id % 5 <> 0")
    older = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    engine.store.put_state(known.select("url", F.sha2(older, 256).alias("page_hash"), F.lit(1).alias("chunk_count")))
    return engine.ingested(pages(spark, sf))


@query("select cast(doc_id as varchar) url, sha256(text) page_hash, cast(1 + doc_id % 3 as bigint) newest from documents")
def crawl_state_scan(spark, sf):
    """State written in three runs, the newest run's first, with the number of runs that are as new."""
    d = read(spark, sf, "documents")
    kept = store.Store(spark, fresh(spark, "store"), 64)
    for k in (2, 1, 0):
        kept.put_state(d.where(F.col("doc_id") % 3 == k).select(F.col("doc_id").cast("string").alias("url"), F.sha2("text", 256).alias("page_hash"), F.lit(1).alias("chunk_count")))
    placed = kept.crawled().withColumn("place", F.monotonically_increasing_id())  # in the order that the scan gives
    runs = placed.groupBy("last_crawled").agg(F.min("place").alias("first"), F.max("place").alias("last"))  # three rows
    order = W.orderBy("first")
    sound = F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True))
    rank = runs.withColumn("newest", F.when(sound, F.row_number().over(order).cast("long")).otherwise(-1)).select("last_crawled", "newest")
    return kept.crawled().join(F.broadcast(rank), "last_crawled").select("url", "page_hash", "newest")


@query("""
select distinct id, upper(id) as name, 'Pages in ' || id description, 'https://docs.example.org/' || id base_url, '1' as version
from (select regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) id from pages)""")
def products(spark, sf):
    return page_engine(spark, sf).products()


@query(_PAGE_CHUNKS + " select url, sha256(html) page_hash from pages where html <> '' and url in (select source_url from page_chunks)")
def stream_ingest(spark, sf):
    """Pages, a file or a folder of files, through the engine's stream, and the state that it leaves, of the pages that have chunks."""
    engine = page_engine(spark, sf)

    def as_pages(rows: DataFrame) -> DataFrame:
        rows = rows.where("html <> ''").select("url", "html", F.sha2("html", 256).alias("content_hash"))
        return rows.select("*", F.element_at(F.split("url", "/"), 4).alias("product"), F.lit(None).cast("string").alias("version"))

    table = f"{sf}/{{pages.parquet}}"  # as a pattern, since a stream takes a plain path for a folder
    engine.follow(table, "page_id long, url string, html string", f"{fresh(spark, 'stream')}/progress", prepare=as_pages)
    return engine.store.state().select("url", "page_hash")


@query(_PAGE_CHUNKS + " select source_url, product, title, section, cast(chunk_index as integer) chunk_index, content, sha256(content) content_hash, cast(null as varchar) as version, cast(768 as integer) dimensions from page_chunks")
def stored_chunks(spark, sf):
    """What the store holds of all pages, as it was ingested."""
    return _shown(searchable(spark, sf).store.chunks()).select("source_url", "product", "title", "section", "chunk_index", "content", "content_hash", "version", F.size("embedding").alias("dimensions"))


@query(_PAGE_CHUNKS + " select product, count(*) n from page_chunks group by 1 union all select 'all', count(*) from page_chunks")
def store_stats(spark, sf):
    found = searchable(spark, sf).stats()
    return spark.createDataFrame([*found["by_product"].items(), ("all", found["total_chunks"])], "product string, n long")


def _kept_documents(spark: SparkSession, sf: str) -> store.Store:
    kept = store.Store(spark, fresh(spark, "store"), 64)
    kept.upsert(_chunk_rows(read(spark, sf, "documents"), F.col("text")).drop("id", "created_at", "updated_at"))
    return kept


@query("select cast(doc_id as varchar) source_url, source product from documents where doc_id not in (0, 7, 11)")
def delete_pages(spark, sf):
    """Three pages deleted from a store of all documents, one of them twice."""
    kept = _kept_documents(spark, sf)
    for url in ("0", "7", "11", "7"):
        kept.delete(url)
    return kept.chunks().select("source_url", "product")


@query("select cast(doc_id as varchar) source_url, source product from documents where doc_id not in (0, 7, 11)")
def delete_compacted(spark, sf):
    """As ``delete_pages``, with the store's buckets written anew afterwards."""
    kept = _kept_documents(spark, sf)
    for url in ("0", "7", "11", "7"):
        kept.delete(url)
    kept.compact()
    return kept.chunks().select("source_url", "product")


def _upserted(spark: SparkSession, sf: str, compact: bool) -> DataFrame:
    """Two of three documents are stored; every second, and all that are not stored, come anew, through the store."""
    d = read(spark, sf, "documents")
    rows = lambda x, text: _chunk_rows(x, text).drop("id", "created_at", "updated_at")
    kept = store.Store(spark, fresh(spark, "store"), 64)
    kept.upsert(rows(d.where("doc_id % 3 <> 0"), F.col("text")))
    before = kept.chunks().select("source_url", F.col("id").alias("old"), F.col("updated_at").alias("then"))
    kept.upsert(rows(d.where("doc_id % 2 = 0 or doc_id % 3 = 0"), F.concat("text", F.lit("!"))))
    if compact:
        kept.compact()
    told = kept.chunks().join(before, "source_url", "left")
    touched = F.when(F.col("old").isNull(), "new").when(F.col("updated_at") > F.col("then"), "updated").otherwise("kept")
    return told.select("source_url", "content", touched.alias("touched"), F.coalesce(F.col("id") == F.col("old"), F.lit(True)).alias("same_id"), (F.col("created_at") <= F.col("updated_at")).alias("in_order"))


_UPSERTED = """
select cast(doc_id as varchar) source_url, case when doc_id % 2 = 0 or doc_id % 3 = 0 then text || '!' else text end as content,
  case when doc_id % 3 = 0 then 'new' when doc_id % 2 = 0 then 'updated' else 'kept' end touched, true as same_id, true as in_order from documents"""


@query(_UPSERTED)
def upsert_stored(spark, sf):
    """Chunks read through a delta: what was updated is told by its time."""
    return _upserted(spark, sf, False)


@query(_UPSERTED)
def upsert_compacted(spark, sf):
    return _upserted(spark, sf, True)


@query("select cast(doc_id as varchar) source_url, source product, text content from documents where text = (select text from documents where doc_id = 5)")
def chunks_by_hash(spark, sf):
    """All chunks of one content, by its hash."""
    kept = store.Store(spark, fresh(spark, "store"), 64)
    d = read(spark, sf, "documents")
    kept.upsert(_chunk_rows(d, F.col("text")).drop("id", "created_at", "updated_at").withColumn("content_hash", F.sha2("content", 256)))
    return kept.find(d.where("doc_id = 5").select(F.sha2("text", 256)).first()[0]).select("source_url", "product", "content")


@query("select count(*) n, cast(0 as bigint) as vectors, cast(32 as integer) dimensions, cast(0 as bigint) pages from documents")
def migrated_store(spark, sf):
    """A store of documents and their state, moved to another vector size: chunks stay, vectors and page state go."""
    kept = _kept_documents(spark, sf)
    kept.put_state(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"), F.sha2("text", 256).alias("page_hash"), F.lit(1).alias("chunk_count")))
    kept.migrate(32)
    return kept.chunks().agg(F.count("*").alias("n"), F.count("embedding").alias("vectors"), F.lit(kept.dimensions).alias("dimensions"), F.lit(kept.state().count()).cast("long").alias("pages"))


@query("select cast(doc_id as varchar) url, case when doc_id < 5 then sha256(text) end page_hash from documents where doc_id < 5 union all select 'nowhere', null")
def page_hash_lookup(spark, sf):
    """The stored hash of single addresses, one of them unknown."""
    kept = store.Store(spark, fresh(spark, "store"), 64)
    kept.put_state(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"), F.sha2("text", 256).alias("page_hash"), F.lit(1).alias("chunk_count")))
    return spark.createDataFrame([(u, kept.page_hash(u)) for u in ("0", "1", "2", "3", "4", "nowhere")], "url string, page_hash string")


@query(_PAGE_CHUNKS + """,
n as (select source_url url, count(*) chunks from page_chunks group by 1)
select 'site' product, cast(count(chunks) as bigint) updated, cast(0 as bigint) skipped, cast(count(*) - count(chunks) as bigint) empty, cast(1 as bigint) errors, cast(coalesce(sum(chunks), 0) as bigint) chunks
from (select distinct url from pages where html <> '') left join n using (url)""")
def crawl_report(spark, sf):
    """A site of all pages as files in the shared folder, one an address, crawled by its sitemaps, which also name a page that can't be read."""
    where = fresh(spark, "site")
    at = re.sub("^(file:)?/+", "/", where)
    if not at.startswith("/"):
        raise RuntimeError(f"pages are read as files, which {where} does not allow")
    base, name = f"file://{at}/pages", F.sha2("url", 256)
    site = one_each(pages(spark, sf)).select(F.concat(F.substring(name, 1, 2), F.lit("/"), name).alias("path"), F.col("html").alias("body"))
    with Staged(spark) as keep:
        keep.paths.append(where)
        n = web.published(site, f"{at}/pages")
        listed = read(spark, sf, "pages").where("html <> ''").select(F.concat(F.lit(f"{base}/"), F.substring(name, 1, 2), F.lit("/"), name).alias("url")).distinct()
        listed = listed.unionByName(spark.createDataFrame([(f"{base}/none",)], "url string"))
        sitemap = web.published_sitemaps(listed, n + 1, f"{at}/maps", f"file://{at}/maps")
        settings = Settings(dimensions=DIM, store_path=fresh(spark, "store"), fetch_retries=0, fetch_delay=0)
        done = Engine(spark, [Product("site", "Site", base, sitemap_url=sitemap)], settings).crawl()["by_product"]
    return spark.createDataFrame([(k, *(v[n] for n in ("updated", "skipped", "empty", "errors", "chunks"))) for k, v in done.items()], "product string, updated long, skipped long, empty long, errors long, chunks long")


@query(_PAGE_CHUNKS + """,
n as (select source_url url, count(*) chunks from page_chunks group by 1),
known as (select url, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) product from pages where html <> '')
select product, cast(count(chunks) as bigint) updated, cast(count(*) filter (chunks is null) as bigint) empty, cast(coalesce(sum(chunks), 0) as bigint) chunks from known left join n using (url) group by product""")
def ingest_forced(spark, sf):
    """Pages that are all known, ingested once more by force."""
    engine = page_engine(spark, sf)
    p = pages(spark, sf)
    engine.store.put_state(p.select("url", F.col("content_hash").alias("page_hash"), F.lit(1).alias("chunk_count")))
    return engine.ingested(p, force=True).select("product", "updated", "empty", "chunks")


@query("select 'http://h.example/' || page_id as url, page_id as place from pages where html <> '' and page_id < 500")
def discovered_by_links(spark, sf):
    """A site without a sitemap: the first 500 pages that links reach, each page linking to eight."""
    at = lambda k: F.concat(F.lit("http://h.example/"), k.cast("string"))
    n = F.col("page_id")
    links = read(spark, sf, "pages").where("html <> ''").select(at(n).alias("src"), F.posexplode(F.array(*(at(8 * n + k) for k in range(1, 9)))).alias("pos", "dst"))
    maps = spark.createDataFrame([], "url string, xml string")
    found = web.discovered(maps, "http://h.example/sitemap.xml", "http://h.example/0", links)
    return found.select("url", F.col("ordinal").cast("long").alias("place"))


@query("select 'docs/' || source || '/' || doc_id || '.md' as path from documents order by doc_id limit 10")
def first_files(spark, sf):
    """The first ten files of a repository's tree, by their place in the listing."""
    item = F.struct(F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("blob").alias("type"))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item"))))
    listing = read(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.transform(rows, lambda x: x["item"]).alias("tree"))
    return web.first_n(web.tree_files(listing, "docs"), 10, "pos").select("path")
