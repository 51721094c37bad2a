"""The retrieval engine: parsing, chunking, embedding, search, store, sources, streaming."""

import base64
import http.server
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid import __main__ as command
from corvid.config import Settings, SettingsError
from corvid.engine import Engine, Product, as_json
from corvid.functions import text as T
from corvid.operators import chunks, embed, html, markdown, search, store
from corvid.operators.cells import CellIndex
from corvid.operators.ingest import chunked
from corvid.sources import web


def sections(spark, md: str, path: str | None = None) -> list:
    df = spark.createDataFrame([("u/some-file_name.md", path, md)], "url string, file_path string, markdown string")
    return sorted(markdown.sections(df).collect(), key=lambda r: r.pos)


BODY = "This line is long enough to be kept."


@pytest.mark.parametrize(
    ("md", "title", "description"),
    [
        (f"---\ntitle: \"A b\"\nDescription: 'd e'\n---\n# H\n{BODY}", "A b", "d e"),
        (f"---\ntitle:\n---\n# From *H1*\n{BODY}", "From *H1*", ""),
        (f"# Heading one \n{BODY}", "Heading one", ""),
        (BODY, "some file name", ""),
        (f"---\ntitle: x\nno end\n# Real\n{BODY}", "Real", ""),
        (f"---\ntitle: a\n  title: b\n---\n{BODY}", "b", ""),
    ],
)
def test_markdown_titles(spark, md, title, description):
    got = sections(spark, md)
    assert {(r.title, r.description) for r in got} == {(title, description)}


def test_markdown_sections(spark):
    md = f"{BODY}\n# One\n## Two [x](y)\n{BODY}\n- item `c`\n<!-- no -->\n![pic](u)\n#### Four\n{BODY}\n##### five\nabc\nabcd\n"
    got = [(r.heading, r.level, r.text) for r in sections(spark, md)]
    assert got == [("", 0, BODY), ("Two x", 2, f"{BODY} item c"), ("Four", 4, f"{BODY} ##### five abcd")]


@pytest.mark.parametrize(("n", "kept"), [(20, False), (21, True)])
def test_section_boundary(spark, n, kept):
    assert (len(sections(spark, f"# T\n{'x' * n}\n## Z\n{BODY}")) == 2) == kept


@pytest.mark.parametrize(("last", "kept"), [("", False), ("\nx", True)])
def test_markdown_fallback(spark, last, kept):
    """Lines too short to count one by one, 30 or 31 characters together."""
    md = "\n".join(["ab"] * 9 + ["abc"]) + last
    text = md.replace("\n", " ")
    assert (len(text) > 30) == kept
    assert [(r.heading, r.level, r.text) for r in sections(spark, md)] == ([("some file name", 1, text)] if kept else [])


def test_fences(spark):
    md = f"# A\n```py\n# not a heading\n\n  code {'z' * 300}\n~~~\n{BODY}\n```\n# swallowed\n{BODY}"
    got = sections(spark, md)
    code = f"# not a heading   code {'z' * 300}"[:200]
    assert [(r.heading, r.text) for r in got] == [("A", " ".join(f"[code: {code}] {BODY}".split()))]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("![alt](u) text", "!alt text"), ("![](u) text", "text"), ("foo_bar_baz", "foobarbaz"), ("**b** *i* ***bi***", "b i bi"),
        ("a <b>c</b> [l](m)", "a c l"), ("> quote", "quote"), ("12. item", "item"), ("---", ""), ("`x`  y", "x y"), ("a ﻿b", "a b"),
    ],
)
def test_clean_markdown(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "x string").select(T.clean_markdown(F.col("x"))).first()[0] == clean


def test_html_page():
    page = html.parse_page(
        "<html><head><title>T</title><meta property='og:title' content='OG'><meta name=description content='D'></head><body><nav><p>menu menu menu menu menu</p></nav>"
        "<header><h1>In header</h1></header><main><h1>Main&amp;</h1><p>First paragraph is unclosed<p>Second <b>bold</b><br>joined paragraph text"
        "<ul><li><p>nested item text</p></ul><div class='sidebar'>gone</div><div id=my-cookie-x>gone</div><h5>ignored</h5><pre><code>x = 1</code></pre><h2>Short</h2><p>tiny</p></main>"
        "<a href='/a#f'>l</a><a href='mailto:x@y'>m</a></body></html>",
        "http://h/p/",
    )
    assert (page["title"], page["description"]) == ("OG", "D")
    assert [(s["heading"], s["level"], s["text"]) for s in page["sections"]] == [("Main&", 1, "First paragraph is unclosed Second boldjoined paragraph text nested item text nested item text x = 1 x = 1")]
    assert page["links"] == ["http://h/a", "mailto:x@y"]


@pytest.mark.parametrize(("n", "kept"), [(50, 0), (51, 1)])
def test_html_fallback(n, kept):
    page = html.parse_page(f"<body><div>{'y' * n}</div></body>", "u")
    assert len(page["sections"]) == kept
    assert page["title"] == "u"
    if kept:
        assert page["sections"][0]["heading"] == "u" and page["sections"][0]["level"] == 1


def test_a_quotation_mark_that_was_cut():
    page = html.parse_page(f"<title>A = &quot</title><article><h1>B = &quot</h1><p>{BODY} &quot;x&quot; &quot y &am</p></article>", "u")
    assert page["title"] == "A = &quot" and page["sections"][0]["heading"] == "B = &quot" and page["sections"][0]["text"] == f'{BODY} "x" " y &'


def test_an_ampersand_that_was_cut():
    page = html.parse_page("<title>A &amp;&am</title><h1>A &amp;&am</h1><p>R&amplifier &amp;amp; a &am that is in a text &amp</p>", "u")
    assert page["title"] == "A &&" and page["sections"][0]["heading"] == "A &&"
    assert page["sections"][0]["text"] == "R&lifier &amp; a &am that is in a text &"


def test_noindex(spark):
    rows = [("a", '<meta name="robots" content="noindex, follow"><p>x'), ("b", '<meta name="robots" content="NOINDEX"><p>x')]
    assert [r.url for r in html.parsed(spark.createDataFrame(rows, "url string, html string")).collect()] == ["b"]


def plain_chunks(texts: list[str], size: int, overlap: int) -> list[str]:
    """Chunking, written out."""
    import re

    tail = lambda t: t[-4 * overlap :] if overlap else ""
    out, before = [], ""
    for text in texts:
        if -(-len(text) // 4) <= size:
            parts = [f"{before} {text}" if before else text]
        else:
            parts, held = [], f"{before} " if before else ""
            for s in [x for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]:
                if -(-len(held + s + " ") // 4) > size and held.strip():
                    parts.append(held.strip())
                    held = tail(held) + (" " if overlap else "") + s + " "
                else:
                    held += s + " "
            if held.strip():
                parts.append(held.strip())
        out += [p.strip() for p in parts if -(-len(p) // 4) >= 20]
        before = tail(text)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(100, 20), (25, 5), (100, 0)])
def test_chunks(spark, size, overlap):
    one = "A sentence of some length that ends here."
    texts = [one, " ".join([one] * 50), "x" * 76, "y" * 77, "Z" * 900 + ". " + one, one, "w" * (4 * size), "v" * (4 * size + 1)]
    df = spark.createDataFrame([("u", "t", k, "", t) for k, t in enumerate(texts)], "url string, title string, pos int, heading string, text string")
    got = sorted(chunks.chunked(df, Settings(chunk_size=size, chunk_overlap=overlap)).collect(), key=lambda r: r.chunk_index)
    assert [r.content for r in got] == plain_chunks(texts, size, overlap)
    assert [r.chunk_index for r in got] == list(range(len(got))) and {r.section for r in got} == {"t"}


def test_units(spark):
    df = spark.createDataFrame([("a😀",), ("abc",)], "x string")
    assert [r[0] for r in df.select(T.units(F.col("x"))).collect()] == [3, 3]
    assert [r[0] for r in df.select(T.tail_units(F.col("x"), 2)).collect()] == ["😀", "bc"]
    long = spark.createDataFrame([("s" * 800,), ("s" * 801,)], "x string").select(T.snippet(F.col("x"))).collect()
    assert [len(r[0]) for r in long] == [800, 801] and long[1][0].endswith("…")


def test_embedding_provider(spark):
    p = embed.provider("hashing", dimensions=32)
    assert p.embed([]) == [] and len(p.embed(["a b", "c"])) == 2
    df = spark.createDataFrame([("t", "s", "gateway gateway"), ("t", "s", "")], "title string, section string, content string")
    got = embed.embedded(df, p).collect()
    assert got[0].embedding == p.embed(["t\ns\ngateway gateway"])[0]
    with pytest.raises(ValueError):
        embed.provider("nothing")


def test_retry():
    import urllib.error

    waits, answers = [], [503, 429, None]

    def call():
        code = answers.pop(0)
        if code:
            raise urllib.error.HTTPError("u", code, "", {}, None)
        return "done"

    assert embed.with_retry(call, sleep=waits.append) == "done" and [int(w) for w in waits] == [1, 2]
    answers[:] = [400]
    with pytest.raises(urllib.error.HTTPError):
        embed.with_retry(call, sleep=waits.append)


def test_search(spark, tmp_path):
    rows = [("p", "u3", 0, [1.0, 0.0]), ("p", "u1", 0, [1.0, 0.0]), ("q", "u2", 0, [0.6, 0.8]), ("p", "u4", 0, None), ("p", "u5", 0, [0.0, 0.0]), ("p", "u6", 0, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "product string, source_url string, chunk_index int, embedding array<float>")
    names = lambda **o: [r.source_url for r in search.nearest(df, [2.0, 0.0], **o).collect()]
    assert names() == ["u1", "u3", "u2", "u6"] and names(limit=1) == ["u1"] and names(product="q") == ["u2"] and names(limit=3, min_score=0.9) == ["u1", "u3"]
    index = CellIndex.build(df, str(tmp_path / "cells"), lists=3)
    assert [r.source_url for r in index.search([2.0, 0.0], 4).collect()] == names()
    again = CellIndex(spark, str(tmp_path / "cells"))
    one = again.search([2.0, 0.0], 1, first=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0] and again.cells_read == 1
    assert [r.source_url for r in one.collect()] == ["u1"]


def _mixed_vectors(n=400, seed=3):
    """Vectors about a few directions, of three lengths, some without direction, some equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(20)]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(15)] + [(2000, [0.0] * 16), (2001, None), (2002, [1.0]), (2003, [float("nan")] * 16), (2004, []), (2005, [None] * 16)]
    return rows


def _plain_nearest(rows, queries, limit):
    out = set()
    unit = lambda v: None if not v or None in v or not np.isfinite(v).all() or not np.any(v) else np.asarray(v) / np.linalg.norm(v)
    for q, v in queries:
        x = unit(v)
        if x is None:
            continue
        found = sorted((-round(float(x @ y), 9), k) for k, w in rows if (y := unit(w)) is not None and len(y) == len(x))
        out |= {(q, k, -s, r + 1) for r, (s, k) in enumerate(found[:limit])}
    return out


@pytest.mark.parametrize("how", [{}, {"block": 7, "part": 60}, {"block": 100, "part": 10**6}])
def test_many_queries_of_any_lengths(spark, how):
    """Both ways of asking, and queries and rows of several lengths, against a plain search."""
    rows = _mixed_vectors()
    queries = [(3000, [1.0, 2.0]), *[(k, v) for k, v in rows[::-1] if k % 7 == 0 or k > 999]]
    df, asked = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, queries))
    got = {(r["query"], r.vec_id, round(r.score, 9), r["rank"]) for r in search.nearest_each(df, asked, 5, **how).collect()}
    assert got == _plain_nearest(rows, queries, 5)


@pytest.mark.parametrize("block", [2048, 10])
def test_cells_give_the_exact_answer(spark, tmp_path, block):
    """As a search over all rows, though most cells are left out."""
    rows = _mixed_vectors()
    queries = [(k, v) for k, v in rows if k % 9 == 0 or k > 999]
    df, asked = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, queries))
    index = CellIndex.build(df, str(tmp_path / "cells"), lists=24)
    found = index.search_each(asked, 5, block=block, part=50).collect()
    assert {(r["query"], r.vec_id, round(r.score, 9), r["rank"]) for r in found} == _plain_nearest(rows, queries, 5)
    read = [r.cells for r in found if r["rank"] == 1 and r["query"] < 1000]
    assert max(read) < 24 and np.mean(read) < 8
    for q, v in queries[:6]:
        one = [r.vec_id for r in index.search(v, 5, ties=("vec_id",)).select("vec_id").collect()]
        assert one == [k for k, _ in sorted(((k, r) for k2, k, _, r in _plain_nearest(rows, [(q, v)], 5)), key=lambda x: x[1])] and index.cells_read < 24
    assert CellIndex.build(df.where("vec_id < 0"), str(tmp_path / "none"), lists=4).search_each(asked, 5).count() == 0


def test_batch_search_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 4), 1.0, float(i)]) for i in range(1, 12)] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [1.0])], "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in search.nearest_each(rows, rows, 3).collect()}
    assert {tuple(r) for r in search.nearest_each(rows, rows, 3, block=3).collect()} == whole
    assert len(whole) == 11 * 3 + 1 and all(q == k for q, k, _, rank in whole if rank == 1)
    assert search.nearest_each(rows, rows.where("vec_id < 0"), 3).count() == 0


def test_cache():
    now = [0.0]
    c = search.Cache(2, 10, lambda: now[0])
    c.set("a", 1)
    c.set("b", 2)
    assert c.get("a") == 1
    c.set("c", 3)
    assert c.get("b") is None and c.get("a") == 1
    now[0] = 11
    assert c.get("a") is None


def _rows(spark, keys, content="x"):
    rows = [("p", "t", "s", u, i, content, None, "h", [1.0, 2.0]) for u, i in keys]
    return spark.createDataFrame(rows, "product string, title string, section string, source_url string, chunk_index int, content string, version string, content_hash string, embedding array<float>")


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 2)
    assert s.check() and s.stats() == {"total_chunks": 0, "by_product": {}} and s.page_hash("u") is None
    s.upsert(_rows(spark, [("u", k) for k in range(110)]))
    first = {r.chunk_index: (r.id, r.created_at) for r in s.chunks().collect()}
    assert s.stats()["total_chunks"] == 110
    s.upsert(_rows(spark, [("u", 3), ("v", 0)], "new"))
    again = {(r.source_url, r.chunk_index): r for r in s.chunks().collect()}
    assert len(again) == 111 and again["u", 3].content == "new" and (again["u", 3].id, again["u", 3].created_at) == first[3]
    assert s.delete("u") == 110 and s.delete("u") == 0 and s.stats() == {"total_chunks": 1, "by_product": {"p": 1}}
    s.set_page_hash("v", "h1", 1)
    s.set_page_hash("v", "h2", 2)
    assert s.page_hash("v") == "h2" and s.crawled().count() == 1
    assert not s.migrate(2) and s.migrate(3) and s.dimensions == 3 and s.chunks().where("embedding is not null").count() == 0
    assert store.Store(spark, str(tmp_path / "s")).version == s.version


def _files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def test_store_writes_touched_buckets_only(spark, tmp_path):
    at = tmp_path / "s"
    s = store.Store(spark, str(at), 2, buckets=16)
    s.upsert(_rows(spark, [(f"u{k}", 0) for k in range(200)]))
    first = _files(at)
    s.upsert(_rows(spark, [("u7", 0)], "new"))
    more = _files(at) - first
    assert first < _files(at) and len(more) == 1 and "bucket=" in more.pop()
    assert s.stats()["total_chunks"] == 200 and s.chunks().where("content = 'new'").count() == 1
    before, chunks = s.version, {f for f in _files(at) if f.startswith("chunks")}
    assert s.vacuum(keep=1) == 0 and s.version == before  # the first folder still holds the other buckets
    assert s.delete("u7") == 1 and s.vacuum(keep=1) == 0 and s.stats()["total_chunks"] == 199
    assert {f for f in _files(at) if f.startswith("chunks")} == chunks  # a delete writes no chunk
    assert s.compact() and not s.compact() and s.vacuum(keep=1) == 2 and s.stats()["total_chunks"] == 199


def test_deltas_read_as_if_written_anew(spark, tmp_path):
    """Upserts, page replacements and deletes in any order, against a plain dictionary, with and without compaction on the way."""
    rng = random.Random(4)
    stores = [store.Store(spark, str(tmp_path / str(n)), 2, buckets=3, most_deltas=n) for n in (1, 50)]
    held, ids = {}, {}
    for step in range(7):
        kind, pages = rng.choice(["upsert", "replace", "delete"] if step else ["upsert"]), [f"u{rng.randrange(6)}" for _ in range(3)]
        keys = sorted({(u, rng.randrange(4)) for u in pages for _ in range(2)})
        for s in stores:
            if kind == "upsert":
                s.upsert(_rows(spark, keys, f"c{step}"))
            elif kind == "replace":
                s.replace_pages(_rows(spark, keys, f"c{step}"), spark.createDataFrame([(u, f"h{step}") for u in set(pages)], "url string, content_hash string"))
            else:
                assert s.delete(pages[0]) == sum(u == pages[0] for u, _ in held)
        if kind == "replace":
            held = {k: v for k, v in held.items() if k[0] not in pages}
        held = {k: v for k, v in held.items() if k[0] != pages[0]} if kind == "delete" else held | dict.fromkeys(keys, f"c{step}")
        for s in stores:
            got = {(r.source_url, r.chunk_index): r for r in s.chunks().collect()}
            assert {k: r.content for k, r in got.items()} == held
            if kind == "upsert":
                assert all(got[k].id == ids[s, k] for k in keys if (s, k) in ids)
            ids = {k: v for k, v in ids.items() if k[0] is not s} | {(s, k): r.id for k, r in got.items()}
    assert len(stores[1]._manifest()["deltas"]) == 6 and len(stores[0]._manifest()["deltas"]) < 6
    assert stores[1].compact() and {(r.source_url, r.chunk_index): r.content for r in stores[1].chunks().collect()} == held


def _shuffled(spark):
    """Bytes of shuffle that the session has written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_a_chunk_moves_once_a_write(spark, tmp_path):
    """An upsert shuffles its texts once, a compaction those of all versions once."""
    n, size = 300, 20_000
    text = lambda u, k: base64.b85encode(random.Random(f"{u} {k}").randbytes(size * 4 // 5)).decode()  # noqa: E731  which LZ4 leaves as long as it is
    rows = lambda keys, k: _rows(spark, keys).withColumn("content", F.udf(text, "string")("source_url", F.lit(k)))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        s, moved = store.Store(spark, str(tmp_path / "s"), 2, buckets=4), []
        for work in (lambda: s.upsert(rows([(f"u{k}", 0) for k in range(n)], 0)), lambda: s.upsert(rows([(f"u{k}", 0) for k in range(n // 2, n + n // 2)], 1)), s.compact):
            before = _shuffled(spark)
            work()
            moved.append((_shuffled(spark) - before) / (n * size))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert moved[0] < 1.2 and moved[1] < 1.2 and moved[2] < 2.2, moved
    got = {x.source_url: x.content for x in s.chunks().select("source_url", "content").collect()}
    assert got == {f"u{k}": text(f"u{k}", int(k >= n // 2)) for k in range(n + n // 2)}


def test_filters_are_of_the_size_of_their_values(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 2, buckets=4)
    s.upsert(_rows(spark, [(f"u{k}", 0) for k in range(400)]).withColumn("content_hash", F.col("source_url")))
    files = list((tmp_path / "s").rglob("*.parquet"))
    assert len(files) == 4 and max(f.stat().st_size for f in files) < 20_000
    assert [x.source_url for x in s.find("u17").collect()] == ["u17"]


def test_compaction_leaves_what_a_read_leaves(spark, tmp_path):
    """A page dropped and brought again, chunks of one place twice in a write, repeated keys within an upsert."""
    s = store.Store(spark, str(tmp_path / "s"), 2, buckets=2, most_deltas=50)
    page = lambda *urls: spark.createDataFrame([(u, "h") for u in urls], "url string, content_hash string")
    s.upsert(_rows(spark, [(u, k) for u in "abcd" for k in range(3)], "first").unionByName(_rows(spark, [("a", 0)], "greater")))
    s.replace_pages(_rows(spark, [("b", 0), ("b", 0), ("b", 5)], "second"), page("b"))
    s.delete("c")
    s.upsert(_rows(spark, [("c", 1), ("e", 0)], "third"))
    s.delete("d")
    s.delete("b")
    s.replace_pages(_rows(spark, [("b", 1), ("b", 1)], "fourth"), page("b"))
    shown = lambda: sorted((r.source_url, r.chunk_index, r.content, r.id, r.created_at, r.updated_at) for r in s.chunks().collect())
    before = shown()
    assert [x[:3] for x in before] == [("a", 0, "greater"), ("a", 1, "first"), ("a", 2, "first"), ("b", 1, "fourth"), ("b", 1, "fourth"), ("c", 1, "third"), ("e", 0, "third")]
    assert s.compact() and not s._manifest()["deltas"] and shown() == before


def test_change_reads_the_state_of_its_buckets(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 2, buckets=16)
    s.put_state(spark.createDataFrame([(f"u{k}", f"h{k}", 1) for k in range(200)], "url string, page_hash string, chunk_count int"))
    pages = spark.createDataFrame([("u7", "h7")], "url string, content_hash string")
    read = s.changed(pages)
    assert read.count() == 0 and len([f for f in read.inputFiles() if "/state/" in f]) == 1
    assert [r.url for r in s.changed(spark.createDataFrame([("u7", "x"), ("u8", "h8"), ("new", "h")], "url string, content_hash string")).orderBy("url").collect()] == ["new", "u7"]


def test_index_of_the_store(spark, tmp_path):
    """Searches through the index are those over all chunks after every kind of write; a page's write touches its cells only; a grown cell is split."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 8))

    def rows(keys, near=None, content="x"):
        vectors = [(centres[rng.integers(10) if near is None else near] + 0.1 * rng.normal(size=8)).tolist() for _ in keys]
        made = [("p" if k % 2 else "q", "t", "s", u, k, content, None, "h", v) for (u, k), v in zip(keys, vectors, strict=True)]
        return spark.createDataFrame(made, "product string, title string, section string, source_url string, chunk_index int, content string, version string, content_hash string, embedding array<float>")

    def same(s):
        for q in (centres[0], centres[7] + 0.3, -centres[3]):
            for options in ({}, {"product": "q"}, {"min_score": 0.9}):
                plain = search.nearest(s.chunks(), q.tolist(), 5, options.get("product"), options.get("min_score")).collect()
                got = s.nearest(q.tolist(), 5, **options).collect()
                assert [(r.source_url, r.chunk_index, r.score, r.content) for r in got] == [(r.source_url, r.chunk_index, r.score, r.content) for r in plain]

    s = store.Store(spark, str(tmp_path / "s"), 8, buckets=4, most_deltas=3)
    s.build_index(lists=4)
    assert s._manifest()["index"] is None
    s.upsert(rows([(f"u{k % 60}", k) for k in range(600)]))
    s.build_index(lists=20, split_from=300)
    same(s)
    assert s.cells_read < 15
    before = s._manifest()["index"]["cells"]
    s.replace_pages(rows([("u3", 0), ("u3", 1)], near=2, content="new"), spark.createDataFrame([("u3", "h")], "url string, content_hash string"))
    after = s._manifest()["index"]["cells"]
    assert 1 <= len([c for c in after if after[c] != before.get(c)]) <= 2
    same(s)
    s.delete("u5")
    assert s._manifest()["index"]["cells"] == after
    same(s)
    s.upsert(rows([("u9", 9), ("v", 1)], content="newer"))
    s.compact()
    same(s)
    live_rows = s.chunks().count()
    assert sum(p["rows"] for x in s._manifest()["index"]["cells"].values() for p in x) == live_rows
    n = len(s._manifest()["index"]["cells"])
    s.upsert(rows([(f"w{k}", k) for k in range(1500)], near=4))
    assert len(s._manifest()["index"]["cells"]) > n
    same(s)
    s.vacuum(keep=1)
    same(s)


def test_stream_batches_are_taken_once(spark, tmp_path, monkeypatch):
    """A failure after the version is made and before the stream notes it: the batch comes again and makes no second version."""
    e = Engine(spark, [Product("p", "P", "http://e")], Settings(store_path=str(tmp_path / "e"), dimensions=16))
    rows = [("http://e/a", "p", "1", "# A\n" + BODY * 4), ("http://e/b", "p", "1", "nothing")]
    pages = spark.createDataFrame(rows, "url string, product string, version string, markdown string").withColumn("content_hash", F.sha2("markdown", 256))
    pages.write.parquet(str(tmp_path / "in"))
    schema = pages.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    replace = store.Store.replace_pages

    def failing(self, *a, **k):
        replace(self, *a, **k)
        raise OSError("lost after the version")

    with monkeypatch.context() as m:
        m.setattr(store.Store, "replace_pages", failing)
        with pytest.raises(Exception, match="lost after"):
            e.follow(str(tmp_path / "in"), schema, str(tmp_path / "cp"))
    made = e.store.version
    assert made == 1 and e.stats()["total_chunks"] == 1
    e.follow(str(tmp_path / "in"), schema, str(tmp_path / "cp"))
    assert e.store.version == made
    spark.createDataFrame([("http://e/c", "p", "1", "too little", "h")], pages.schema).write.mode("append").parquet(str(tmp_path / "in"))
    e.follow(str(tmp_path / "in"), schema, str(tmp_path / "cp"))
    assert e.store.version == made + 1 and e.stats()["total_chunks"] == 1  # marked, though no page had chunks


def test_find_by_content(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 2, buckets=4)
    s.upsert(_rows(spark, [(f"u{k}", 0) for k in range(40)]).withColumn("content_hash", F.col("source_url")))
    assert [r.source_url for r in s.find("u17").collect()] == ["u17"] and s.find("none").count() == 0


def test_store_grows_its_buckets(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 2, buckets=2, most_rows=10)
    s.upsert(_rows(spark, [(f"u{k}", 0) for k in range(100)]))
    s.upsert(_rows(spark, [("u7", 0), ("v", 0)], "new"))
    assert s._manifest()["buckets"] == 16 and s.stats()["total_chunks"] == 101 and s.delete("u7") == 1


def test_two_writers_both_land(spark, tmp_path, monkeypatch):
    one, other = (store.Store(spark, str(tmp_path / "s"), 2) for _ in range(2))
    publish, raced = store.Store._publish, []

    def slow(self, manifest):
        if self is one and not raced:
            raced.append(1)
            other.upsert(_rows(spark, [("theirs", 0)]))
        return publish(self, manifest)

    monkeypatch.setattr(store.Store, "_publish", slow)
    one.upsert(_rows(spark, [("mine", 0)]))
    assert {r.source_url for r in one.chunks().collect()} == {"mine", "theirs"} and one.version == 2


def test_engine(spark, tmp_path):
    products = [Product("en", "English", "http://e", version="1"), Product("de", "German", "http://d")]
    e = Engine(spark, products, Settings(store_path=str(tmp_path / "e"), dimensions=64))
    text = "The gateway routes every request to a service behind it, quickly and safely. "
    rows = [("http://e/a", "en", "1", f"# Gateway\n{text * 3}"), ("http://d/b", "de", None, f"# Other\n{'Something else entirely is written in here today. ' * 3}"), ("http://d/c", "de", None, "nothing")]
    pages = spark.createDataFrame(rows, "url string, product string, version string, markdown string").withColumn("content_hash", F.sha2("markdown", 256))
    assert e.search("gateway").count() == 0
    done = e.ingest(pages)
    assert {k: v for k, v in done.items() if k != "by_product"} == {"updated": 2, "skipped": 0, "empty": 1, "errors": 0, "chunks": 2}
    assert done["by_product"] == {"en": {"updated": 1, "skipped": 0, "empty": 0, "errors": 0, "chunks": 1}, "de": {"updated": 1, "skipped": 0, "empty": 1, "errors": 0, "chunks": 1}}
    assert e.ingest(pages)["skipped"] == 2 and e.ingest(pages, force=True)["updated"] == 2
    assert e.stats() == {"total_chunks": 2, "by_product": {"en": 1, "de": 1}}
    assert e.search("gateway request service").first().source_url == "http://e/a"
    assert e.guide("gateway", "de").first().product == "de" and e.explain("gateway").count() == 2
    shown = json.loads(as_json(e.explain("gateway"), "gateway"))
    assert set(shown) == {"concept", "context", "note"} and "snippet" in shown["context"][0]
    assert [r.id for r in e.products().collect()] == ["en", "de"]
    for bad in ({"query": ""}, {"query": "x", "product": "zz"}, {"query": "x", "limit": 0}, {"query": "x", "limit": 21}):
        with pytest.raises(ValueError):
            e.search(**bad)
    ordered = pages.withColumn("ordinal", F.length("url")).withColumn("markdown", F.concat("markdown", F.lit(" Once more."))).withColumn("content_hash", F.sha2("markdown", 256))
    assert e.ingest(ordered, product="en", limit=5)["updated"] == 1 and e.ingest(ordered, limit=1)["updated"] <= 1
    folder = tmp_path / "in"
    pages.withColumn("markdown", F.concat("markdown", F.lit(" And more of it."))).withColumn("content_hash", F.sha2("markdown", 256)).write.parquet(str(folder))
    e.follow(str(folder), pages.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), str(tmp_path / "cp"))
    assert any("And more of it" in r.content for r in e.store.chunks().collect())


def test_urls(spark):
    urls = ["http://h/docs/a", "http://h/docs/a", "HTTP://H/docs/b", "http://h/docs/c.PDF", "http://h/docs/assets/x", "http://h/docs-x", "http://o/"]
    got = web.filter_urls(spark.createDataFrame([(u, k) for k, u in enumerate(urls)], "url string, n int"), "http://h/docs", "n").collect()
    assert sorted(r.url for r in got) == sorted({"http://h/docs/a", "HTTP://H/docs/b", "http://h/docs-x"})


def test_sitemap(spark):
    maps = [("root", '<?xml version="1.0"?><sitemapindex xmlns="n"><sitemap><loc>one</loc></sitemap><sitemap><loc> two </loc></sitemap></sitemapindex>'), ("one", "<urlset><url><loc>http://h/?a=1&amp;b</loc><image:loc>no</image:loc></url><url><loc> </loc></url></urlset>"), ("two", "<urlset><url><loc>http://h/2</loc></url>")]
    df = spark.createDataFrame(maps, "url string, xml string")
    assert [r.url for r in web.sitemap_urls(df, "root").orderBy("ordinal").collect()] == ["http://h/?a=1&b", "http://h/2"]
    links = spark.createDataFrame([("http://h/", 0, "http://h/z")], "src string, pos int, dst string")
    assert web.discovered(df, "root", "http://h/2", links).count() == 1
    assert [r.url for r in web.discovered(df, "missing", "http://h/", links).collect()] == ["http://h/"]


def test_reachable(spark):
    edges = [("http://h/", 0, "http://h/b"), ("http://h/", 1, "http://h/a"), ("http://h/a", 0, "http://h/c"), ("http://h/b", 0, "http://h/"), ("http://h/b", 1, "http://h/x.pdf"), ("http://h/c", 0, "http://o/q"), ("http://o/q", 0, None)]
    df = spark.createDataFrame(edges, "src string, pos int, dst string")
    assert [r.url for r in web.reachable(df, "http://h/").orderBy("ordinal").collect()] == ["http://h/", "http://h/b", "http://h/a", "http://h/c"]
    assert web.reachable(df, "http://h/", most=2).count() == 2
    many = [("http://h/", k, f"http://h/{k}") for k in range(120)] + [("http://h/100", 0, None)]
    found = web.reachable(spark.createDataFrame(many, "src string, pos int, dst string"), "http://h/", most=5)
    assert [tuple(r) for r in found.orderBy("ordinal").collect()] == [("http://h/", 0), ("http://h/100", 1)]
    assert web.reachable(df, "http://h/none").count() == 0


def test_tree_and_folder(spark, tmp_path):
    item = lambda p, t="blob": {"path": p, "type": t}
    df = spark.createDataFrame([([item("docs/a.md"), item("docs/reindex.md"), item("docs/x", "tree"), item("docs/img/b.md"), item("other/c.md"), item("docs/d.txt")],)], "tree array<struct<path: string, type: string>>")
    assert [r.path for r in web.tree_files(df, "docs").collect()] == ["docs/a.md"]
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "sub" / "f.md").write_text("x" * 50)
    (tmp_path / "docs" / "g.md").write_text(" " * 30 + "x" * 49)
    got = web.markdown_folder(spark, str(tmp_path), "docs", "http://h/v/").collect()
    assert [(r.url, r.file_path) for r in got] == [("http://h/v/sub/f/", "docs/sub/f.md")]


@pytest.fixture
def site():
    """A server of fixed answers by path; what it was asked, and posted, is kept."""
    answers, asked = {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            asked.append((self.path, json.loads(body) if body else None, dict(self.headers)))
            found = answers.get(self.path, (404, ""))
            code, text = found(asked[-1][1]) if callable(found) else found
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

        do_GET = do_POST = answer

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", answers, asked
    server.shutdown()


def test_fetched(spark, site):
    base, answers, _ = site
    answers |= {"/ok": (200, "body"), "/gone": (410, ""), "/bad": (500, "")}
    urls = spark.createDataFrame([(f"{base}/{x}", x) for x in ("ok", "gone", "bad")], "url string, name string")
    rows = web.fetched(urls, retries=1, delay=0, partitions=2).collect()
    assert {r.name: (r.body, r.error) for r in rows} == {"ok": ("body", None), "gone": (None, None), "bad": (None, "HTTP 500")}


def _page(text, *links):
    return 200, f"<html><head><title>T</title></head><body><main><h1>H</h1><p>{text} {'with many more words in it ' * 5}</p></main>{''.join(f'<a href={x}>l</a>' for x in links)}</body></html>"


def test_crawl(spark, site, tmp_path):
    """Product to store: a sitemap, a walk over links, and a repository, from a server; then only what changed."""
    base, answers, _ = site
    loc = lambda x: f"<loc>{base}{x}</loc>"
    answers |= {
        "/sitemap.xml": (200, f"<sitemapindex><sitemap>{loc('/one.xml')}</sitemap><sitemap>{loc('/none.xml')}</sitemap></sitemapindex>"),
        "/one.xml": (200, f"<urlset><url>{loc('/docs/a')}</url><url>{loc('/docs/b')}</url><url>{loc('/docs/broken')}</url><url>{loc('/other/c')}</url><url>{loc('/docs/hidden')}</url></urlset>"),
        "/docs/a": _page("alpha gateway"), "/docs/b": _page("beta"), "/docs/broken": (500, ""),
        "/docs/hidden": (200, "<meta name=robots content=noindex><p>" + "hidden words " * 20),
        "/nomap.xml": (200, "<urlset></urlset>"),
        "/walk/": _page("start", "/walk/1", "/walk/2", "/walk/x.pdf", "http://elsewhere.invalid/", "/walk/missing"),
        "/walk/1": _page("first", "/walk/3", "/walk/"), "/walk/2": _page("second"), "/walk/3": _page("third"),
        "/repos/o/r/git/trees/main?recursive=1": (200, json.dumps({"tree": [{"path": f"en/docs/{x}", "type": "blob"} for x in ("p.md", "q.md", "images/i.md", "lost.md", "short.md")]})),
        "/o/r/main/en/docs/p.md": (200, "# P\n" + "Repository words stand here. " * 6), "/o/r/main/en/docs/q.md": (200, "# Q\n" + "More repository words stand here. " * 6),
        "/o/r/main/en/docs/lost.md": (500, ""), "/o/r/main/en/docs/short.md": (200, "too short"),
    }
    products = [
        {"id": "map", "name": "Map", "base_url": f"{base}/docs", "version": "2"},
        {"id": "walk", "name": "Walk", "base_url": f"{base}/walk/", "sitemap_url": f"{base}/nomap.xml"},
        {"id": "git", "name": "Git", "base_url": "http://docs.example/v1", "git_source": ["o", "r", "main", "en/docs"]},
        {"id": "down", "name": "Down", "base_url": "http://docs.example/v2", "git_source": ["o", "gone", "main", "docs"]},
    ]
    file = tmp_path / "products.json"
    file.write_text(json.dumps(products))
    options = Settings(store_path=str(tmp_path / "store"), dimensions=32, fetch_retries=0, fetch_delay=0, fetch_partitions=2, git_api=base, git_raw=base)
    run = lambda *args: command.main([*args, "--products", str(file)], spark, options)
    done = run("crawl")["by_product"]
    counts = lambda p: tuple(done[p][k] for k in ("updated", "skipped", "empty", "errors"))
    assert counts("map") == (2, 0, 1, 1) and counts("walk") == (4, 0, 0, 0) and counts("git") == (2, 0, 0, 1) and counts("down") == (0, 0, 0, 1)
    engine = Engine(spark, command.products_from(str(file)), options)
    urls = {r.source_url: r.version for r in engine.store.chunks().collect()}
    assert urls == {f"{base}/docs/a": "2", f"{base}/docs/b": "2", f"{base}/walk/": None, f"{base}/walk/1": None, f"{base}/walk/2": None, f"{base}/walk/3": None, "http://docs.example/v1/p/": None, "http://docs.example/v1/q/": None}
    answers["/docs/b"] = _page("beta changed")
    done = run("reindex", "--product", "map")["by_product"]
    assert list(done) == ["map"] and counts("map") == (1, 1, 1, 1)
    assert run("crawl", "--product", "git", "--limit", "1", "--force")["updated"] == 1
    assert run("stats")["total_chunks"] == 8 and run("migrate") == {"migrated": False}
    import datetime

    waits = []
    done = engine.reindex_daily(2, 0, times=2, now=lambda: datetime.datetime(2026, 1, 1, 1, 0), sleep=waits.append)
    assert waits == [3600.0, 3600.0] and all(r["by_product"]["map"]["skipped"] == 2 for r in done)


def test_embedding_services(site):
    """Each service's requests and answers, from a stub."""
    base, answers, asked = site
    answers |= {
        "/openai": lambda b: (200, json.dumps({"data": [{"embedding": [float(len(t)), b["dimensions"]]} for t in b["input"]]})),
        "/models/m:batchEmbedContents": lambda b: (200, json.dumps({"embeddings": [{"values": [float(len(r["content"]["parts"][0]["text"])), 1.0]} for r in b["requests"]]})),
        "/voyage": lambda b: (200, json.dumps({"data": [{"embedding": [float(len(t)), 2.0]} for t in b["input"]]})),
    }
    texts = ["a" * (k % 7) for k in range(205)]
    assert embed.openai("k1", url=f"{base}/openai", dimensions=2).embed(texts) == [[float(len(t)), 2.0] for t in texts]
    assert [len(b["input"]) for p, b, h in asked] == [100, 100, 5] and asked[0][2]["Authorization"] == "Bearer k1" and asked[0][1]["model"] == "text-embedding-3-small"
    assert embed.gemini("k2", model="m", url=base).embed(["abc"]) == [[3.0, 1.0]] and asked[-1][2]["X-Goog-Api-Key"] == "k2" and asked[-1][1]["requests"][0]["taskType"] == "RETRIEVAL_DOCUMENT"
    assert embed.voyage("k3", url=f"{base}/voyage").embed(["ab"]) == [[2.0, 2.0]] and asked[-1][1]["input_type"] == "document"
    busy = [503, 429]
    answers["/voyage"] = lambda b: (busy.pop(), "") if busy else (200, json.dumps({"data": [{"embedding": [1.0]}]}))
    assert embed.voyage("k3", url=f"{base}/voyage").embed(["ab"]) == [[1.0]]


def test_ollama(site):
    base, answers, asked = site
    models = ["other:latest"]
    answers["/api/tags"] = lambda b: (200, json.dumps({"models": [{"name": m} for m in models]}))
    answers["/api/pull"] = lambda b: (models.append(b["name"] + ":latest"), (200, '{"status": "pulling"}\nnote\n{"status": "success"}\n'))[1]
    answers["/api/embed"] = lambda b: (200, json.dumps({"embeddings": [[float(len(t))] for t in b["input"]]}))
    p = embed.ollama(base, "m", 1)
    assert p.resolved() is p and models == ["other:latest", "m:latest"] and p.embed(["abc", ""]) == [[3.0], [0.0]]
    assert p.resolved() is p and [x[0] for x in asked].count("/api/pull") == 1
    answers["/api/pull"] = (200, '{"error": "no such model"}\n')
    with pytest.raises(OSError, match="no such model"):
        embed.ollama(base, "n", 1).resolved()
    nowhere = "http://127.0.0.1:9"
    instead = embed.Hashing(1)
    assert embed.ollama(nowhere, "m", 1, fallback=instead).resolved() is instead
    with pytest.raises(OSError):
        embed.ollama(nowhere, "m", 1).resolved()
    with pytest.raises(ValueError):
        embed.ollama(nowhere, "m", 2, fallback=instead).resolved()


def test_accelerator():
    assert embed.accelerator("Darwin", "arm64", lambda: True).batch == 32
    assert embed.accelerator("Linux", "x86_64", lambda: True).providers[0] == "CUDAExecutionProvider"
    assert embed.accelerator("Linux", "x86_64", lambda: False) == embed.CPU == embed.accelerator("Darwin", "x86_64", lambda: False)


def test_settings():
    assert Settings.from_env({"CORVID_CHUNK_SIZE": "12", "CORVID_PROVIDER": "onnx"}) == Settings(chunk_size=12, provider="onnx")
    for bad in ({"CORVID_CHUNK_SIZE": "x"}, {"CORVID_TOP_K": "0"}):
        with pytest.raises(SettingsError):
            Settings.from_env(bad)


def test_html_chunks(spark):
    rows = [("http://h/p", "en", None, f"<article><h1>T</h1><p>{'Long enough text for a chunk here. ' * 4}</article>")]
    got = chunked(spark.createDataFrame(rows, "url string, product string, version string, html string")).collect()
    assert [(r.source_url, r.product, r.section, r.chunk_index) for r in got] == [("http://h/p", "en", "T", 0)]


def _proto(*fields) -> bytes:
    """A message of (number, value) fields, values being whole numbers, texts or bytes."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    parts = []
    for number, value in fields:
        if isinstance(value, int):
            parts.append(varint(number << 3) + varint(value))
        else:
            value = value.encode() if isinstance(value, str) else value
            parts.append(varint(number << 3 | 2) + varint(len(value)) + value)
    return b"".join(parts)


def test_onnx_provider(tmp_path):
    """A model that looks each token's vector up in a table; the provider's answer is their mean under the mask, of unit length."""
    np = pytest.importorskip("numpy")
    pytest.importorskip("onnxruntime")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    table = np.random.default_rng(0).normal(size=(tok.get_vocab_size(), 3)).astype("<f4")
    ranked = lambda name, kind, *dims: _proto((1, name), (2, _proto((1, _proto((1, kind), (2, _proto(*((1, _proto((2, d))) for d in dims))))))))
    node = _proto((1, "table"), (1, "input_ids"), (2, "out"), (4, "Gather"))
    weights = _proto((1, table.shape[0]), (1, table.shape[1]), (2, 1), (8, "table"), (9, table.tobytes()))
    graph = _proto((1, node), (2, "g"), (5, weights), (11, ranked("input_ids", 7, "b", "s")), (12, ranked("out", 1, "b", "s", "d")))
    (tmp_path / "m.onnx").write_bytes(_proto((1, 8), (8, _proto((2, 13))), (7, graph)))
    p = embed.provider("onnx", model_path=str(tmp_path / "m.onnx"), tokenizer_path=path, dimensions=3)
    texts = ["one gateway", "and a much longer text of many tokens", "x"]
    for text, got in zip(texts, p.embed(texts), strict=True):
        mean = table[tok.encode(text).ids].mean(axis=0)
        assert np.allclose(got, mean / np.linalg.norm(mean), atol=1e-5)
    assert p.batch == embed.accelerator().batch


def test_large_files_are_scanned_in_blocks(spark):
    """Fences and headings over the edges of blocks: the same sections however long the blocks are."""
    rng = random.Random(6)
    files = []
    for k in range(6):
        lines = []
        for n in range(rng.choice([0, 3, 40, 90])):
            lines.append(rng.choice(["```", "~~~ x", f"# Part {n}", f"### Small {n}", "code = 1", f"Some line of text number {n} that is long enough.", "", "  - item here"]))
        files.append((f"f{k}", None, "\n".join(lines)))
    df = spark.createDataFrame(files, "url string, file_path string, markdown string")
    rows = lambda b: sorted(tuple(r) for r in markdown.sections(df, block=b).collect())
    whole = rows(10**6)
    assert len(whole) > 20 and rows(7) == whole and rows(1) == whole
    plan = markdown.classified(markdown.headed(df), 7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(url#" in plan and ", block#" in plan  # lines are dealt by block


def test_empty_answers_and_tools(spark, tmp_path):
    """The four questions over a line protocol: answers, an empty answer in words, and what is wrong with a question."""
    import io

    from corvid.serve import serve

    e = Engine(spark, [Product("p", "P", "http://e")], Settings(store_path=str(tmp_path / "e"), dimensions=16))
    assert as_json(e.search("x")).startswith("Nothing found")
    rows = [("http://e/a", "p", "1", "# Gateway\n" + BODY * 4)]
    e.ingest(spark.createDataFrame(rows, "url string, product string, version string, markdown string").withColumn("content_hash", F.sha2("markdown", 256)))
    call = lambda n, name, **given: {"id": n, "method": "tools/call", "params": {"name": name, "arguments": given}}
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, call(3, "search_docs", query="gateway", limit=1), call(4, "get_guide", topic="gateway", product="p"), call(5, "explain_concept", concept="gateway"), call(6, "list_products"), call(7, "search_docs", query=""), call(8, "get_guide", topic="x"), call(9, "nothing"), {"id": 10, "method": "other"}]
    out = io.StringIO()
    serve(e, [*(json.dumps(m) + "\n" for m in asked), "\n", "not json\n", "3\n"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None, None]
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["search_docs", "get_guide", "explain_concept", "list_products"]
    text = lambda g: g["result"]["content"][0]["text"]
    assert json.loads(text(got[2]))[0]["source_url"] == json.loads(text(got[3]))[0]["source_url"] == "http://e/a"
    assert json.loads(text(got[4]))["concept"] == "gateway" and json.loads(text(got[5]))[0]["id"] == "p"
    assert all("error" in g for g in got[6:])


def test_a_sitemap_in_part_counts_as_none(spark, site, tmp_path):
    """One nested sitemap can't be read: the walk over links takes its place."""
    base, answers, asked = site
    page = lambda links: f"<html><body><main><h1>Title</h1><p>{BODY * 3}</p>{links}</main></body></html>"
    answers |= {"/sitemap.xml": (200, f"<sitemapindex><sitemap><loc>{base}/one.xml</loc></sitemap><sitemap><loc>{base}/two.xml</loc></sitemap></sitemapindex>"), "/one.xml": (200, f"<urlset><url><loc>{base}/docs/listed</loc></url></urlset>"), "/two.xml": (500, ""), "/docs": (200, page(f'<a href="{base}/docs/b">b</a>')), "/docs/b": (200, page(""))}
    e = Engine(spark, [Product("p", "P", f"{base}/docs", sitemap_url=f"{base}/sitemap.xml")], Settings(store_path=str(tmp_path / "e"), dimensions=16, fetch_retries=0, fetch_delay=0))
    assert e.crawl()["updated"] == 2
    assert {r.source_url for r in e.store.chunks().collect()} == {f"{base}/docs", f"{base}/docs/b"}


def test_checkpoint_folder_that_was_set(spark, monkeypatch):
    from corvid import tables

    class Context:
        master = "spark://elsewhere"

        def getCheckpointDir(self):  # noqa: N802
            return "hdfs://shared/checkpoints/"

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *a: None)})(), Context()  # noqa: N815

    assert tables.shared_folder(Session()) == "hdfs://shared/checkpoints"


def test_work_of_an_arrow_batch_is_bounded(spark, monkeypatch):
    """However many rows a batch has, only some are parsed, embedded or compared at a time, and none is lost."""
    import pyarrow as pa

    from corvid.functions import vectors

    seen = []
    monkeypatch.setattr(vectors, "units", lambda v, n, real=vectors.units: seen.append(len(v)) or real(v, n))
    asked = vectors.Asked(np.array([1]), pa.array([[1.0, 0.0]]), 3)
    seen.clear()
    asked.meet(np.arange(5000), pa.array([[1.0, k / 5000] for k in range(5000)]))
    assert max(seen) <= vectors.ROWS and sum(seen) == 5000 and asked.found(["q", "k", "s"])["k"].to_pylist() == [0, 1, 2]
    assert [len(p) for p in vectors.pieces(pa.array(range(1025)))] == [512, 512, 1] and [len(p) for p in vectors.pieces(pa.array([]))] == [0]

    calls = spark.sparkContext.accumulator(0)

    class Counting(embed.Hashing):
        def vectors(self, texts):
            assert len(texts) <= 100
            calls.add(1)
            return super().vectors(texts)

    rows = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("t"))
    p = Counting(dimensions=16, batch=100)
    made = rows.select("t", p.column(F.col("t")).alias("v")).collect()
    assert calls.value == 30 and all(list(r.v) == vectors.hashed(r.t, 16).tolist() for r in made)
    near = search.nearest(rows.select(F.col("t").alias("source_url"), F.lit(0).alias("chunk_index"), p.column(F.col("t")).alias("embedding")), vectors.hashed("w7", 16).tolist(), 3000)
    assert near.where("score >= 0").count() == 3000
    pages = rows.select(F.concat(F.lit("http://h/"), "t").alias("url"), F.concat(F.lit("<h1>"), "t", F.lit("</h1>")).alias("html"))
    assert html.parsed(pages).where(F.col("page.title") == F.element_at(F.split("url", "/"), -1)).count() == 3000


def test_a_grid_copies_rows_no_more_than_it_must():
    assert search.grid(12_000, 600_000, 4, 200) == (6, 32)
    assert search.grid(206, 10_256, 4, 200) == (2, 32)
    assert search.grid(5000, 1 << 24, search.HELD, search.STREAMED) == (3, 128) and search.grid(5, 0, 3, 10) == (2, 1)


def test_white_space_and_clean_up_without_patterns(spark):
    """Trimming by a list of characters, and rewrites that are left out where they can't match, give what the patterns do."""
    from functools import reduce

    texts = ["", " ", "a", *(f"{c}a {c}b{c}" for c in T.SPACES), *(f"a{c}{d}b" for c in T.SPACES for d in " x"), "-*- x", "-*-", "1. a", " > q\n - b\r\n***", "a_b_ `c` <i>*d*</i> [e](f) ![g](h)", "x​ y \U0001f600 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), T.CLEAN, F.col("t"))
    trimmed = lambda c: F.regexp_replace(c, f"^{T.SPACE}+|{T.SPACE}+\\z", "")
    squeezed = lambda c: trimmed(F.regexp_replace(c, f"{T.SPACE}+", " "))
    rows = df.select("t", T.trim(F.col("t")), trimmed(F.col("t")), T.trim_end(F.col("t")), F.regexp_replace("t", f"{T.SPACE}+\\z", ""), T.squeeze(F.col("t")), squeezed(F.col("t")), T.clean_markdown(F.col("t")), squeezed(whole)).collect()
    assert all(r[k] == r[k + 1] for r in rows for k in (1, 3, 5, 7)) and len(rows) == len(texts)
    assert "regexp" not in str(T.trim(F.col("t"))) + str(T.trim_end(F.col("t"))) and "contains" in str(T.clean_markdown(F.col("t"))).lower()


@pytest.mark.parametrize("name", ["doc_chunks", "md_clean_lines", "md_sections"])
def test_heavy_columns_are_computed_once(spark, sf, name):
    from corvid.plans.catalog import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    filters = [line for line in text.split("\n") if line.lstrip(" :+-").startswith("Filter") and ("aggregate(" in line or "size(" in line)]
    assert not filters and sum(line.lstrip(" :+-").startswith("Aggregate") for line in text.split("\n")) <= 5


def test_a_failure_of_a_crawl_is_told(spark, tmp_path):
    """A sitemap that can't be read, pages of a walk that can't, and a site of which there is nothing, each count as an error."""
    at = (tmp_path / "site").as_uri()
    (tmp_path / "site").mkdir()
    words = f"<main><h1>Title</h1><p>{BODY * 3}</p></main>"
    (tmp_path / "site" / "start").write_text(words + f'<a href="{at}/b">b</a><a href="{at}/none">none</a>')
    (tmp_path / "site" / "b").write_text(words)
    (tmp_path / "site" / "map.xml").write_text(f"<sitemapindex><sitemap><loc>{at}/lost.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "site" / "empty.xml").write_text("<urlset></urlset>")
    (tmp_path / "site" / "blank").write_text("")
    products = [Product("map", "M", f"{at}/start", f"{at}/map.xml"), Product("walk", "W", f"{at}/start", f"{at}/empty.xml"), Product("none", "N", f"{at}/none", f"{at}/empty.xml"), Product("blank", "B", f"{at}/blank", f"{at}/empty.xml")]
    e = Engine(spark, products, Settings(store_path=str(tmp_path / "e"), dimensions=16, fetch_retries=0, fetch_delay=0))
    done = e.crawl(force=True)["by_product"]
    assert {p: (d["updated"], d["errors"]) for p, d in done.items()} == {"map": (2, 2), "walk": (2, 1), "none": (0, 1), "blank": (0, 1)}
    assert f"{at}/lost.xml: " in done["map"]["reason"] and f"{at}/none: " in done["walk"]["reason"] and "neither" in done["blank"]["reason"]
    one = e.crawl("walk", limit=1, force=True)
    assert (one["updated"], one["errors"]) == (1, 1)


def test_a_site_as_files_with_sitemaps_of_bounded_size(spark, tmp_path, monkeypatch):
    """An index of sitemap files names every address once; what was fetched is handed on by its size, none lost."""
    from corvid.tables import Staged

    files = spark.range(35).select(F.concat((F.col("id") % 3).cast("string"), F.lit("/p"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("é\n"), F.col("id").cast("string")).alias("body"))
    base = (tmp_path / "site").as_uri()
    assert web.published(files, str(tmp_path / "site")) == 35 and (tmp_path / "site" / "1" / "p34").read_text() == "é\n34"
    assert len([f for f in (tmp_path / "site").rglob("*") if f.is_file()]) == 35
    urls = files.select(F.concat(F.lit(f"{base}/"), "path").alias("url"))
    monkeypatch.setattr(web, "MAP", 10)
    start = web.published_sitemaps(urls, 35, str(tmp_path / "maps"), (tmp_path / "maps").as_uri())
    assert len(list((tmp_path / "maps").glob("map-*.xml"))) == 4
    with Staged(spark) as keep:
        maps = web.fetched_sitemaps(spark, start, keep, retries=0, delay=0, partitions=2)
        listed = web.sitemap_urls(maps, start)
        assert sorted(r.url for r in listed.collect()) == sorted(r.url for r in urls.collect())
        got = web.fetched(listed.select("url").unionByName(spark.createDataFrame([(f"{base}/none",)], "url string")), retries=0, delay=0, partitions=1)
        rows = {r.url: (r.body, r.error) for r in got.collect()}
    assert len(rows) == 36 and rows.pop(f"{base}/none")[1] and all(error is None and body == "é\n" + url.rsplit("p", 1)[1] for url, (body, error) in rows.items())


def test_crawl_report_of_a_repeated_address(spark, tmp_path):
    """A site has one page at an address, the same however the rows lie."""
    from hashlib import sha256

    from corvid.plans import catalog

    page = lambda n: f"<title>T</title><article><h1>T</h1><p>{'Some words of a sentence are here. ' * n}</article>"
    pairs = [(page(5 + k), page(300 + k)) for k in range(6)]
    want = sum({a: 1, b: 4}[max(a, b, key=lambda x: sha256(x.encode()).hexdigest())] for a, b in pairs)
    got = []
    for name, order in (("one", 1), ("two", -1)):
        rows = [(0, f"https://h/en/{k}", x) for k, pair in enumerate(pairs) for x in pair[::order]]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / name / "pages.parquet"))
        got.append(tuple(catalog.crawl_report(spark, str(tmp_path / name)).first()))
    assert got == [("site", 6, 0, 0, 1, want)] * 2


def test_stream_ingest_of_a_folder_of_files(spark, sf, tmp_path):
    """A table that is a folder of part files streams as one file does."""
    from corvid.plans import catalog

    spark.read.parquet(f"{sf}/pages.parquet").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, catalog.stream_ingest(spark, str(tmp_path)).collect()))
    assert got and got == sorted(map(tuple, catalog.stream_ingest(spark, sf).collect()))
