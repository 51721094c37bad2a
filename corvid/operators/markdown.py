"""Markdown files to titles, descriptions and headed sections, in DataFrame operations alone.

Whether a line is code, and which section it is in, depends on all lines before it in its file.  A file is therefore
scanned in blocks of lines: each block tells its fences, and its headings for either case of being entered in code or
not; the blocks of a file, few rows, add up to what each is entered with; and its lines follow from that.  So the lines of
a very large file are dealt to as many tasks as it has blocks, and then by their sections.  Files of one block, nearly all,
are dealt by their address once, and their lines and sections stay there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvid.functions.text import SPACE, clean_markdown, filled, head_units, path_title, squeeze, trim, trim_end, units

HEADING = f"^(#{{1,4}}){SPACE}+(.+)$"
H1 = f"(?m)^#{SPACE}+(.+)$"
IMAGE = "^!\\[.*?\\]\\(.*?\\)$"
BLOCK = 50_000


def _front(md: Column) -> tuple[Column, Column, Column]:
    """(whether there is front matter, its block, the body)."""
    end = F.locate("\n---", md, 4)
    has = md.startswith("---") & (end > 0)
    block = trim(F.substr(md, F.lit(5), F.greatest(end - 5, F.lit(0))))
    return has, F.when(has, block).otherwise(F.lit("")), F.when(has, trim(F.substr(md, end + 4))).otherwise(md)


def _value(block: Column, key: str) -> Column:
    """The last value that the block gives a key."""
    lines = F.filter(F.split(block, "\n"), lambda x: F.lower(trim(F.substring_index(x, ":", 1))) == key)
    lines = F.filter(lines, lambda x: x.contains(":"))
    value = F.transform(lines, lambda x: F.regexp_replace(trim(F.substr(x, F.locate(":", x) + 1)), "^[\"']|[\"']\\z", ""))
    return F.coalesce(F.try_element_at(value, F.lit(-1)), F.lit(""))


def headed(files: DataFrame) -> DataFrame:
    """``files`` (url, markdown, file_path if there) with title, description and body."""
    path = F.coalesce(F.col("file_path"), F.col("url")) if "file_path" in files.columns else F.col("url")
    has, block, body = _front(F.coalesce(F.col("markdown"), F.lit("")))
    out = files.withColumns({"_block": block, "body": body})
    h1 = trim(F.regexp_extract("body", H1, 1))
    return out.withColumns({"title": trim(filled(_value(F.col("_block"), "title"), h1, path_title(path), F.lit(""))), "description": trim(_value(F.col("_block"), "description"))}).drop("_block")


def _marked(pages: DataFrame, block: int) -> DataFrame:
    """Lines of the bodies: whether each is a fence and whether, out of code, it is a heading, and the fences before it in its block."""
    here = W.partitionBy("url", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = pages.select("url", F.posexplode(F.split("body", "\n")).alias("pos", "raw")).select("url", "pos", F.floor(F.col("pos") / block).alias("block"), trim_end(F.col("raw")).alias("line"))
    lines = lines.withColumn("fence", F.col("line").startswith("```") | F.col("line").startswith("~~~"))
    lines = lines.withColumn("titled", ~F.col("fence") & F.col("line").rlike(HEADING))
    return lines.withColumn("inner", F.sum(F.col("fence").cast("int")).over(here) - F.col("fence").cast("int"))


def entered(pages: DataFrame, block: int) -> DataFrame:
    """(url, block, fences, heads): before each further block of the files that have several, by a scan over the blocks."""
    long = _marked(pages, block)
    odd = F.col("inner") % 2 == 1
    sums = long.groupBy("url", "block").agg(F.count_if("fence").alias("in"), F.count_if(F.col("titled") & ~odd).alias("even"), F.count_if(F.col("titled") & odd).alias("odd"))
    past = W.partitionBy("url").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("fences", F.coalesce(F.sum("in").over(past), F.lit(0)))
    sums = sums.withColumn("heads", F.coalesce(F.sum(F.when(F.col("fences") % 2 == 0, F.col("even")).otherwise(F.col("odd"))).over(past), F.lit(0)))
    return sums.where("block > 0").select("url", "block", "fences", "heads")


def classified(pages: DataFrame, block: int = BLOCK, several: bool = True) -> DataFrame:
    """Lines of the bodies with their section number and kind: heading, text, or a part of a fence.  ``several``: whether files may have more than one block."""
    here = W.partitionBy("url", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines, none = _marked(pages, block), F.lit(0).cast("long")
    lines = lines.join(entered(pages, block), ["url", "block"], "left") if several else lines.withColumns({"fences": none, "heads": none})
    before = (F.col("inner") + F.coalesce("fences", F.lit(0))).alias("before")
    lines = lines.select("url", "block", "pos", "line", "fence", "titled", before, F.coalesce("heads", F.lit(0)).alias("heads"))
    lines = lines.withColumn("coded", F.col("before") % 2 == 1).withColumn("head", F.col("titled") & ~F.col("coded"))
    return lines.withColumn("section", F.col("heads") + F.sum(F.col("head").cast("int")).over(here)).drop("block", "titled", "heads")


def clean_line(line: Column) -> Column:
    """A text line's contribution, null if it has none."""
    bare = trim(line)
    # within an array, so that the rewrites run once and not for every mention
    cleaned = F.get(F.filter(F.array(clean_markdown(line)), lambda x: units(x) > 3), F.lit(0))
    return F.when((bare != "") & ~bare.startswith("<!--") & ~bare.rlike(IMAGE), cleaned)


def kept_line(line: Column) -> Column:
    """As ``clean_line``, and no row for a line without a contribution; a filter on its outcome would compute it twice."""
    return F.explode(F.filter(F.array(clean_line(line)), lambda x: x.isNotNull()))


def _built(lines: DataFrame) -> DataFrame:
    """(url, pos, heading, text, level): the sections of classified lines that have enough text."""
    text = F.when(F.col("coded"), F.when(~F.col("fence") & (trim(F.col("line")) != ""), F.col("line"))).when(~F.col("fence") & ~F.col("head"), clean_line(F.col("line")))
    # a fence is one unit, closed if it holds the closing line; another line is a unit of its own
    unit = F.when(F.col("coded"), -F.col("before")).otherwise(F.col("pos"))
    marked = lines.select("url", "section", unit.alias("unit"), "pos", "coded", (F.col("coded") & F.col("fence")).alias("closes"), text.alias("text"), F.when(F.col("head"), clean_markdown(F.regexp_extract("line", HEADING, 2))).alias("heading"), F.when(F.col("head"), F.length(F.regexp_extract("line", HEADING, 1))).alias("level"))
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("pos", value)))), lambda x: x[value])
    units_of = marked.groupBy("url", "section", "unit").agg(F.min("pos").alias("pos"), F.bool_or("coded").alias("coded"), F.bool_or("closes").alias("closed"), F.array_join(ordered("text"), " ").alias("joined"), F.count("text").alias("n"), F.max("heading").alias("heading"), F.max("level").alias("level"))
    code = F.when(F.col("closed") & (F.col("n") > 0), F.concat(F.lit("[code: "), head_units(F.col("joined"), 200), F.lit("]")))
    units_of = units_of.withColumn("text", F.when(F.col("coded"), code).when(F.col("n") > 0, F.col("joined")))
    built = units_of.groupBy("url", "section").agg(squeeze(F.array_join(ordered("text"), " ")).alias("text"), F.coalesce(F.max("heading"), F.lit("")).alias("heading"), F.coalesce(F.max("level"), F.lit(0)).alias("level")).where(units(F.col("text")) > 20)
    return built.select("url", F.col("section").cast("int").alias("pos"), "heading", "text", F.col("level").cast("int").alias("level"))


def sections(files: DataFrame, *keep: str, block: int = BLOCK) -> DataFrame:
    """One row per section: url, ``keep``, title, description, pos, heading, text, level.  ``url`` names a file."""
    pages = headed(files)
    short = F.length("body") < block  # too few characters for a second block
    built = _built(classified(pages.where(short).repartition("url"), block, False))
    built = built.unionByName(_built(classified(pages.where(~short), block, True).repartition("url", "section")))  # serves both groupings
    found = built.select(F.col("url").alias("_url"), F.col("pos").alias("_pos"), F.col("heading").alias("_heading"), F.col("text").alias("_text"), F.col("level").alias("_level"))
    rows = pages.join(found, F.col("url") == F.col("_url"), "left").withColumn("bare", F.col("_pos").isNull())
    # of a file without sections the whole
    rows = rows.select("url", *keep, "title", "description", F.coalesce("_pos", F.lit(0)).alias("pos"), F.when(F.col("bare"), F.col("title")).otherwise(F.col("_heading")).alias("heading"), F.when(F.col("bare"), clean_markdown(F.col("body"))).otherwise(F.col("_text")).alias("text"), F.coalesce("_level", F.lit(1)).alias("level"), "bare")
    return rows.where(~F.col("bare") | (units(F.col("text")) > 30)).drop("bare")
