"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets are equal-weight shares capped at twice a source's size.  The mix is a number of equal-token blocks:
each goes to the source of highest quotient target / (2 * seats + 1).  A source's blocks are apportioned to its
shards, hashed sets of its documents, in the same way.  A shard's documents in seeded order, and then once more
in that order, are its stream of blocks, of which the quota is taken from the start; so every document is taken
once before any is taken a second time, and at most one in a shard is cut.

Sources are split into shards by their number of documents, so a source with a third of all rows is spread like
the rest.  Tables of one row for each source or shard are ordered in ranges, never in one task.  Documents meet
their source's row by broadcast if the source is common (at most 10,000 are), and else by a shuffle, in which no
key is.

Defined cases: a null text has size 0; a null source is the last; a source of no words has target 0; repeated
rows are documents of their own; rows without doc_id count like others; a text of any length is counted whole; an
empty table, or one without words, takes nothing; other columns are ignored by ``mixed`` and kept by ``resampled``,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corvid.llm.arrow import any_names, light
from corvid.llm.scratch import saved

WORD = "[^\\x20\\x09-\\x0D]+"
COMMON = 10_000  # a source with more than this part of all documents is common
SMALL = 1 << 19  # rows of a table that may be broadcast, at some 60 bytes


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    block: int = 64
    shard_docs: int = 512
    most_shards: int = 1 << 18  # of all sources together, and one more for each source
    seed: int = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))


def ordered(table: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """``table`` with ``_rank``, each row's place in a total order, and for each of ``sums`` the sum of a column over the rows before it.

    Rows are dealt by ranges of the order; each range counts and sums up by itself, and the driver adds one number a range.
    """
    dealt = saved(table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_rank"), *(F.sum(c).alias(n) for n, c in sums.items())).orderBy("_range").collect()
    names, ahead, rows = ["_rank", *sums], [0] * (1 + len(sums)), []
    for r in totals:
        rows.append((r["_range"], *map(float, ahead)))
        ahead = [a + r[n] for a, n in zip(ahead, names, strict=True)]
    within = W.partitionBy("_range").orderBy(*order)
    before = within.rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumns({"_rank": (F.row_number().over(within) - 1).cast("long"), **{n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}})
    if len(rows) <= 1:  # nothing lies before the first range
        return own.select(*table.columns, *(F.col(n).cast("long" if n == "_rank" else "double").alias(n) for n in names))
    offsets = table.sparkSession.createDataFrame(rows, "_range int, " + ", ".join(f"_ahead{n} double" for n in names))
    out = own.join(F.broadcast(offsets), "_range")  # one row for each partition of a shuffle
    return out.select(*table.columns, *((F.col(n) + F.col(f"_ahead{n}")).cast("long" if n == "_rank" else "double").alias(n) for n in names))


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, docs, source_size, target): the capped shares.  One row per source."""
    per = saved(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), "sources")
    by_name = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("_rank") % len(mix.weights) + 1).cast("int"))
    ranked = ordered(per, [by_name]).select("source", "docs", "source_size", weight.alias("weight"), (F.col("source_size") * mix.cap).alias("most"))
    ranked = ranked.withColumn("reached", F.col("most") / F.col("weight"))
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # sources in the order in which a rising level would reach their cap; at the level sought some first ones are capped
    rising = ordered(ranked, [F.col("reached").asc(), by_name], most_before="most", weight_before="weight")
    level = (F.lit(mix.share) * float(whole["size"] or 0) - F.col("most_before")) / (F.lit(float(whole["weight"] or 1)) - F.col("weight_before"))
    # the first source that stays below its cap sets the level for all
    free = rising.withColumn("level", level).where("level <= reached").agg(F.min(F.struct("_rank", "level")).alias("first")).first()["first"]
    return ranked.select("source", "docs", "source_size", F.least(F.col("most"), F.col("weight") * (free["level"] if free else float("inf"))).alias("target"))


def _matching(left: DataFrame, right: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its key columns renamed, and the condition that they equal those of ``left``."""
    right = right.withColumnsRenamed({n: f"_k_{n}" for n in names})
    return right, reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[f"_k_{n}"]) for n in names))


def _with_sums(table: DataFrame, group: list[str], **sums: Column) -> DataFrame:
    """``table`` with sums over its groups, or over all rows."""
    if not group:
        one = table.agg(*(c.alias(n) for n, c in sums.items()))
        value = one.first()
        return table.withColumns({f.name: F.lit(value[f.name]).cast(f.dataType) for f in one.schema})
    per, match = _matching(table, table.groupBy(*group).agg(*(c.alias(n) for n, c in sums.items())), group)
    return table.join(per, match).drop(*(f"_k_{g}" for g in group))


def seats(table: DataFrame, group: list[str], item: list[str], wish: str, total: Column) -> DataFrame:
    """``table`` with a column ``seats``: ``total`` (equal within a group) seats dealt by highest quotient wish / (2 * seats + 1).

    Rounding wish * total / sum first gives all but a few seats; those are then given, or taken back, in the order
    of their quotients.  Ties go to the item that comes first.  Sums are of decimals, so they don't depend on their order.
    """
    exact = F.sum(F.col(wish).cast("decimal(38,6)")).cast("double")
    base = _with_sums(table.withColumn("_total", total), group, _wishes=exact)
    share = F.when(F.col("_wishes") > 0, F.col(wish) / F.col("_wishes")).otherwise(F.lit(0.0))
    base = base.withColumn("_share", share).withColumn("_base", F.floor(F.col("_share") * F.col("_total") + 0.5).cast("long"))
    base = _with_sums(base, group, _given=F.sum("_base"))
    base = saved(base.withColumn("_odd", F.when(F.col("_wishes") > 0, F.col("_total") - F.col("_given")).otherwise(F.lit(0))), "rounded-seats")
    steps = F.ceil(F.abs("_odd") * F.col("_share")).cast("int") + 2
    step = F.explode(F.sequence(F.lit(1), steps)).alias("_step")
    offers = base.where("_odd <> 0").select(*group, *item, wish, "_base", "_odd", step)
    given = offers.withColumn("_q", F.when(F.col("_odd") > 0, F.col(wish) / (2 * (F.col("_base") + F.col("_step")) - 1)).otherwise(-F.col(wish) / (2 * (F.col("_base") - F.col("_step")) + 1)))
    given = given.where("_odd > 0 or _base >= _step")
    names = [*group, *item]
    placed = ordered(given, [*(F.col(g).asc_nulls_last() for g in group), F.desc("_q"), *(F.col(i).asc_nulls_last() for i in item), F.col("_step").asc()])
    placed = _with_sums(placed, group, _first=F.min("_rank")) if group else placed.withColumn("_first", F.lit(0))
    change = placed.where(F.col("_rank") - F.col("_first") < F.abs("_odd")).groupBy(*names).agg(F.sum(F.signum("_odd")).cast("long").alias("_change"))
    change, match = _matching(base, change, names)
    return base.join(change, match, "left").select(*table.columns, (F.col("_base") + F.coalesce("_change", F.lit(0))).alias("seats"))


def _met(rows: DataFrame, per_source: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of their source's row in ``per_source`` (__of, __docs, ...)."""
    common = per_source.where(F.col("__docs") * COMMON >= total)
    rest = per_source.where(F.col("__docs") * COMMON < total)
    match = F.col("source").eqNullSafe(F.col("__of"))
    if not rest.head(1):
        return rows.join(F.broadcast(common), match)  # at most COMMON rows
    near = rows.join(F.broadcast(common), match, "left")
    found = near.where("__docs is not null")
    return found.unionByName(near.where("__docs is null").select(rows.columns).join(rest, match))


def _pick(mix: Mix, doc_id: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(mix.seed), doc_id, size, F.lit("order"))


def _shard(mix: Mix, doc_id: Column, size: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(mix.seed), doc_id, size), shards).cast("int")


def _placed(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame, int]:
    """(documents with source, shard, pick and taken; sources with their number of shards; number of documents)."""
    sized = saved(sizes(docs), "sizes")
    per = targets(sized, mix)
    whole = per.agg(F.sum("docs").alias("docs"), F.sum(F.col("target").cast("decimal(38,6)")).cast("double").alias("target")).first()
    total, blocks = int(whole["docs"] or 0), F.lit(round((whole["target"] or 0.0) / mix.block))
    in_shard = max(mix.shard_docs, -(-total // mix.most_shards))
    quota = seats(per, [], ["source"], "target", blocks).select(F.col("source").alias("__of"), F.col("docs").alias("__docs"), "source_size", "target", F.col("seats").alias("source_seats"), F.ceil(F.col("docs") / in_shard).cast("int").alias("__shards"))
    quota = saved(quota, "source-quotas")
    doc, size = F.col("doc_id"), F.col("size")
    spread = _met(sized, quota, total).select("doc_id", "source", "size", "source_size", "target", "source_seats", _shard(mix, doc, size, F.col("__shards")).alias("shard"), _pick(mix, doc, size).alias("pick"))
    spread = saved(spread, "sharded")
    by_shard = spread.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("source_seats").alias("source_seats"))
    shard_quota = seats(by_shard, ["source"], ["shard"], "words", F.col("source_seats")).select("source", "shard", (F.col("seats") * mix.block).alias("quota"))
    shard_quota, match = _matching(spread, shard_quota, ["source", "shard"])
    shard = W.partitionBy("source", "shard")
    ahead = F.coalesce(F.sum("size").over(shard.orderBy("pick", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = spread.join(shard_quota, match).withColumn("ahead", ahead).withColumn("total", F.sum("size").over(shard))
    part = lambda quota: F.greatest(F.lit(0), F.least(F.col("size"), quota - F.col("ahead")))
    taken = (part(F.col("quota")) + part(F.col("quota") - F.col("total"))).cast("long").alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", taken, "source", "shard", "pick"), quota.select("__of", "__docs", "__shards"), total


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for each row of ``docs``."""
    return _placed(docs, mix)[0].drop("shard", "pick")


@any_names
def resampled(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs``, all columns, each document as often as the mix takes it: 0, 1 or 2 times.

    The mix counts words; of the one document in a shard that it cuts, the nearest whole number of copies is taken.
    Down a shard's order the number of copies falls once, by one: a document's number follows from its place and that
    of the fall, so no text is shuffled.  Only repeated rows on both sides of a fall are told apart by counting them.
    """
    light(docs.sparkSession)
    rows, per_source, total = _placed(docs, mix)
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    counted = saved(rows.where("size > 0").select("source", "shard", "pick", times.alias("times")), "copies")
    ends = counted.groupBy("source", "shard").agg(F.max("times").alias("high"), F.min("times").alias("low"), F.min(F.struct("times", "pick")).alias("fall"))
    ends = saved(ends.select("source", "shard", "high", "low", F.col("fall.pick").alias("fall")), "falls")
    here, match = _matching(counted, ends, ["source", "shard"])
    both = counted.join(here, match).where((F.col("pick") == F.col("fall")) & (F.col("times") == F.col("high")) & (F.col("high") > F.col("low")))
    above = saved(both.groupBy("source", "shard").agg(F.count("*").cast("int").alias("__above")), "straddling")
    texts = docs.select("*", F.col("source").cast("string").alias("__source"), size_of(F.col("text")).alias("__size")).where("__size > 0")
    met = _met(texts.withColumnsRenamed({"source": "__given", "__source": "source"}), per_source, total)
    met = met.withColumns({"__shard": _shard(mix, F.col("doc_id").cast("long"), F.col("__size"), F.col("__shards")), "__pick": _pick(mix, F.col("doc_id").cast("long"), F.col("__size"))})
    table = ends.join(above.withColumnsRenamed({"source": "__s", "shard": "__h"}), F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__h")), "left")
    table = table.select(F.col("source").alias("__k"), F.col("shard").alias("__n"), F.col("high").alias("__high"), F.col("low").alias("__low"), F.col("fall").alias("__fall"), F.coalesce("__above", F.lit(0)).alias("__above"))
    small = F.broadcast(table) if ends.count() <= SMALL else table
    told = met.join(small, met["source"].eqNullSafe(F.col("__k")) & (F.col("__shard") == F.col("__n"))).withColumn("__copies", F.when(F.col("__pick") < F.col("__fall"), F.col("__high")).otherwise(F.col("__low")))
    columns = [F.col("__given" if c == "source" else c).alias(c) for c in docs.columns]
    out = told
    if above.head(1):
        split = F.col("__above").isNotNull() & (F.col("__above") > 0) & (F.col("__pick") == F.col("__fall"))
        place = F.row_number().over(W.partitionBy("__k", "__n").orderBy("__pick"))
        doubt = told.where(split).withColumn("__copies", F.when(place <= F.col("__above"), F.col("__high")).otherwise(F.col("__low")))
        out = told.where(~split).unionByName(doubt)
    return out.where("__copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
