"""Licence scans: canonical digest lookup, in DataFrame functions only.

A text is made canonical (lower case, copyright lines dropped, every run of other characters than letters and
digits one space, equivalent spellings replaced) and its SHA-256 joined with the digests of known licence texts, a
fixed list.  The same is done for each line, since a notice is itself a known licence text; a line's digest is
looked up in the row, so there is one scan and no shuffle.

A wrapped licence may have a body line that begins with "copyright".  ``digest`` drops every such line; where there
is one, the text is also looked up with only those lines dropped that state a copyright.

Defined cases: a null or empty text has the digest of the empty text and matches nothing; rows are told by their own
text alone, whatever their doc_id, null or repeated ones too; repeated rows give repeated rows; a text of any length
is taken whole; a text that two known licences share gets the first by name; other columns are ignored, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Equivalent spellings, on canonical text, in the order in which they are replaced.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("\\backnowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("\\bcategoris", "categoriz"),
    ("\\bcharacteris", "characteriz"),
    ("\\bfavour", "favor"),
    ("\\bfulfilment", "fulfillment"),
    ("\\bhonour", "honor"),
    ("\\bhttps\\b", "http"),
    ("\\binitialis", "initializ"),
    ("\\bjudgement", "judgment"),
    ("\\blabour", "labor"),
    ("licence", "license"),
    ("\\bmerchantibility\\b", "merchantability"),
    ("\\bnon commercial", "noncommercial"),
    ("\\bnon infringement", "noninfringement"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("\\bsub license", "sublicense"),
    ("\\butilis", "utiliz"),
    ("\\bwhilst\\b", "while"),
    ("\\bwilful", "willful"),
)
MARKS = ("copyright", "(c)", "©", "all rights reserved")  # one of them is in every line that either pattern drops
COPYRIGHT = "(?m)^[ \\t]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$"
# Only what states a copyright: a body line of a wrapped licence may begin with "copyright notice" or "(c) you must".
STATEMENT = "(?m)^[ \\t]*(copyright[ \\t]*(\\(c\\)|©|[0-9]|<|\\[|\\{)[^\\n]*|(\\(c\\)|©)[ \\t]*(copyright|[0-9]|<|\\[|\\{)[^\\n]*|all rights reserved[. \\t\\r]*)$"
# What stands above a licence's text, where its title differs between copies.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "The 3-Clause BSD License"),
    "ISC": ("ISC License", "The ISC License"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
}
# Names by which notices call a licence.
NAMES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
PHRASES = ("{}licensed under {}{}", "{}released under {}{}", "{}distributed under {}{}")
SUBJECTS = ("", "this work is ", "this project is ", "this software is ")
#: Words of which each known text has one; a text without any has no notice.
HINTS = ("licen", "permission", "redistribution", "released under", "distributed under")


def texts() -> list[tuple[str, str]]:
    """(licence, text) of the whole texts in ``licence_texts``, also without their copyright line, title or appendix, and under their other titles."""
    out = []
    for f in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        if not f.name.endswith(".txt"):
            continue
        name, text = f.name.removesuffix(".txt"), f.read_text("utf-8")
        out.append((name, text))
        if name in TITLES:
            body = text.split("\n\n", 1)[1]
            out += [(name, body), *((name, f"{t}\n\n{body}") for t in TITLES[name])]
        end = "END OF TERMS AND CONDITIONS"
        if end in text:
            out.append((name, text.split(end)[0] + end))
            out.append((name, text.split(end)[0]))
    return out


def notices() -> list[tuple[str, str]]:
    """(licence, text) of one-line notices: every phrase with every name."""
    out = [(licence, f"SPDX-License-Identifier: {licence}") for licence in NAMES]
    for licence, names in NAMES.items():
        out += [(licence, p.format(s, the, n)) for n in names for p in PHRASES for s in SUBJECTS for the in ("", "the ")]
    return out


KNOWN: tuple[tuple[str, str], ...] = (*texts(), *notices())


def bare(low: Column, dropped: str) -> Column:
    """Lowered text without the lines that ``dropped`` matches, one space for what is neither letter nor digit."""
    marked = reduce(lambda c, m: c | low.contains(m), MARKS[1:], low.contains(MARKS[0]))
    return F.trim(F.regexp_replace(F.when(marked, F.regexp_replace(low, dropped, "")).otherwise(low), "[^\\p{L}\\p{N}]+", " "))


def spelled(c: Column) -> Column:
    """One spelling for equivalents; text that holds none of them, as most does, is only searched for them."""
    stems = [a.replace("\\b", "") for a, _ in SPELLINGS]
    any_of = reduce(lambda x, s: x | c.contains(s), stems[1:], c.contains(stems[0]))
    return F.when(any_of, reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), SPELLINGS, c)).otherwise(c)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def known(spark: SparkSession, given=KNOWN) -> dict[str, str]:
    """Licence of each digest of the known texts, a fixed list; of several licences with one digest the first by name."""
    rows = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("licence"), F.lit(b).alias("text")) for a, b in given))))
    low = rows.select("licence", lowered(F.col("text")).alias("low"))
    forms = low.select("licence", F.explode(F.array(bare(F.col("low"), COPYRIGHT), bare(F.col("low"), STATEMENT))).alias("c"))
    found = forms.where("c <> ''").groupBy(F.sha2(spelled(F.col("c")), 256).alias("digest")).agg(F.min("licence").alias("licence"))
    return {r.digest: r.licence for r in found.collect()}


def scanned(docs: DataFrame, given=KNOWN) -> DataFrame:
    """doc_id, digest of the canonical text, licence (that the whole text is, or null), notices (comma-separated licences of its lines, sorted; empty if none)."""
    spark = docs.sparkSession
    digests = known(spark, given)
    licence_of = F.create_map(*(F.lit(x) for pair in sorted(digests.items()) for x in pair)) if digests else F.lit(None).cast("map<string,string>")
    table = spark.range(1).select(F.explode(licence_of).alias("known", "name"))
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    body = low.select("doc_id", "low", bare(F.col("low"), COPYRIGHT).alias("loose"), F.when(F.col("low").rlike(COPYRIGHT), bare(F.col("low"), STATEMENT)).alias("strict"))
    hinted = reduce(lambda x, h: x | F.col("low").contains(h), HINTS[1:], F.col("low").contains(HINTS[0]))
    lines = F.filter(F.split("low", "\n"), lambda x: reduce(lambda c, h: c | x.contains(h), HINTS[1:], x.contains(HINTS[0])))
    line = F.transform(lines, lambda x: F.sha2(spelled(bare(x, COPYRIGHT)), 256))
    found = F.filter(F.transform(line, lambda d: F.try_element_at(licence_of, d)), lambda x: x.isNotNull())
    row = body.select(
        "doc_id",
        F.sha2(spelled(F.col("loose")), 256).alias("digest"),
        F.sha2(spelled(F.col("strict")), 256).alias("strict"),
        F.when(hinted, F.array_join(F.array_sort(F.array_distinct(found)), ",")).otherwise("").alias("notices"),
    )
    loose, exact = (F.broadcast(table.select(F.col("known").alias(f"{k}_digest"), F.col("name").alias(k))) for k in ("loose", "exact"))
    out = row.join(loose, F.col("digest") == F.col("loose_digest"), "left").join(exact, F.col("strict") == F.col("exact_digest"), "left")
    return out.select("doc_id", "digest", F.coalesce("exact", "loose").alias("licence"), "notices")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def c(x: str, dropped: str = COPYRIGHT) -> str:
        out = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {q(dropped)}, '', 'g')"
        out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
        for a, b in SPELLINGS:
            out = f"regexp_replace({out}, {q(a)}, {q(b)}, 'g')"
        return out

    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    hinted = lambda x: " or ".join(f"contains(lower({x}), '{h}')" for h in HINTS)
    return f"""
    with given as (select * from (values {rows}) t(licence, text)),
    forms as (select licence, {c('text')} c from given union all select licence, {c('text', STATEMENT)} from given),
    known as (select sha256(c) digest, min(licence) licence from forms where c <> '' group by 1),
    base as (select row_number() over () rid, doc_id, coalesce(text, '') as text from documents),
    whole as (select rid, doc_id, sha256({c('text')}) digest, case when regexp_matches(translate(text, '{UPPER}', '{LOWER}'), {q(COPYRIGHT)}) then sha256({c('text', STATEMENT)}) end strict from base),
    line as (select rid, unnest(string_split(text, chr(10))) line from base where {hinted('text')}),
    found as (select rid, string_agg(distinct licence, ',' order by licence) notices from (select rid, sha256({c('line')}) digest from line where {hinted('line')}) join known using (digest) group by 1)
    select w.doc_id, w.digest, coalesce(e.licence, k.licence) licence, coalesce(f.notices, '') notices
    from whole w left join known k on k.digest = w.digest left join known e on e.digest = w.strict left join found f on f.rid = w.rid"""


SQL = _sql()
