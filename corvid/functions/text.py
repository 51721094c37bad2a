"""Text columns with the reference semantics of UTF-16 lengths and Unicode white space."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# The characters that count as white space, and the clean-up patterns with their replacements, in order.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CLEAN: tuple[tuple[str, str], ...] = (
    ("<[^>]+>", " "),
    ("\\[([^\\]]+)\\]\\([^)]*\\)", "$1"),
    ("!\\[[^\\]]*\\]\\([^)]*\\)", ""),
    ("\\*{1,3}([^*]+)\\*{1,3}", "$1"),
    ("_{1,3}([^_]+)_{1,3}", "$1"),
    ("`([^`]+)`", "$1"),
    (f"(?m)^{SPACE}*>{SPACE}*", ""),
    (f"(?m)^{SPACE}*[-*+]{SPACE}+", ""),
    (f"(?m)^{SPACE}*\\d+\\.{SPACE}+", ""),
    ("(?m)^[-*_]{3,}$", ""),
)
# Of each clean-up pattern the strings of which a text must have one, or nothing can match.
NEEDED = (("<",), ("](",), ("![",), ("*",), ("_",), ("`",), (">",), ("-", "*", "+"), (".",), ("-", "*", "_"))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    odd = reduce(lambda a, b: a | b, (F.contains(c, F.lit(x)) for x in ("  ", *SPACES[1:])))
    return trim(F.when(odd, F.regexp_replace(c, f"{SPACE}+", " ")).otherwise(c))


def units(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def head_units(c: Column, n: int) -> Column:
    return F.when(units(c) == F.length(c), F.substring(c, 1, n)).otherwise(F.decode(F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n), "UTF-16BE"))


def tail_units(c: Column, n: int) -> Column:
    """The last n code units; the whole of a shorter text."""
    if n <= 0:
        return F.lit("")
    long = F.when(units(c) == F.length(c), F.right(c, F.lit(n))).otherwise(F.decode(F.substring(F.encode(c, "UTF-16BE"), -2 * n, 2 * n), "UTF-16BE"))
    return F.when(units(c) <= n, c).otherwise(long)


def token_estimate(c: Column) -> Column:
    """A token for every four code units, rounded up."""
    return F.ceil(units(c) / 4).cast("int")


def filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def clean_markdown(c: Column) -> Column:
    """Markdown decoration removed; the order of the rewrites matters."""

    def step(x: Column, rule: tuple[tuple[str, str], tuple[str, ...]]) -> Column:
        (pattern, by), needed = rule
        there = lambda v: reduce(lambda a, b: a | b, (F.contains(v, F.lit(k)) for k in needed))
        return let(x, lambda v: F.when(there(v), F.regexp_replace(v, pattern, by)).otherwise(v))

    return let(reduce(step, zip(CLEAN, NEEDED, strict=True), c), squeeze)


def path_title(path: Column) -> Column:
    """The last part of a path without its suffix, dashes and underscores as spaces."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.regexp_replace(last, "\\.md\\z", ""), "[-_]", " ")


def doc_url(path: Column, root: str, base_url: str) -> Column:
    """The public address of a Markdown file below ``root``."""
    below = F.when(path.startswith(f"{root}/"), F.substr(path, F.lit(len(root) + 2))).otherwise(path)
    page = F.regexp_replace(F.regexp_replace(below, "\\.md\\z", ""), "/index\\z", "")
    return F.concat(F.lit(base_url.removesuffix("/") + "/"), page, F.lit("/"))


def snippet(c: Column, n: int = 800) -> Column:
    return F.when(units(c) > n, F.concat(head_units(c, n), F.lit("…"))).otherwise(c)
