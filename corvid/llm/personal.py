"""Personal data: base patterns, and what a character-level bidirectional LSTM with a CRF adds to them.

The base spans are those of four patterns with their checks.  The tagger (``tagger``) finds what they can't spell: mail
addresses with words or brackets for their signs, numbers without a country code, cards with other separators, addresses of
hosts in brackets or of the newer form.  It is trained when asked for, from labelled spans (``planted``) set into pieces of
``Model.sample`` documents at most, ``Model.piece`` characters of each.

A text lies in windows of ``Model.size`` characters, each overlapping the next by a half, from its first character to its
last.  Every span of the four kinds holds an at sign or a word for it with a dot near, a pair of colons or four digits near
each other; a window that meets no such place (``places``) has no span by definition and isn't decoded.  Windows are decoded
in blocks; what they give is reconciled over the whole text: pieces of one kind that meet at a window's edge are joined, ends go
to the edges of words, each candidate must pass an exact check of its kind, and of the candidates that overlap those of the
greatest total score are kept (weighted intervals, ties to the earlier start).  Base spans always stay, and nothing that
touches one is added.

Defined cases: a null or empty text has no spans, and the digest of the empty string; repeated rows answer each; a text of
any length is read whole, and its windows go through the tagger a block at a time; an empty table gives an empty one, and
the tagger is then fitted on built-in sentences alone; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvid.llm.arrow import light, small
from corvid.llm.planted import KINDS, labelled, luhn
from corvid.llm.tagger import Tagger

Span = tuple[str, int, int]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Where a span can be: see the module's text.
NUMBERS = re.compile(r"[0-9](?:[^0-9]{0,5}[0-9]){6}|[0-9]{1,3}(?:[^0-9\n]{1,7}[0-9]{1,3}){3}")
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
AT_WORD = r"(?:\b(?:at|AT|arroba|arobase)\b|[\[({<] ?(?:at|AT|@) ?[\])}>])"
WORDS = re.compile(AT_WORD + r"[^\n]{1,60}?(?:\b(?:dot|DOT|punkt|punto|point)\b|\.[A-Za-z]{2})")
AT_SIGN = re.compile(r"\s*[\[({<]\s*(?:at|arroba|arobase|@)\s*[\])}>]\s*|\s+(?:at|arroba|arobase)\s+|\s*@\s*", re.I)
DOT_SIGN = re.compile(r"\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+|\s*\.\s*", re.I)
MAIL = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}")
NUMBER_GAPS = re.compile(r"[ ._/ -]{1,3}")
PHONE_FORM = re.compile(r"\+?[0-9(][0-9 ()./ -]*[0-9]")
DATE = re.compile(r"(?:[0-9]{4}([-./ ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./ ])[0-9]{1,2}\2[0-9]{4})(?![0-9])")
FOURFOLD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


@dataclass(frozen=True)
class Model:
    size: int = 96
    hidden: int = 24
    sample: int = 256  # documents whose pieces carry the labelled spans
    piece: int = 2000  # characters of each
    windows: int = 12_000
    rounds: int = 3
    batch: int = 64
    block: int = 512  # windows decoded at a time
    seed: int = 42


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns that pass their checks, each kind leftmost and without overlap, by start and then kind."""
    out, end = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        # the longest run of local characters before the sign, from the end of the address before; none holds a sign
        low = max(end, text.rfind("@", end, m.start()) + 1)
        start = low + len(text[low : m.start()].rstrip(LOCAL))
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _alphabet() -> np.ndarray:
    """A symbol for each code point: printable ASCII for itself, then line ends and blanks, and letters, digits and other signs beyond."""
    table = np.full(0x3000, 99, np.uint8)
    for c in range(0x3000):
        if 32 <= c < 127:
            table[c] = c - 32
        else:
            kind = unicodedata.category(chr(c))
            table[c] = 95 if c in (9, 10, 13) else 96 if kind[0] == "Z" else 97 if kind[0] in "LM" else 98 if kind[0] == "N" else 99
    return table


SYMBOLS = 100
_TABLE = _alphabet()


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < len(_TABLE), _TABLE[np.minimum(code, len(_TABLE) - 1)], np.where(code < 0x20000, 97, 99)).astype(np.uint8)


def trained(texts: list[str], model: Model = Model()) -> Tagger:
    windows, gold = labelled(texts, model.windows, model.size, model.seed, base_spans)
    tagger = Tagger(SYMBOLS, model.hidden, 2 * len(KINDS) + 1, model.seed)
    tagger.fit(np.stack([symbols(w) for w in windows]), gold, model.batch, model.rounds, seed=model.seed)
    return tagger


def fitted(spark: SparkSession, texts: list[str], model: Model = Model()) -> Tagger:
    """As ``trained``, in a task, whose numpy has as many threads as the task has cores; the texts are ``carriers``, so bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(row, model).w)], pa.binary())], ["weights"])

    tagger = Tagger(SYMBOLS, model.hidden, 2 * len(KINDS) + 1, model.seed)
    tagger.w = pickle.loads(spark.createDataFrame([(texts,)], "texts array<string>").coalesce(1).mapInArrow(run, "weights binary").first().weights)
    return tagger


def carriers(docs: DataFrame, model: Model = Model()) -> list[str]:
    """One piece of each of ``Model.sample`` documents, of those whose ids have the least digests, each from a place that its digest tells."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.lit(model.seed), F.col("doc_id").cast("long"), text)
    at = 1 + F.pmod(F.xxhash64(key, F.lit(1)), F.greatest(F.length(text) - model.piece, F.lit(1)))
    least = docs.select(key.alias("key")).orderBy("key").limit(model.sample).agg(F.max("key")).first()[0]
    # only keys were put in order, so a task sends few bytes; of rows of one key, which are alike, one piece is taken
    rows = docs.select(key.alias("key"), text.substr(at.cast("int"), F.lit(model.piece)).alias("piece")).where(F.col("key") <= F.lit(least))
    return [r.piece for r in rows.groupBy("key").agg(F.min("piece").alias("piece")).orderBy("key").limit(model.sample).collect()] if least is not None else []


def places(text: str) -> list[tuple[int, int]]:
    """Where a span can be."""
    out = []
    if DIGIT.search(text):
        out += [m.span() for m in NUMBERS.finditer(text)]
    if ":" in text:
        out += [m.span() for m in COLONS.finditer(text)]
    if "@" in text:
        out += [m.span() for m in re.finditer("@", text)]
    return out + [m.span() for m in WORDS.finditer(text)]


def window_starts(text: str, size: int, where=places) -> list[int]:
    """Starts of the windows that meet one of the places ``where``; a text of one window or less has one."""
    half = size // 2
    last = max(0, -(-(len(text) - size) // half))
    hit: set[int] = set()
    for a, b in where(text):
        hit.update(range(min(last, max(0, (a - size) // half + 1)), min(last, (b - 1) // half) + 1))
    return [k * half for k in sorted(hit)]


def found_in(path: np.ndarray, above: np.ndarray, start: int, length: int) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) of one window's labels."""
    out, at = [], 0
    inside = np.flatnonzero(path[:length])
    while at < len(inside):
        first = inside[at]
        kind = (int(path[first]) - 1) // 2
        end = at + 1
        while end < len(inside) and inside[end] == inside[end - 1] + 1 and path[inside[end]] == 2 * kind + 2:
            end += 1
        stop = int(inside[end - 1]) + 1
        out.append((KINDS[kind], start + int(first), start + stop, float(above[first:stop].sum())))
        at = end
    return out


def _ip(s: str) -> bool:
    if ":" in s:
        try:
            return s.count(":") > 2 and ipaddress.IPv6Address(s) is not None
        except ValueError:
            return False
    parts = DOT_SIGN.sub(".", s).split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)


def _card(s: str) -> bool:
    digits = NUMBER_GAPS.sub("", s)
    return 13 <= len(digits) <= 19 and digits.isascii() and digits.isdigit() and len(set(digits)) > 1 and luhn(digits)


def _phone(s: str) -> bool:
    n = len(DIGIT.findall(s))
    return 8 <= n <= 15 and PHONE_FORM.fullmatch(s) is not None and not DATE.match(s) and s.count("(") == s.count(")") <= 1 and not (n >= 13 and s.isdigit()) and not FOURFOLD.fullmatch(s)


CHECKS = {"email": lambda s: MAIL.fullmatch(DOT_SIGN.sub(".", AT_SIGN.sub("@", s))) is not None, "ip": _ip, "card": _card, "phone": _phone}


def settled(text: str, span: tuple[str, int, int, float]) -> tuple[str, int, int, float] | None:
    """The span with its ends at the edges of words, if it then passes the check of its kind."""
    kind, a, b, score = span
    word = lambda k: text[k].isalnum() or text[k] == "_"
    while a > 0 and word(a - 1) and word(a):
        a -= 1
    while b < len(text) and word(b) and word(b - 1):
        b += 1
    opened = "+(" if kind == "phone" else ""
    while a < b and not (word(a) or text[a] in opened):
        a += 1
    while a < b and not word(b - 1):
        b -= 1
    if kind == "email":  # words before the name go one by one
        while a < b and not CHECKS[kind](text[a:b]):
            blank = re.search(r"\s+", text[a:b])
            a = a + blank.end() if blank else b
    if kind == "phone" and a and text[a - 1] in "+(":
        a -= 1
    # a number that goes on is another one
    joined = "0123456789" + ("" if kind == "email" else ":" if kind == "ip" else "")
    if a > 1 and text[a - 1] in ".,-/:" and text[a - 2] in joined or b + 1 < len(text) and text[b] in ".,-/:" and text[b + 1] in joined:
        return None
    return (kind, a, b, score) if a < b and CHECKS[kind](text[a:b]) else None


def reconciled(text: str, found: list[tuple[str, int, int, float]], base: list[Span]) -> list[Span]:
    """Base spans, and of ``found`` what is sound and of greatest total score without overlap; see the module's text."""
    whole: set[tuple[str, int, int, float]] = set()
    for kind in KINDS:
        mine = sorted({(a, b, s) for k, a, b, s in found if k == kind})
        joined: list[tuple[int, int, float]] = []
        for a, b, s in mine:  # overlapping pieces of one kind are one candidate beside each for itself
            if joined and a < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]), max(s, joined[-1][2]))
            else:
                joined.append((a, b, s))
        whole.update((kind, *x) for x in mine + joined)
    sound = {c[:3]: c for c in sorted(filter(None, (settled(text, c) for c in whole)), key=lambda c: c[3])}
    taken = sorted((a, b) for _, a, b in base)
    free = [c for c in sound.values() if not any(a < c[2] and c[1] < b for a, b in _near(taken, c[1], c[2]))]
    free.sort(key=lambda c: (c[2], c[1], KINDS.index(c[0])))
    ends, best = [c[2] for c in free], [(0.0, None)]
    for c in free:
        k = int(np.searchsorted(ends, c[1], "right"))
        k = min(k, len(best) - 1)
        with_it = best[k][0] + max(c[3], 1e-6)
        best.append((with_it, (c, k)) if with_it > best[-1][0] else (best[-1][0], None))
    chosen, at = [], len(best) - 1
    while at:
        if best[at][1] is None:
            at -= 1
        else:
            c, at = best[at][1]
            chosen.append(c[:3])
    return sorted(base + chosen, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _near(taken: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of the sorted spans that can overlap a to b: spans of different kinds overlap, so all that begin before b."""
    return [x for x in taken[: bisect.bisect_left(taken, (b,))] if x[1] > a]


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def tagged(texts: list[str], tagger: Tagger, model: Model = Model(), where=places) -> list[list[tuple[str, int, int, float]]]:
    """What the tagger finds in the windows of each text, before it is reconciled."""
    found: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, int, int, np.ndarray]] = []

    def decode() -> None:
        paths, above = tagger.decode(np.stack([w[3] for w in waiting]))
        for (row, start, length, _), path, score in zip(waiting, paths, above, strict=True):
            found[row] += found_in(path, score, start, length)
        waiting.clear()

    for row, text in enumerate(texts):
        starts = window_starts(text, model.size, where)
        ids = symbols(text) if starts else None
        for s in starts:
            piece = ids[s : s + model.size]
            waiting.append((row, s, len(piece), np.pad(piece, (0, model.size - len(piece)))))
            if len(waiting) == model.block:
                decode()
    if waiting:
        decode()
    return found


def scanned(docs: DataFrame, tagger: Tagger, model: Model = Model(), where=places) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added for each row of ``docs``; the numbers and the digest are those of the base."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = tagged(texts, shared.value, model, where)
            rows = []
            for doc, text, mine in zip(batch.column(0).to_pylist(), texts, found, strict=True):
                base = base_spans(text)
                every = reconciled(text, mine, base) if mine else base
                kinds = [k for k, _, _ in base]
                rows.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), len(every) - len(base)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            if rows:
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    light(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scanned(docs, fitted(spark, carriers(docs)))
