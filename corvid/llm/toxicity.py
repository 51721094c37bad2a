"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: look-alike letters, small and capital, to Latin ones, lower case, digits and signs in words to
the letters they stand for.  Compatibility forms, such as mathematical, circled or wide letters, are normalised (NFKC).
A word with signs or digits at its ends is read both ways, with and without them; one with accents also without those; and
single letters in a row, one sign or blank apart, are also read as one word.
The lexicon is learned: words and word beginnings of labelled texts, weighted by their log odds.  A text's weights are
added up, hits inside an exception phrase left out, and divided by a slowly rising function of its length; a logistic
curve of two coefficients turns that into a score.  Exception phrases are built-in ones and those learned: a hit with
the word before or after it that several clean labelled texts have and no toxic one.

Learning takes at most ``sample`` labelled rows, those of smallest hash, and never one whose
crc32(doc_id as text) mod 5 is 0; labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has no hits and gets the score of no hits; a text of any length is matched whole;
labels given twice count as the highest; without any usable label, as of an empty table of either kind, a built-in
lexicon serves; of hits at one place the heaviest counts; repeated rows are scored each; an empty table of documents
gives an empty one; other columns are ignored by ``scored`` and kept by ``without_toxic``, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvid.llm.arrow import any_names, light, small

# Letters that look like Latin ones, signs that stand for letters, phrases that excuse a hit, and a first lexicon.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ℓ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = (
    "clown car", "clown fish", "pathetic fallacy", "trash bin", "trash can",
    "bande d amis", "nez de clown", "poisson clown", "sac poubelle",
    "clown nase", "müll abfuhr", "idioten sicher",
    "bote de basura", "cubo de basura", "nariz de payaso", "pez payaso",
)
FIRST = ("disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "worthless")

_FULL = {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_TABLE = {**_FULL, **{ord(k): v for k, v in LOOKALIKES.items()}, 0x200B: "", 0x200C: "", 0x200D: "", 0x00AD: "", 0xFEFF: ""}
_SIGNS = str.maketrans(SIGNS)
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _TABLE))) + "]")
_BESIDE = re.compile(r"[^\W\d_](?:[0-9@$]|!+(?=[^\W\d_]))|[0-9@$!][^\W\d_]")  # a letter and a sign that may stand for one
MARKS = re.compile("[\u0300-\u036f]+")
ACCENTED = re.compile(r"(?=\S*[^\x00-\x7f])\S+")
#: Three single letters or more, each behind one sign that is no letter or digit, or a blank.
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[^\w]|_)(?:[^\W\d_](?:[^\w]|_))+[^\W\d_](?![^\W_])")
SPACED_HINT = re.compile(r"(?<![^\W_])[^\W\d_](?:[^\w]|_)[^\W\d_](?:[^\w]|_)[^\W\d_](?![^\W_])")
_RUN = re.compile(r"(?:[^\W_]|[@$!])+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _read(text: str) -> str:
    """Runs of letters, digits and signs as words; with those at the ends and without, if there are any."""
    out, last = [], 0
    for m in _BESIDE.finditer(text):
        start = m.start()
        if start < last:
            continue
        while start > last and (text[start - 1].isalnum() or text[start - 1] in "@$!"):
            start -= 1
        run = _RUN.match(text, start)[0]
        core = run.rstrip("!")
        whole, bare = core.translate(_SIGNS), core.strip("0123456789@$!").translate(_SIGNS)
        out += (text[last:start], whole if whole == bare else f"{whole} {bare}", " ")
        last = start + len(run)
    return "".join(out) + text[last:] if out else text


def _plain(text: str) -> str:
    """Compatibility forms (mathematical, circled, wide letters, ligatures) and look-alikes as plain letters; accents joined to their letters, or gone where there is no such letter."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = MARKS.sub("", text)
        if _ODD.search(text):
            text = text.translate(_TABLE)
    return text


def folded(text: str) -> str:
    """The text's words, folded, one space apart, with a space at either end."""
    return f" {' '.join(_LETTERS.findall(_read(_plain(text).lower())))} "


def without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class _Bare(dict):
    """Words without their accents; remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) > 100_000:
            self.clear()
        bare = self[word] = without_accents(word)
        return bare


def second_readings(text: str, clean: str, bare: dict[str, str]) -> list[tuple[str, str]]:
    """(word as folded, another reading of it): words without their accents, and runs of single letters, as in ``i.d.i.o.t``, joined."""
    out = [(w, bare[w]) for w in ACCENTED.findall(clean) if bare[w] != w] if not clean.isascii() else []
    if SPACED_HINT.search(text):
        for m in SPACED.finditer(_plain(text).lower()):
            joined = "".join(c for c in m[0] if c.isalpha())
            out += [("", f"{joined} {joined[1:]} {joined[:-1]}")]  # a word of one letter may stand beside the run
    return out


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    least_rows: int = 6
    least_odds: float = 2.5
    entries: int = 5_000
    shortest: int = 4
    longest: int = 7
    length_scale: float = 400.0
    least_excuses: int = 3  # clean texts that must have an exception phrase
    excuses: int = 500


@dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...]
    slope: float = 1.0
    bias: float = -3.0
    length_scale: float = 400.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    bound: tuple[str, ...] = ()  # which of the settings' limits cut something off


class Scorer:
    def __init__(self, model: Model):
        self.model, self.machine, self.bare = model, ahocorasick.Automaton(), _Bare()
        for word, weight in model.lexicon:
            self.machine.add_word(word, (len(word), weight))
        for phrase in model.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, clean: str) -> dict[int, float]:
        """The heaviest weight at each place of a folded text where a hit begins, but for hits inside exception phrases."""
        found = list(self.machine.iter(clean)) if len(self.machine) else []
        ends: dict[int, int] = {}
        for end, (n, w) in found:
            if w is None:
                ends[end - n + 1] = max(end, ends.get(end - n + 1, 0))
        best: dict[int, float] = {}
        starts, at, reach = sorted(ends), 0, -1
        for start, end, w in sorted((end - n + 1, end, w) for end, (n, w) in found if w is not None):
            while at < len(starts) and starts[at] <= start:
                reach = max(reach, ends[starts[at]])
                at += 1
            if end > reach:
                best[start] = max(w, best.get(start, 0.0))
        return best

    def weight(self, text: str | None) -> float:
        """Summed weights of hits, over a function of the length."""
        if not text:
            return 0.0
        clean = folded(text)
        found = list(self.hits(clean).values())
        for first, second in second_readings(text, clean, self.bare):  # what a second reading says beyond the first
            more = math.fsum(self.hits(f" {second} ").values()) if second else 0.0
            if more > 0:
                found.append(max(0.0, more - math.fsum(self.hits(f" {first} ").values())))
        return math.fsum(found) / (1.0 + math.log1p(len(clean) / 6 / self.model.length_scale))

    def contexts(self, text: str) -> set[str]:
        """Each hit's word with the word before it, and with the word after it."""
        clean = folded(text)
        out = set()
        for start in self.hits(clean):
            left, right = start + 1, clean.index(" ", start + 1)
            if left > 1:
                out.add(clean[clean.rindex(" ", 0, left - 1) + 1 : right])
            if right + 1 < len(clean):
                out.add(clean[left : clean.index(" ", right + 1)])
        return out

    def __call__(self, text: str | None) -> float:
        z = self.model.bias + self.model.slope * self.weight(text)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _features(text: str, s: Settings) -> set[str]:
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(s.shortest, min(s.longest, len(w)) + 1))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by damped Newton steps with a small ridge."""
    a, w = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.eye(2) * 1e-2, grad)
        w -= step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def learned(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """A model from labelled documents outside the held-out fifth.

    What reaches the driver is bounded: the sample's ids, ``entries`` lexicon lines, and two numbers for each sampled row.
    """
    spark = docs.sparkSession
    light(spark)
    fallback = Model(tuple((f" {w} ", 3.0) for w in FIRST), 1.5, -2.0, s.length_scale)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id")) != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample).collect()
    if not chosen or len({r.toxic for r in chosen}) < 2:
        return fallback
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").where("text is not null").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_of, bad = Counter(), Counter()
        total = [0, 0]
        for b in small(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = _features(text, s)
                total[y > 0] += 1
                all_of.update(f)
                if y > 0:
                    bad.update(f)
        keys = list(bad)
        yield pa.RecordBatch.from_arrays([pa.array(["", *keys], pa.string()), pa.array([sum(total), *(all_of[k] for k in keys)], pa.int64()), pa.array([total[1], *(bad[k] for k in keys)], pa.int64())], ["feature", "n", "n_toxic"])
        rest = [k for k, v in all_of.items() if k not in bad and v]
        for i in range(0, len(rest), 50_000):
            part = rest[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([all_of[k] for k in part], pa.int64()), pa.array([0] * len(part), pa.int64())], ["feature", "n", "n_toxic"])

    counts = rows.mapInArrow(count, "feature string, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).where(F.col("n_toxic") >= s.least_rows).cache()
    total = counts.where("feature = ''").first()
    if total is None or total.n_toxic == total.n:
        counts.unpersist()
        return fallback
    prior = total.n_toxic / (total.n - total.n_toxic)
    odds = F.log((F.col("n_toxic") + 0.5 * prior) / (F.col("n") - F.col("n_toxic") + 0.5) / F.lit(prior))
    top = counts.where("feature <> ''").select("feature", odds.alias("w"), "n_toxic").where(F.col("w") >= s.least_odds).orderBy(F.desc("w"), "feature").limit(s.entries).collect()
    counts.unpersist()
    entries = len(top)
    further: dict[str, int] = {}
    for r in top:
        for k in range(2, len(r.feature)):
            further[r.feature[:k]] = max(further.get(r.feature[:k], 0), r.n_toxic)
    top = [r for r in top if further.get(r.feature, 0) < 0.9 * r.n_toxic]  # a beginning that stands for one longer entry alone says less than that
    kept: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r.feature), r.feature)):  # a longer entry stays only if it says clearly more than a beginning of it
        if all(kept.get(r.feature[:k], -9.0) < r.w - 1.0 for k in range(2, len(r.feature))):
            kept[r.feature] = round(float(r.w), 4)
    lexicon = tuple(sorted(kept.items()))
    plain = Model(lexicon, 1.0, 0.0, s.length_scale)

    def excuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(plain)
        for b in small(batches):
            found = [(c, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c in scorer.contexts(t)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["phrase", "y"])

    seen = rows.mapInArrow(excuse, "phrase string, y int").groupBy("phrase").agg(F.count("*").alias("n"), F.max("y").alias("toxic"))
    learned_phrases = seen.where((F.col("toxic") <= 0) & (F.col("n") >= s.least_excuses)).orderBy(F.desc("n"), "phrase").limit(s.excuses).collect()
    phrases = tuple(sorted({*EXCEPTIONS, *(r.phrase for r in learned_phrases)}))
    model = Model(lexicon, 1.0, 0.0, s.length_scale, phrases)
    bound = tuple(name for name, n, most in (("sample", len(chosen), s.sample), ("entries", entries, s.entries), ("excuses", len(learned_phrases), s.excuses)) if n >= most)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array([scorer.weight(t) for t in b.column(0).to_pylist()], pa.float64()), b.column(1).cast(pa.int32())], ["x", "y"])

    xy = rows.mapInArrow(weigh, "x double, y int").toPandas().sort_values(["x", "y"])
    slope, bias = _logistic(xy["x"].to_numpy(float), (xy["y"].to_numpy() > 0).astype(float))
    return Model(lexicon, slope, bias, s.length_scale, phrases, bound) if slope > 0 else fallback


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in small(batches):
            p = [scorer(t) for t in b.column(1).to_pylist()]
            held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    light(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


@any_names
def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in small(batches):
            yield b.filter(pa.array([scorer(t) < limit for t in b.column(at).to_pylist()], pa.bool_()))

    light(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
