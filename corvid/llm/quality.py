"""Quality rules: compression bands.

zstandard ratios (bytes before / bytes after) of the whole text and of its fixed chunks must lie within
limits that depend on the length: too high a ratio marks repetitive text, too low a ratio incompressible text.

Defined cases: a null or empty text has no words and fails the base rules; a text shorter than the first band
is judged by the base rules alone; a very long text is compressed whole and chunk by chunk, of which few are held at a time;
a ratio that equals a limit lies within it; repeated rows are judged one by one; an empty table gives an empty one; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvid.llm.arrow import light, small
from corvid.llm.textkernel import WordHasher, repeated_words, words

SYMBOLS = "#*$%&|<>"
ASCII = bytes(range(128))


@dataclass(frozen=True)
class Bands:
    """``whole``: (least bytes, lowest ratio, highest ratio) by rising length.  A longer text shares more of its vocabulary
    with itself, so its ratio rises with the length.  The lowest ratios lie below general prose, licence texts and manuals
    among it, and above random base64 (up to 1.38), from 1400 bytes on also above random letters (1.71), from 2048 on hex
    (1.96); the highest lie above tables and manuals, and below a phrase said over and over.  ``other``: the same for texts
    of which ``other_percent`` of the bytes or more are not ASCII, as two or three bytes a letter compress otherwise.
    Chunks of a text longer than one are all of full length, the last being its last bytes, and have limits of their own
    (``chunk``, ``other_chunk``); a shorter text is its own chunk, whose limits are those of the whole."""

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.95, 2.9), (256, 1.13, 3.6), (320, 1.19, 3.8), (384, 1.23, 4.0), (512, 1.29, 4.2), (800, 1.36, 4.4), (1024, 1.45, 4.5), (1400, 1.66, 4.5), (2048, 1.90, 4.8), (4096, 1.91, 5.0),
        (8192, 1.92, 5.0), (16384, 2.0, 5.2), (32768, 2.05, 5.5), (65536, 2.05, 7.0), (262144, 2.05, 8.0),
    )
    other: tuple[tuple[int, float, float], ...] = (
        (128, 0.80, 3.6), (256, 0.95, 4.5), (512, 1.08, 5.2), (1024, 1.20, 5.8), (2048, 1.30, 6.2), (4096, 1.38, 6.8), (16384, 1.42, 7.2), (65536, 1.45, 9.0),
    )
    other_percent: int = 30
    chunk_bytes: int = 4096
    least_chunk: int = 1024
    chunk: tuple[float, float] = (1.91, 5.0)
    other_chunk: tuple[float, float] = (1.38, 6.8)
    level: int = 3
    least_words: int = 10
    window: int = 5
    most_repeated_percent: int = 20


@dataclass
class Judge:
    bands: Bands = field(default_factory=Bands)

    def __post_init__(self):
        self.press = zstandard.ZstdCompressor(level=self.bands.level)
        self.hasher = WordHasher()

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.press.compress(data))

    def verdict(self, data: bytes) -> tuple[float | None, float | None, float | None, bool]:
        """Ratio of the whole, the least and the highest chunk ratio, and whether all lie within the limits."""
        b = self.bands
        other = 100 * len(data.translate(None, ASCII)) >= b.other_percent * max(1, len(data))
        limits = [x for x in (b.other if other else b.whole) if len(data) >= x[0]]
        if not limits:
            return None, None, None, True
        whole = self.ratio(data)
        ok = limits[-1][1] <= whole <= limits[-1][2]
        if len(data) <= b.chunk_bytes:
            parts = [whole] if len(data) >= b.least_chunk else []
        else:
            last = len(data) - b.chunk_bytes
            parts = [self.ratio(data[k : k + b.chunk_bytes]) for k in (*range(0, last, b.chunk_bytes), last)]
        low, high = min(parts, default=None), max(parts, default=None)
        least, most = (b.other_chunk if other else b.chunk) if len(data) >= b.chunk_bytes else limits[-1][1:]
        return whole, low, high, ok and (not parts or (least <= low and high <= most))

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        w, b = words(text), self.bands
        repeated = int(repeated_words(self.hasher(w), b.window)) if len(w) > b.window else 0
        seen: set[str] = set()
        doubled = 0
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\f\r"):
                doubled += line in seen
                seen.add(line)
        failed = len(w) < b.least_words or 100 * repeated > b.most_repeated_percent * len(w)
        whole, low, high, ok = self.verdict(text.encode("utf-8", "surrogatepass"))
        return len(w), sum(map(len, w)), sum(map(text.count, SYMBOLS)), doubled, repeated, failed, whole, low, high, ok and not failed


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, least_chunk_ratio double, highest_chunk_ratio double, kept boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row of measures and a verdict for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands)
        types = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        for b in small(batches):
            found = [judge(t) for t in b.column(1).to_pylist()]
            columns = [b.column(0), *(list(c) for c in zip(*found, strict=True))] if found else [b.column(0), *([] for _ in NAMES[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, t in zip(columns, types, strict=True)], NAMES)

    light(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op5_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
