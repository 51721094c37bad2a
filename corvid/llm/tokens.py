"""Token counts behind a digest cache.

A text's normalised content and the digest of the tokenizer file with its library's version name a stored count.
Only distinct contents that the cache lacks are encoded, and their counts are appended to it.  A repeated append, as
after a lost executor, is harmless: one row per digest is read.  Where a tokenizer drops white space, a run of blanks
is one space in the content, and there is none at its ends; for other tokenizers the content is the text.

Texts are encoded where they lie.  Only those whose content may be another's too, or may be cached, by a bitmap over
the digests, are dealt by their digest first, each once a task.

Defined cases: a null text counts as empty (0 tokens); repeated texts are encoded once; repeated rows and rows
without doc_id each give a row; a text of any length is encoded whole; other columns are ignored, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from corvid.llm.arrow import light, small
from corvid.llm.bitmap import Bitmap
from corvid.llm.scratch import fresh, saved

LIMIT = 2048
#: Texts with any of these go to the library whole: special strings, and characters whose lower case or class depends on more than the character.
ODD_ASCII = re.compile("<\\||[\x1c-\x1f]")
ODD = regex.compile("<\\||[\\x1c-\\x1f\\x85Σİ]|[^\\p{L}\\p{N}\\p{P}\\p{S}\\p{M}\\p{Z}\\s]")
END = b"\xff"  # a byte that no UTF-8 text holds stands for the end of a word


def tokenizer_digest(path: str) -> str:
    library = f"|sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"|tokenizers {tokenizers.__version__}"
    return hashlib.sha256(Path(path).read_bytes() + library.encode()).hexdigest()


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def word_ranks(model: dict) -> dict[bytes, int] | None:
    """A byte-level vocabulary with word ends as merge ranks, if its ids are in the order of its merges; else None."""
    if model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("dropout"):
        return None
    vocab, letters, out = model["vocab"], byte_alphabet(), {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab.get(a + b) for a, b in merges]
    if None in ids or ids != sorted(ids) or len(set(ids)) < len(ids):
        return None
    for token, k in vocab.items():
        body = token.removesuffix("</w>")
        if any(c not in letters for c in body):
            continue
        out[bytes(letters[c] for c in body) + END * (body != token)] = k
    return out


class Counter:
    """Counts tokens as the library does.

    Where the tokenizer splits at a pattern and merges within words, each distinct piece is counted once, by the
    same merges; other tokenizers and texts go to the library itself.
    """

    def __init__(self, path: str, limit: int = 200_000):
        self.path, self.limit, self.known, self.whole, self.split = path, limit, {}, None, None
        if path.endswith(".model"):
            return
        spec = json.loads(Path(path).read_text())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        plain = kinds == ["NFC", "Replace", "Lowercase"] and splits[0].get("type") == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        ranks = word_ranks(spec["model"]) if plain else None
        self.split = regex.compile(splits[0]["pattern"]["Regex"]) if ranks else None
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece if ranks else None

    def library(self, text: str) -> int:
        if self.whole is None:
            self.whole = sentencepiece.SentencePieceProcessor(model_file=self.path) if self.path.endswith(".model") else Tokenizer.from_file(self.path)
        return len(self.whole.encode(text)) if self.path.endswith(".model") else len(self.whole.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> int:
        if self.split is None or (ODD_ASCII if text.isascii() else ODD).search(text):
            return self.library(text)
        known, merge = self.known, self.merge
        if len(known) > self.limit:
            known.clear()
        n = 0
        for p in self.split.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()):
            k = known.get(p)
            if k is None:
                k = known[p] = len(merge(p.encode() + END))
            n += k
        return n


def content_of(text: Column, path: str) -> Column:
    """What a count depends on: blank runs count for nothing in a tokenizer that drops white space."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(plain, "[ \\t\\n\\r]+", " ")) if Counter(path).split else plain


def counted(docs: DataFrame, cache_path: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``; appends what the cache lacked."""
    spark = docs.sparkSession
    light(spark)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    version = tokenizer_digest(path)
    content = content_of(F.col("text"), path)
    digest = F.sha2(content, 256).alias("digest")
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes")
    keyed = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, digest), "text-digests")

    def stored() -> DataFrame:
        return spark.read.schema("digest string, tokenizer string, n_tokens long").parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], "digest string, tokenizer string, n_tokens long").write.mode("append").parquet(cache_path)
    cached = stored().select("digest", F.lit(True).alias("cached"))
    kinds = saved(keyed.groupBy("digest").agg(F.count("*").alias("n")).join(cached, "digest", "left"), "distinct-digests")
    missing, other = kinds.where("cached is null"), kinds.where("cached or n > 1")
    wanted = missing.count()
    if wanted:
        _append(docs.select(digest, content.alias("content")), missing, other, wanted >= other.count(), path, version, cache_path)
    # a table of its own, so that both sides of the join are plain exchanges and Spark can split a digest of very many copies
    out = keyed.join(saved(stored(), "counts"), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")


def _append(texts: DataFrame, missing: DataFrame, other: DataFrame, most_are_new: bool, path: str, version: str, cache_path: str) -> None:
    """Encode the ``texts`` (digest, content) that are ``missing``.  ``other``: digests of more texts than one, or cached.

    Where most digests are new, the bitmap has the other ones, and a text beyond it is encoded in place; where most
    are cached, it has the missing ones, and a text beyond it is left.  Texts within it are decided by an exact join.
    """
    key = F.xxhash64("digest")
    test = Bitmap(other if most_are_new else missing, key).tester()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = Counter(path), set()
        for b in small(batches):
            rows = []
            for name, text, hit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), test(b.column(2).to_numpy()).tolist(), strict=True):
                if not hit and most_are_new:
                    rows.append((name, count(text), None))
                elif hit and name not in seen:
                    seen.add(name)
                    rows.append((name, None, text))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["digest", "n_tokens", "content"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], ["digest", "n_tokens"])

    placed = saved(texts.select("digest", "content", key).mapInArrow(place, "digest string, n_tokens long, content string"), "encoded")
    unsure = placed.where("n_tokens is null").join(missing.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
    new = placed.where("n_tokens is not null").select("digest", "n_tokens").unionByName(unsure.mapInArrow(encode, "digest string, n_tokens long"))
    new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a cache of this call's own, so that the whole work is done and measured each time."""
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh(spark, "token-cache"))
