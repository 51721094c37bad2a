"""Embedding providers: a text column in, an array<float> column out, an Arrow batch at a time.

The default needs no model and no network.  The others load a model once a worker, or call a service in batches
with retries; they are made only when they are asked for.
"""

from __future__ import annotations

import json
import platform
import random
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvid.functions.vectors import hashed, pieces

RETRIED = {429, 500, 503}


@dataclass(frozen=True)
class Accelerator:
    """What a local model runs on: precision, execution providers in their order, texts in a call."""

    backend: str
    precision: str
    providers: tuple[str, ...]
    batch: int


# The settings of each kind of machine.
ARM = Accelerator("metal", "q8", ("CPUExecutionProvider",), 32)
CUDA = Accelerator("cuda", "fp32", ("CUDAExecutionProvider", "CPUExecutionProvider"), 64)
CPU = Accelerator("cpu", "q8", ("CPUExecutionProvider",), 16)


def accelerator(system: str | None = None, machine: str | None = None, probe: Callable[[], bool] | None = None) -> Accelerator:
    """The machine's accelerator: Apple's chips are known by name, a CUDA card by its driver's tool, else there is none."""
    if (system or platform.system()) == "Darwin" and (machine or platform.machine()) in ("arm64", "aarch64"):
        return ARM
    return CUDA if (probe or _cuda)() else CPU


def _cuda() -> bool:
    try:
        return subprocess.run(["nvidia-smi"], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, timeout=2, check=False).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return False
VECTOR = pa.list_(pa.float32())


def with_retry(call: Callable, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """``call()``, again after 2**n seconds and some jitter when a service is busy, ``retries`` times at most."""
    for attempt in range(retries + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt == retries:
                raise
        sleep(2.0**attempt + random.random() * 0.2)
    raise AssertionError


class Provider:
    """What the engine asks of a provider: ``dimensions``, ``name``, and vectors of a list of texts in their order."""

    dimensions: int
    name: str
    batch = 64

    def vectors(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def open(self) -> Callable[[list[str]], np.ndarray]:
        """Called once a worker."""
        return self.vectors

    def resolved(self) -> Provider:
        """Called once on the driver: this provider ready for use, or the one that takes its place in all tasks."""
        return self

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        run = self.open()
        return np.concatenate([run(texts[k : k + self.batch]) for k in range(0, len(texts), self.batch)]).tolist()

    def column(self, text: Column) -> Column:
        provider, size = self, self.batch

        @F.arrow_udf("array<float>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vectors = provider.open()
            for b in (p for b in batches for p in pieces(b, size)):
                texts = [t or "" for t in b.to_pylist()]
                x = vectors(texts).astype(np.float32) if texts else np.zeros((0, provider.dimensions), np.float32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

        return run.asNondeterministic()(text)


@dataclass
class Hashing(Provider):
    """Word counts by hash bucket; integers, so cosines don't depend on the order of summation."""

    dimensions: int = 768
    name: str = "hashing"
    batch: int = 1024

    def vectors(self, texts: list[str]) -> np.ndarray:
        return np.stack([hashed(t, self.dimensions) for t in texts])


@dataclass
class Onnx(Provider):
    """A local model: mean of the token vectors under the mask, scaled to unit length."""

    model_path: str
    tokenizer_path: str
    dimensions: int = 768
    name: str = "onnx"
    batch: int = 0  # 0: as the machine's accelerator has it
    providers: tuple[str, ...] = ()

    def __post_init__(self):
        self.batch = self.batch or accelerator().batch

    def open(self):
        """The model on the worker's own accelerator, or on what else there is."""
        import onnxruntime
        from tokenizers import Tokenizer

        there = onnxruntime.get_available_providers()
        chosen = [p for p in self.providers or accelerator().providers if p in there] or ["CPUExecutionProvider"]
        session, tok = onnxruntime.InferenceSession(self.model_path, providers=chosen), Tokenizer.from_file(self.tokenizer_path)
        tok.enable_padding()
        wanted = {i.name for i in session.get_inputs()}

        def run(texts: list[str]) -> np.ndarray:
            enc = tok.encode_batch(texts)
            feed = {"input_ids": np.array([e.ids for e in enc]), "attention_mask": np.array([e.attention_mask for e in enc]), "token_type_ids": np.array([e.type_ids for e in enc])}
            out = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
            mask = feed["attention_mask"][..., None]
            mean = (out * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
            return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)

        return run


@dataclass
class Service(Provider):
    """An HTTP embedding service: ``body`` makes a request of a batch of texts, ``read`` takes the vectors from the answer."""

    url: str
    body: Callable[[list[str]], dict]
    read: Callable[[dict], list[list[float]]]
    dimensions: int = 768
    name: str = "service"
    batch: int = 100
    headers: tuple[tuple[str, str], ...] = ()

    def vectors(self, texts: list[str]) -> np.ndarray:
        request = urllib.request.Request(self.url, json.dumps(self.body(texts)).encode(), {"Content-Type": "application/json", **dict(self.headers)})

        def call():
            with urllib.request.urlopen(request, timeout=60) as r:
                return json.load(r)

        return np.array(self.read(with_retry(call)), np.float32)


@dataclass
class Ollama(Service):
    """A local model service, asked once whether it is there and has the model, which it is else told to fetch.  Where it is not, ``fallback`` embeds."""

    base: str = ""
    model: str = ""
    fallback: Provider | None = None

    def models(self) -> list[str] | None:
        """Names of the models that the service has; None if it can't be reached."""
        try:
            with urllib.request.urlopen(f"{self.base}/api/tags", timeout=3) as r:
                return [m["name"] for m in json.load(r).get("models", [])]
        except (OSError, ValueError):
            return None

    def ready(self) -> bool:
        """Whether the service can be used, once it has the model."""
        have = self.models()
        if have is None:
            return False
        if self.model not in have and f"{self.model}:latest" not in have:
            body = json.dumps({"name": self.model, "stream": True}).encode()
            request = urllib.request.Request(f"{self.base}/api/pull", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=3600) as r:
                for line in r:  # one JSON object a line, until the model is there; others are notes
                    try:
                        error = json.loads(line).get("error")
                    except ValueError:
                        continue
                    if error:
                        raise OSError(f"pull of {self.model}: {error}")
        return True

    def resolved(self) -> Provider:
        if self.ready():
            return self
        if self.fallback is None:
            raise OSError(f"no service at {self.base}, and no other provider to fall back on")
        if self.fallback.dimensions != self.dimensions:
            raise ValueError(f"the fallback makes vectors of {self.fallback.dimensions}, not {self.dimensions}")
        return self.fallback.resolved()


def ollama(url="http://localhost:11434", model="nomic-embed-text", dimensions=768, fallback: Provider | None = None) -> Ollama:
    return Ollama(f"{url}/api/embed", lambda t: {"model": model, "input": t}, lambda r: r["embeddings"], dimensions, "ollama", 32, base=url, model=model, fallback=fallback)


def openai(key: str, model="text-embedding-3-small", dimensions=768, url="https://api.openai.com/v1/embeddings") -> Service:
    sized = {"dimensions": dimensions} if "3" in model else {}
    return Service(url, lambda t: {"model": model, "input": t, **sized}, lambda r: [x["embedding"] for x in r["data"]], dimensions, "openai", 100, (("Authorization", f"Bearer {key}"),))


def gemini(key: str, model="text-embedding-004", dimensions=768, url="https://generativelanguage.googleapis.com/v1beta") -> Service:
    one = lambda t: {"model": f"models/{model}", "content": {"parts": [{"text": t}]}, "taskType": "RETRIEVAL_DOCUMENT"}
    return Service(f"{url}/models/{model}:batchEmbedContents", lambda t: {"requests": [one(x) for x in t]}, lambda r: [x["values"] for x in r["embeddings"]], dimensions, "gemini", 100, (("x-goog-api-key", key),))


def voyage(key: str, model="voyage-3", dimensions=1024, url="https://api.voyageai.com/v1/embeddings") -> Service:
    return Service(url, lambda t: {"model": model, "input": t, "input_type": "document"}, lambda r: [x["embedding"] for x in r["data"]], dimensions, "voyage", 128, (("Authorization", f"Bearer {key}"),))


PROVIDERS: dict[str, Callable[..., Provider]] = {"hashing": Hashing, "onnx": Onnx, "ollama": ollama, "openai": openai, "gemini": gemini, "voyage": voyage}


def provider(name: str = "hashing", **options) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}; known: {', '.join(PROVIDERS)}")
    return PROVIDERS[name](**options)


def embedding_text() -> Column:
    return F.concat_ws("\n", "title", "section", "content")


def embedded(chunks: DataFrame, p: Provider) -> DataFrame:
    """``chunks`` with their embeddings, computed in the row, so none can be matched with another chunk."""
    return chunks.withColumn("embedding", p.column(embedding_text()))
