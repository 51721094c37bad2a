"""Engine settings: typed, with defaults, checked on construction."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


class SettingsError(ValueError):
    """A setting is missing or out of range."""


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800  # estimated tokens
    chunk_overlap: int = 100  # estimated tokens; 0 is none
    dimensions: int = 768
    top_k: int = 10
    lists: int = 100  # cells of an index
    cache_entries: int = 200
    cache_seconds: int = 3600
    fetch_partitions: int = 10
    fetch_retries: int = 3
    fetch_delay: int = 1  # seconds before the first retry
    provider: str = "hashing"
    provider_key: str = ""  # of an embedding service
    provider_model: str = ""
    provider_url: str = ""
    model_path: str = ""  # of a local model, and its tokenizer
    tokenizer_path: str = ""
    store_path: str = ""  # a folder that driver and executors share; empty: one below the shared folder
    git_api: str = "https://api.github.com"
    git_raw: str = "https://raw.githubusercontent.com"
    most_links: int = 500  # pages that a walk over links finds at most

    def __post_init__(self):
        if self.chunk_size < 1 or self.chunk_overlap < 0 or self.dimensions < 1 or self.top_k < 1 or self.lists < 1:
            raise SettingsError("chunk_size, dimensions, top_k and lists must be positive, chunk_overlap not negative")
        if self.cache_entries < 1 or self.cache_seconds < 0 or self.fetch_partitions < 1:
            raise SettingsError("cache_entries and fetch_partitions must be positive, cache_seconds not negative")

    def provider_options(self) -> dict[str, str]:
        """What is given of a provider's own options."""
        named = {"key": self.provider_key, "model": self.provider_model, "url": self.provider_url, "model_path": self.model_path, "tokenizer_path": self.tokenizer_path}
        return {k: v for k, v in named.items() if v}

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "CORVID_") -> Settings:
        """Settings from variables such as CORVID_CHUNK_SIZE; numbers are coerced, what is absent has its default."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or raw == "":
                continue
            try:
                given[f.name] = int(raw) if f.type == "int" else raw
            except ValueError as e:
                raise SettingsError(f"{prefix}{f.name.upper()} must be a whole number: {raw!r}") from e
        return cls(**given)
