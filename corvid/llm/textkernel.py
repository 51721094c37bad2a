"""Array kernels over the words of one text, shared by the text operators.

A word is ``[^\\x20\\x09-\\x0D]+``.  Every kernel takes a whole text; none reads a prefix.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^ \t-\r]+")

#: Odd multiplier of the rolling polynomial hash modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    """The words of a text; a null text has none."""
    return WORD.findall(text) if text else []


class _Known(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class WordHasher:
    """64-bit hashes of words, remembering up to ``limit`` words between texts."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.known = _Known()

    def __call__(self, items: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, items), np.uint64, len(items))


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grow = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            self.up, self.down = grow(BASE), grow(BASE_INVERSE)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` words, modulo 2**64; empty if there are fewer words."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = POWERS.upto(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return (total[width:] - total[:-width]) * down[: n - width + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order is unrelated to their origin."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling; empty if there are fewer values."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step] if step else out, out[step:])
        have += step
    return out


def repeated_words(hashes: np.ndarray, width: int) -> int:
    """Words that lie in a run of ``width`` words found twice or more in the text, the first included."""
    run = rolling(hashes, width)
    if len(run) < 2:
        return 0
    order = np.argsort(run, kind="stable")
    same = run[order][1:] == run[order][:-1]
    twice = np.zeros(len(run), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return covered(np.flatnonzero(twice), width, len(hashes)).sum()


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``width`` words at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + width, -1)
    return np.cumsum(edge[:n]) > 0
