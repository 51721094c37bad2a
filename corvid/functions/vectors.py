"""Vector columns: cosine similarity and the offline embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Scores are rounded, as equal vectors may differ in the last digits by their place in a product.
PLACES = 12
#: Rows that are worked on at a time.
ROWS = 512
TOKEN = re.compile(r"[^\W_]+")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns in double precision; null for a zero vector or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def pieces(column: pa.Array, rows: int = ROWS) -> Iterator[pa.Array]:
    """A batch in stretches, so that what is made of one at a time stays small; an empty batch is one of them."""
    for at in range(0, len(column) or 1, rows):
        yield column.slice(at, rows)


def matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows as doubles, which rows have that length and no nulls); other rows are zero."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    ok = (sizes == dimensions) & column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dimensions))
    if dimensions and ok.any():
        keep = column.filter(pa.array(ok))
        out[ok] = np.asarray(keep.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dimensions)
    ok &= np.isfinite(out).all(axis=1)
    out[~ok] = 0
    return out, ok


class TopK:
    """The best ``limit`` (key, score) of each of ``n`` queries, of equal scores the lesser keys, over any number of parts."""

    def __init__(self, n: int, limit: int):
        self.limit, self.least = limit, np.full(n, -np.inf)
        self.query, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, keys: np.ndarray, who: np.ndarray) -> None:
        """``scores``: a row for each of ``keys``, a column for each of the queries ``who``."""
        scores = scores.round(PLACES)
        floor = self.least[who]
        if len(keys) > self.limit:
            floor = np.maximum(floor, np.partition(scores, -self.limit, axis=0)[-self.limit])
        i, j = np.nonzero(scores >= floor)
        if not len(i):
            return
        q, k, s = np.append(self.query, who[j]), np.append(self.key, keys[i]), np.append(self.score, scores[i, j])
        order = np.lexsort((k, -s, q))
        q, k, s = q[order], k[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.limit
        self.query, self.key, self.score = q[keep], k[keep], s[keep]
        n = np.bincount(self.query, minlength=len(self.least))
        full = n == self.limit
        self.least[full] = self.score[np.cumsum(n)[full] - 1]


class Asked:
    """Queries (ids, vectors of any lengths) that meet rows; only those of a row's length, and with a direction, do."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, limit: int):
        self.ids, self.best, self.groups = ids, TopK(len(ids), limit), {}
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[~np.isnan(sizes.astype(float))]).astype(int).tolist():
            x, ok = units(vectors, size)
            if ok.any():
                self.groups[size] = np.flatnonzero(ok), x[ok]

    def meet(self, keys: np.ndarray, vectors: pa.Array, cells: np.ndarray | None = None, asking: dict | None = None) -> None:
        """All rows meet all queries; or a row of cell c the queries ``asking[c]`` (positions, sorted)."""
        for at in range(0, len(keys), ROWS):
            here = slice(at, at + ROWS)
            self._meet(keys[here], vectors.slice(at, ROWS), None if cells is None else cells[here], asking)

    def _meet(self, keys: np.ndarray, vectors: pa.Array, cells: np.ndarray | None, asking: dict | None) -> None:
        for size, (who, q) in self.groups.items():
            x, ok = units(vectors, size)
            if not ok.any():
                continue
            if asking is None:
                self.best.add(x[ok] @ q.T, keys[ok], who)
                continue
            for c in np.unique(cells[ok]).tolist():
                mine = np.flatnonzero(np.isin(who, asking.get(c, ())))
                if len(mine):
                    at = ok & (cells == c)
                    self.best.add(x[at] @ q[mine].T, keys[at], who[mine])

    def found(self, names: list[str]) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[b.query]), pa.array(b.key), pa.array(b.score)], names)


def units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, which rows have that many numbers and a direction)."""
    x, ok = matrix(column, size)
    norm = np.sqrt((x * x).sum(axis=1))
    ok &= norm > 0
    return x / np.where(ok, norm, 1)[:, None], ok


def cosine_to(query: Sequence[float]) -> Callable[[Column], Column]:
    """A column function: cosine similarity to one fixed vector, an Arrow batch at a time."""
    q = np.asarray(query, float)
    size = float(np.sqrt(q @ q))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in (p for b in batches for p in pieces(b)):
            x, ok = matrix(v, len(q))
            norm = np.sqrt((x * x).sum(axis=1)) * size
            ok &= norm > 0
            yield pa.array(np.divide(x @ q, norm, out=np.zeros(len(x)), where=ok).round(PLACES), mask=~ok)

    return score


def hashed(text: str | None, dimensions: int) -> np.ndarray:
    """Counts of a text's words by md5 bucket."""
    at = [int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dimensions for w in TOKEN.findall((text or "").lower())]
    return np.bincount(at, minlength=dimensions).astype(np.float32) if at else np.zeros(dimensions, np.float32)
