"""Vectors as arrays of doubles, and a stand-in for a sentence encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for null and zero vectors."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


#: Words whose hashes are kept at a time.
MOST_WORDS = 1 << 17


class _Codes(dict):
    """Twice a word's dimension, and one more where its sign is positive; hashed when first met."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: str) -> int:
        h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
        self[word] = code = 2 * (int(h[:7], 16) % self.dims) + (h[7] >= "8")
        return code


def encoder(name: Callable[[list[str]], np.ndarray] | None = None, dims: int = 256):
    """A pandas UDF that turns texts into unit vectors.  ``name`` gives the vectors of a batch of
    texts (a model's encode); by default words are hashed to signed dimensions."""

    def hashed(texts: list[str]) -> np.ndarray:
        out, codes = np.zeros((len(texts), dims)), _Codes(dims)
        for i, t in enumerate(texts):
            said = (t or "").lower().split()
            n = np.bincount(np.fromiter(map(codes.__getitem__, said), np.int64, len(said)), minlength=2 * dims)
            out[i] = n[1::2] - n[::2]
            if len(codes) > MOST_WORDS:
                codes.clear()
        return out

    make = name or hashed

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            v = make([t or "" for t in texts])
            size = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(v, size, out=np.zeros_like(v), where=size > 0)))

    return encode
