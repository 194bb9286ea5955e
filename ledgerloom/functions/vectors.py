"""Vector expressions that stay inside the JVM, and the embedder seam."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Products summed from left to right in double, up to the shorter end."""
    shorter = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0 or anything isn't finite."""
    product, size = dot(a, b), norm(a) * norm(b)
    score = F.when((size > 0) & _finite(product) & _finite(size), product / size)
    return F.when(_finite(score), score + F.lit(0.0)).otherwise(F.lit(0.0))


def check_dim(a: Column, dim: int) -> Column:
    """``a``, or an error if it hasn't ``dim`` elements."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {dim}, got "), F.size(a).cast("string"))))


def l2_normalize(a: Column) -> Column:
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: (x.cast("double") / length).cast("float"))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


Embedder = Callable[[list[str]], np.ndarray]


def bag_of_words(dim: int = 32) -> Embedder:
    """Counts of words by (sum of their bytes) mod ``dim``."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, sum(w.encode()) % dim] += 1
        return out

    return embed


def hashed_ngrams(dim: int = 384, n: int = 3) -> Embedder:
    """Mean-pooled signed hashes of character n-grams, of length one."""

    def embed(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            padded = f" {' '.join(t.lower().split())} "
            for k in range(max(0, len(padded) - n + 1)):
                h = xxhash.xxh64_intdigest(padded[k : k + n])
                out[i, h % dim] += 1 if h >> 63 else -1
            out[i] /= max(float(np.linalg.norm(out[i])), 1e-12)
        return out

    return embed


def embed_column(text: Column, embedder: Embedder) -> Column:
    """Texts to vectors, an Arrow batch at a time; null counts as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embedder(s.fillna("").tolist())), index=s.index)

    return run(text)
