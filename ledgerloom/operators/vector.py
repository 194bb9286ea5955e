"""Cosine top-k: exact, for one query or many, and by locality hashing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.keys import KEY, matches
from ..functions.vectors import check_dim, cosine, literal
from ._shared import cut


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """``vectors`` with the rows of ``new`` in place of those of equal key; of
    several new rows of a key, the one with the greatest embedding."""
    latest = Window.partitionBy(*KEY).orderBy(F.col("embedding").desc())
    one = new.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    return vectors.join(one.select(*KEY), list(KEY), "left_anti").unionByName(one)


def remove(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    return vectors.join(keys.select(*KEY), list(KEY), "left_anti")


def topk(vectors: DataFrame, query: Sequence[float], k: int, namespace: str | None = None, collection: str | None = None, tie: Sequence[str] = KEY) -> DataFrame:
    """The ``k`` rows with the greatest cosine, ties by key.

    The prefix filter reaches the scan.  A vector of another dimension than
    the query is an error.
    """
    kept = vectors.where(matches(namespace, collection))
    scored = kept.withColumn("score", cosine(check_dim(F.col("embedding"), len(query)), literal(query))).drop("embedding")
    return scored.orderBy(F.col("score").desc(), *tie).limit(k)


#: Rows of a block of queries or vectors, and queries of it scored at a time.
BLOCK_ROWS, SCORED_ROWS = 8192, 256
#: Scores this near to the k-th by matrix product are computed again one by one.
_NEAR = 1e-9


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    rows = t.column(column).combine_chunks()
    lengths = pc.list_value_length(rows).unique().to_pylist()
    if len(lengths) > 1 or None in lengths:
        raise ValueError(f"{column} has null vectors or several dimensions: {lengths}")
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _units(m: np.ndarray) -> np.ndarray:
    """Rows of length one; 0 where a norm is 0 or anything isn't finite."""
    with np.errstate(all="ignore"):
        size = np.linalg.norm(m, axis=1, keepdims=True)
        good = np.isfinite(size) & (size > 0)
        return np.where(good, m / size, 0.0)


def _best(k: int, kind: pa.Schema):
    """The ``k`` nearest vectors of a block for each query of another."""

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows or k < 1:
            return kind.empty_table()
        # in the order of keys, so that the first of equal scores are the ones to keep
        held = held.take(pc.sort_indices(held, sort_keys=[(c, "ascending") for c in KEY], null_placement="at_start"))
        q, v = _matrix(asked, "query"), _matrix(held, "embedding")
        if q.shape[1] != v.shape[1]:
            raise ValueError(f"dimension mismatch: expected {q.shape[1]}, got {v.shape[1]}")
        q, v = _units(q), _units(v)
        m, out = min(k, len(v)), []
        for at in range(0, len(q), SCORED_ROWS):
            part = q[at : at + SCORED_ROWS]
            rough = part @ v.T
            least = np.partition(rough, len(v) - m, axis=1)[:, len(v) - m]
            i, j = np.nonzero(rough >= least[:, None] - _NEAR)
            # the last bits of a product depend on its place in the matrix
            score = np.concatenate([(part[i[x : x + 65536]] * v[j[x : x + 65536]]).sum(1) for x in range(0, len(i), 65536)])
            order = np.lexsort((j, -score, i))
            first = np.searchsorted(i, np.arange(len(part)))
            kept = order[np.arange(len(order)) - first[i[order]] < m]
            take = pa.array(j[kept])
            columns = [asked.column("query_id").take(pa.array(at + i[kept])), *[held.column(c).take(take) for c in KEY], pa.array(score[kept])]
            out.append(pa.Table.from_arrays(columns, names=["query_id", *KEY, "score"]))
        return pa.concat_tables(out).cast(kind)

    return run


def topk_each(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k of every row of ``queries`` (``query_id, query``).

    Every block of queries meets every block of vectors in a task of its own,
    which keeps ``k`` rows per query, so nothing is collected on the driver
    and no task holds more than two blocks.
    """

    def blocks(df: DataFrame) -> int:
        return max(1, -(-df.count() // block_rows))

    across, down = blocks(queries), blocks(vectors)

    def spread(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """``df`` in ``n`` blocks, a copy for each of the other side's ``m``."""
        block = F.pmod(F.xxhash64(*[c for c in df.columns if c in ("query_id", *KEY)]), F.lit(n)).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    asked = spread(queries.select("query_id", "query"), "q", across, "v", down)
    held = spread(vectors.select(*KEY, "embedding"), "v", down, "q", across)
    kind = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *[T.StructField(c, T.StringType()) for c in KEY], T.StructField("score", T.DoubleType())])
    found = asked.groupBy("q", "v").cogroup(held.groupBy("q", "v")).applyInArrow(_best(k, to_arrow_schema(kind)), kind)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *KEY)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class HashedIndex:
    """Approximate cosine search by bit codes: one row per vector, with a bit
    for the side of each of ``64 * words`` random hyperplanes it lies on.

    A query counts the codes at every Hamming distance, takes the distance
    within which there are enough of them, and scores only those vectors
    exactly.  The planes depend on the seed alone, so nothing is fitted and
    every vector is indexed.  Its recall on random vectors of 64 dimensions,
    the hardest kind, is about 0.98.
    """

    def __init__(self, vectors: DataFrame, dim: int, words: int = 8, seed: int = 11):
        self.words = words
        self.planes = np.random.default_rng(seed).standard_normal((64 * words, dim))
        self.names = [f"code{i}" for i in range(words)]
        coded = vectors.select(*KEY, "embedding", self._codes(F.col("embedding")).alias("codes"))
        self.table = cut(coded.select(*KEY, "embedding", *[F.col("codes")[i].alias(n) for i, n in enumerate(self.names)]))

    def _pack(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.planes.T > 0, axis=1, bitorder="little").view("<i8")

    def _codes(self, embedding):
        dim = self.planes.shape[1]

        @F.pandas_udf("array<long>")
        def run(s: pd.Series) -> pd.Series:
            if any(x is None or len(x) != dim for x in s):
                raise ValueError(f"dimension mismatch: expected {dim}")
            return pd.Series(list(self._pack(np.stack(s.to_numpy()).astype(np.float64))) if len(s) else [], index=s.index, dtype=object)

        return run(embedding)

    def topk(self, query: Sequence[float], k: int, namespace: str | None = None, collection: str | None = None, share: float = 0.02, least: int = 16) -> DataFrame:
        """The best ``k`` of the ``share`` of the vectors, and at least ``least
        * k``, whose codes are nearest."""
        own = self._pack(np.asarray([query], float))[0]
        distance = sum((F.bit_count(F.col(n).bitwiseXOR(F.lit(int(q)))) for n, q in zip(self.names, own)), F.lit(0))
        kept = self.table.where(matches(namespace, collection)).withColumn("distance", distance)
        # at most 64 * words + 1 rows
        counts = sorted((r[0], r[1]) for r in kept.groupBy("distance").count().collect())
        wanted, reach = max(least * k, int(share * sum(n for _, n in counts))), -1
        for d, n in counts:
            if wanted <= 0:
                break
            reach, wanted = d, wanted - n
        return topk(kept.where(F.col("distance") <= reach).select(*KEY, "embedding"), query, k)
