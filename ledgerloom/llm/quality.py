"""Ordinal quality classifier: cumulative-link regression on graded ratings.

A text is a bag of hashed features: windows of four byte shapes, lower-cased
words, and how each word repeats the words just before it.  One weight per
hash bucket is shared by all grades; ordered thresholds turn the score into
P(grade >= k).  The model is fitted on a bounded sample of rated rows and then
scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import plain, require
from ._tokens import Block, lowered, mix, raw_blocks, words_of

#: At most so many rated rows are used for fitting, shared between the grades.
MAX_TRAIN = 6000
BUCKETS = 1 << 16

_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_FIELDS = 3


def _buckets(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(48)).astype(np.int32)


def _fields(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each field the hash buckets and, per text and one more, where the
    text's buckets begin."""
    data, offsets = block.data, block.offsets
    if len(data):
        s = np.concatenate((_SHAPE[data], np.zeros(3, np.uint32)))
        h = s[:-3] * np.uint32(0x9E3779B1) + s[1:-2] * np.uint32(0x85EBCA77) + s[2:-1] * np.uint32(0xC2B2AE3D) + s[3:] * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        # a window belongs to the text it begins in; the three that reach over
        # its end are put into one bucket, whatever follows
        bucket = (h >> np.uint32(16)).astype(np.int32)
        for k in (1, 2, 3):
            at = offsets[1:] - k
            bucket[at[at >= 0]] = 0
        yield bucket, offsets
    else:
        yield np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
    words = words_of(Block(block.first, lowered(data), offsets))
    yield _buckets(words.hash, 1), words.first_word
    same = np.zeros(len(words.hash), np.uint64)
    for back, bit in ((1, 1), (2, 2), (3, 4)):
        if len(same) > back:
            equal = (words.hash[back:] == words.hash[:-back]) & (words.text[back:] == words.text[:-back])
            same[back:] += equal.astype(np.uint64) * np.uint64(bit)
    yield _buckets(same, 2), words.first_word


def features(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the buckets and their shares, each field summing to one."""
    out: list[list] = [[] for _ in range(block.texts)]
    for bucket, begin in _fields(block):
        for t in range(block.texts):
            own = bucket[begin[t] : begin[t + 1]]
            if len(own):
                index, count = np.unique(own, return_counts=True)
                out[t].append((index, count / len(own)))
    return [(np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])) if x else (np.empty(0, np.int32), np.empty(0)) for x in out]


def scores(block: Block, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(block.texts)
    for bucket, begin in _fields(block):
        sums = np.concatenate(([0.0], np.cumsum(weights[bucket], dtype=np.float64)))
        n = np.diff(begin)
        total += np.where(n > 0, (sums[begin[1:]] - sums[begin[:-1]]) / np.maximum(n, 1), 0.0)
    return total


@dataclass
class OrdinalModel:
    """P(grade >= grades[k + 1]) = sigmoid(score - thresholds[k])."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Probability of at least each grade but the lowest."""
        z = np.clip(score[:, None] - self.thresholds[None, :], -35, 35)
        return 1 / (1 + np.exp(-z))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)

    def tail(self, tails: np.ndarray, grade: float) -> np.ndarray:
        k = int(np.searchsorted(self.grades, grade))
        if k == 0:
            return np.ones(len(tails))
        return tails[:, k - 1] if k <= tails.shape[1] else np.zeros(len(tails))


def gradient(params: np.ndarray, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean weighted negative log-likelihood, its gradient by ``params``
    (the first threshold and the logs of the gaps) and ``len(y)`` times that
    by the scores.  ``y`` are places in the order of the grades."""
    k = len(params)
    cuts = np.concatenate(([params[0]], params[0] + np.cumsum(np.exp(params[1:]))))
    edge = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -30, 30)))  # P(y <= k)
    low = np.column_stack((np.zeros(len(y)), edge))
    high = np.column_stack((edge, np.ones(len(y))))
    row = np.arange(len(y))
    p = np.maximum(high[row, y] - low[row, y], 1e-9)
    d_high = high[row, y] * (1 - high[row, y]) / p * weight
    d_low = low[row, y] * (1 - low[row, y]) / p * weight
    d_cut = np.zeros(k)
    np.add.at(d_cut, np.minimum(y, k - 1), -d_high * (y < k))
    np.add.at(d_cut, np.maximum(y - 1, 0), d_low * (y > 0))
    d_par = np.concatenate(([d_cut.sum()], np.cumsum(d_cut[::-1])[::-1][1:] * np.exp(params[1:]))) / len(y)
    return float((-np.log(p) * weight).mean()), d_par, d_high - d_low


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = 40, rate: float = 0.5, l2: float = 1e-6, seed: int = 7) -> OrdinalModel:
    """Proportional-odds fit by minibatch Adagrad, grades weighted evenly.

    With fewer than two grades the model is constant: that grade, or grade 1
    where nothing was rated.
    """
    grades = np.unique([g for g, _, _ in rows]) if rows else np.array([1.0])
    k = len(grades) - 1
    weights = np.zeros(BUCKETS)
    if k < 1:
        return OrdinalModel(weights, np.empty(0), grades.astype(float))
    y = np.searchsorted(grades, [g for g, _, _ in rows])
    share = np.bincount(y, minlength=k + 1)
    weight = (len(y) / (k + 1) / share)[y]
    upto = np.cumsum(share / share * np.ones(k + 1) / (k + 1))[:-1]
    first, gaps = np.log(upto[0] / (1 - upto[0])), np.log(np.maximum(np.diff(np.log(upto / (1 - upto))), 1e-2))
    g_w, g_t = np.full(BUCKETS, 1e-8), np.full(k, 1e-8)
    params = np.concatenate(([first], gaps))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), 64):
            own = order[lo : lo + 64]
            size = np.array([len(rows[i][1]) for i in own])
            index = np.concatenate([rows[i][1] for i in own])
            value = np.concatenate([rows[i][2] for i in own])
            of = np.repeat(np.arange(len(own)), size)
            s = np.bincount(of, weights[index] * value, minlength=len(own))
            _, d_par, d_s = gradient(params, s, y[own], weight[own])
            grad = np.bincount(index, value * d_s[of], minlength=BUCKETS) / len(own)
            used = np.flatnonzero(grad)
            step = grad[used] + l2 * weights[used]
            g_w[used] += step * step
            weights[used] -= rate * step / np.sqrt(g_w[used])
            g_t += d_par * d_par
            params -= 0.1 * d_par / np.sqrt(g_t)
    cuts = np.concatenate(([params[0]], params[0] + np.cumsum(np.exp(params[1:]))))
    return OrdinalModel(weights, cuts, grades.astype(float))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in raw_blocks(b.column(1)):
            found = features(block)
            grade = b.column(0).slice(block.first, block.texts)
            columns = [grade, pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["grade", "index", "value"])


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_train: int = MAX_TRAIN) -> OrdinalModel:
    """Fit on at most ``max_train`` rated rows, as many of each grade as there
    are or its even share, in the order of a hash of the id.

    Ratings without an id, a grade or a text are passed over; several ratings
    of one text each count.
    """
    docs, (i, t) = plain(docs, id_col, text_col)
    ratings, (r, g) = plain(ratings, id_col, grade_col)
    rated = ratings.select(F.col(r).cast("long").alias("doc_id"), F.col(g).cast("double").alias("grade")).dropna()
    grades = [r[0] for r in rated.select("grade").distinct().collect()]
    if not grades:
        return fit([])
    sample = None
    for g in sorted(grades):
        part = rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, max_train // len(grades)))
        sample = part if sample is None else sample.unionAll(part)
    texts = docs.select(F.col(i).cast("long").alias("doc_id"), F.col(t).alias("text")).where(F.col("text").isNotNull())
    # the sample is bounded by max_train, so it may always be broadcast
    joined = texts.join(F.broadcast(sample), "doc_id").select("grade", "text")
    table = joined.mapInArrow(_featurise, "grade double, index array<int>, value array<float>").toArrow()
    rows = []
    for b in table.to_batches():
        grade, index, value = b.column(0).to_numpy(zero_copy_only=False), b.column(1), b.column(2)
        at = index.offsets.to_numpy() - index.offsets[0].as_py()
        flat_i, flat_v = index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)
        rows += [(grade[t], flat_i[at[t] : at[t + 1]], flat_v[at[t] : at[t + 1]].astype(float)) for t in range(len(grade))]
    rows.sort(key=lambda r: (r[0], len(r[1]), float(r[2] @ (r[1] % 8191))))  # not by arrival
    return fit(rows)


def _score_column(text: pa.Array, model: OrdinalModel, grade: float) -> tuple[np.ndarray, np.ndarray]:
    s = [scores(block, model.weights) for block in raw_blocks(text)]
    tails = model.tails(np.concatenate(s) if s else np.empty(0))
    return model.expected(tails), model.tail(tails, grade)


def score(docs: DataFrame, model: OrdinalModel, at_least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability`` of every row.

    ``tail_probability`` is P(grade >= at_least).  A null text counts as
    empty; an empty text has no features and gets the score of the thresholds
    alone.  Equal texts get equal results, however long.  Repeated rows are
    scored each, null ids are given as null.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    safe, (i, t) = plain(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            expected, tail = _score_column(b.column(1), shared.value, at_least)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected), pa.array(tail)], names=["doc_id", "expected_grade", "tail_probability"])

    return safe.select(F.col(i).cast("long").alias("doc_id"), F.col(t).alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def select_quality(docs: DataFrame, model: OrdinalModel, at_least: float, min_probability: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose P(grade >= at_least) reaches
    ``min_probability``.

    Nothing is joined, so ids may be null or repeated, and each of repeated
    rows stays or goes as its text does.  A null text counts as an empty one,
    which has the probability of the thresholds alone.  A probability that is
    just ``min_probability`` is enough.  Extra columns pass through, whatever
    their names; an empty table gives an empty result.
    """
    require(docs, [text_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, tail = _score_column(b.column(at), shared.value, at_least)
            yield b.filter(pa.array(tail >= min_probability))

    safe, _ = plain(docs, text_col)
    return safe.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in safe.schema.fields])).toDF(*docs.columns)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """The graded ratings of the label table: 0 low quality, 1 fair but toxic,
    2 good.  A missing toxic flag counts as not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2)
    return labels.select("doc_id", grade.alias("grade"))
