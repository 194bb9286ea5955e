"""Repeated passages by distributed prefix doubling over word suffixes.

Suffixes are ranked by their first words: Spark sorts pairs of the rank of a
position and the rank some words on, positions with equal pairs get one new
rank, and a position whose pair is its own only is dropped.  The offset grows
until a rank stands for as many words as a passage needs.

Most positions are unique and never reach a sort: a run of ``length`` words
holds a whole window of consecutive short runs, so two equal runs select the
same least one of that window (their anchor).  Only positions around anchors
that occur at least twice are ranked, which misses no passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, parallelism, plain, sized_join, table
from ._tokens import blocks, grams_of

#: Words of a passage.
LENGTH = 50
#: Rows of one range of a sort.
RANGE_ROWS = 1 << 20
_HIGH = np.uint64(0xFFFFFFFF00000000)
_NO_ID = np.iinfo(np.int64).min


def plan(length: int) -> tuple[int, int, int, list[int]]:
    """(words of an anchor, window of runs, words of the first ranks, offsets
    of the sorts)."""
    first = -(-length // 3)
    offsets, have = [], first
    while have < length:
        offsets.append(min(have, length - have))
        have += offsets[-1]
    anchor = max(1, (length * 2) // 5)
    return anchor, length - anchor + 1, first, offsets


def _slide(v: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """best of v[i : i + width] for every whole window."""
    have, out = 1, v
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors_of(h: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the runs that are least in some window of their text."""
    if len(h) < window:
        return np.empty(0, np.int64)
    least = _slide(h, window, np.minimum).copy()
    least[text[: len(least)] != text[window - 1 :]] = 0
    # the greatest of the minima of the windows around a run is the run's own
    # value exactly if it is the least of one of them
    padded = np.concatenate((np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)))
    top = _slide(padded, window, np.maximum)
    return np.flatnonzero((top == h) & (h > 0))


_KEYED = "k1 long, k2 long, doc_id long, text_hash long, pos int"
_NAMES = ["k1", "k2", "doc_id", "text_hash", "pos"]


def _anchors(anchor: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words in blocks(b.column(2)):
                h, text, at = grams_of(words, anchor, False)
                pick = anchors_of(h, text, window)
                if len(pick):
                    row = pa.array(block.first + text[pick])
                    pos = (at[pick] - words.first_word[text[pick]]).astype(np.int32)
                    key = pa.array(h[pick].view(np.int64))
                    yield pa.RecordBatch.from_arrays([key, b.column(0).take(row), b.column(1).take(row), pa.array(pos)], names=["k1", "doc_id", "text_hash", "pos"])

    return run


def _runs(keys: int, numbered: bool):
    """Of rows sorted by their first ``keys`` columns, those that share them
    with another row; with a rank in sort order that equal rows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        # the last row is held back until it is known whether another follows
        held: pa.RecordBatch | None = None
        held_rank, held_twin, seen = 0, False, 0

        def out(b: pa.RecordBatch, keep: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
            columns = list(b.columns[keys:])
            names = b.schema.names[keys:]
            if numbered:
                columns, names = [pa.array(rank), *columns], ["rank", *names]
            return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            n = b.num_rows
            values = [b.column(i).to_numpy() for i in range(keys)]
            same = np.zeros(n, bool)
            same[1:] = np.logical_and.reduce([v[1:] == v[:-1] for v in values])
            place = seen - (held is not None) + np.arange(n)
            head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            rank = base + place[head]
            if held is not None:
                rank[head == 0] = held_rank
            twin = same.copy()
            twin[:-1] |= same[1:]
            if held is not None and held_twin:
                twin[0] = True
            seen = int(place[-1]) + 1
            if n > 1:
                yield out(b.slice(0, n - 1), twin[:-1], rank[:-1])
            held, held_rank, held_twin = b.slice(n - 1, 1), int(rank[-1]), bool(twin[-1])
        if held is not None and held_twin:
            yield out(held, np.array([True]), np.array([held_rank]))

    return run


def _positions(length: int, anchor: int, first: int, offset: int, later: list[int]):
    """The first rank pairs of all positions that could begin a passage, and
    of those that later sorts look up for them."""
    shifts = [0]
    for step in later:
        shifts = sorted({*shifts, *(s + step for s in shifts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.column(3)
            for block, words in blocks(b.column(2)):
                h, text, at = grams_of(words, first, False)
                of = np.full(len(words.hash) + 1, -1, np.int64)
                of[at] = np.arange(len(at))
                # a mark counts the anchors whose passages may begin there
                mark = np.zeros(len(words.hash) + 1, np.int64)
                own = places.slice(block.first, block.texts)
                flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.diff(own.offsets.to_numpy())
                t = np.repeat(np.arange(block.texts), size)
                p = words.first_word[t] + flat
                np.add.at(mark, np.maximum(p - (length - anchor), words.first_word[t]), 1)
                np.add.at(mark, p + 1, -1)
                begins = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                begins = begins[begins + length <= words.first_word[words.text[begins] + 1]] if len(begins) else begins
                if not len(begins):
                    continue
                every = np.unique(np.concatenate([begins + s for s in shifts]))
                # 32 bits of each rank: a position that is taken for another's
                # equal by chance still has to match it in all later sorts
                pair = (h[of[every]] & _HIGH) | (h[of[every + offset]] >> np.uint64(32))
                t = words.text[every]
                row = pa.array(block.first + t)
                pos = (every - words.first_word[t]).astype(np.int32)
                columns = [pa.array(pair.view(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array(pos)]
                yield pa.RecordBatch.from_arrays(columns, names=[_NAMES[0], *_NAMES[2:]])

    return run


def _by_doc(work: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None]):
    """Calls ``work`` with whole documents of rows sorted by document and
    position; a null id is given as the least number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] = {}
        for b in batches:
            new = {n: (c.fill_null(_NO_ID) if n == "doc_id" else c).to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns)}
            rest = {n: np.concatenate((rest[n], new[n])) for n in new} if rest else new
            last = (rest["doc_id"] == rest["doc_id"][-1:]) & (rest["text_hash"] == rest["text_hash"][-1:])
            end = int(np.flatnonzero(~last)[-1]) + 1 if len(last) and not last.all() else 0
            if end:
                done = work({n: v[:end] for n, v in rest.items()})
                rest = {n: v[end:] for n, v in rest.items()}
                if done is not None and done.num_rows:
                    yield done
        if rest and len(rest["pos"]):
            done = work(rest)
            if done is not None and done.num_rows:
                yield done

    return run


def _doc_id(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == _NO_ID)


def _number(x: dict[str, np.ndarray]) -> np.ndarray:
    new = np.ones(len(x["pos"]), np.int64)
    new[1:] = (x["doc_id"][1:] != x["doc_id"][:-1]) | (x["text_hash"][1:] != x["text_hash"][:-1])
    return np.cumsum(new)


def _pairs(offset: int):
    def work(x: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        key = (_number(x) << np.int64(32)) + x["pos"]
        # a repeated row gives every position twice, with equal ranks
        at = np.searchsorted(key, key + offset)
        ok = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == key + offset)
        columns = [pa.array(x["rank"][ok]), pa.array(x["rank"][at[ok]]), _doc_id(x["doc_id"][ok]), pa.array(x["text_hash"][ok]), pa.array(x["pos"][ok])]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return _by_doc(work)


def _spans(length: int):
    def work(x: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        number, pos = _number(x), x["pos"].astype(np.int64)
        head = np.ones(len(pos), bool)
        head[1:] = (number[1:] != number[:-1]) | (pos[1:] > pos[:-1] + length)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(pos)) - 1
        columns = [_doc_id(x["doc_id"][first]), pa.array(x["text_hash"][first]), pa.array(pos[first].astype(np.int32)), pa.array((pos[last] + length).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "start", "end"])

    return _by_doc(work)


def _by_place(df: DataFrame) -> DataFrame:
    return df.repartition(parallelism(df.sparkSession), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "pos")


def _rank(pairs: DataFrame) -> DataFrame:
    """One sort of prefix doubling over a table of rank pairs: ``rank,
    doc_id, text_hash, pos`` of the positions that are not alone."""
    keys = [c for c in ("k1", "k2") if c in pairs.columns]
    ranges = max(parallelism(pairs.sparkSession), -(-pairs.count() // RANGE_ROWS))
    ordered = pairs.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_runs(len(keys), True), "rank long, doc_id long, text_hash long, pos int")


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end``: the longest stretches of words, counted from 0
    and without ``end``, all of whose runs of ``length`` words occur more than
    once in all texts together, the same text included.

    Stretches that overlap or touch are one.  Case and what lies between words
    don't count.  Texts that are null, empty or shorter than ``length`` words
    have none.  Repeated rows repeat each other and give one row; texts that
    share an id each give theirs.  Ids may be null.  Other columns are
    ignored; an empty table gives an empty result.
    """
    safe, (i, t) = plain(docs, id_col, text_col)
    if length < 3:
        raise ValueError("a passage has at least 3 words")
    anchor, window, first, offsets = plan(length)
    rows = safe.select(F.col(i).cast("long").alias("doc_id"), F.xxhash64(F.col(t)).alias("text_hash"), F.col(t).alias("text")).where(F.col("text").isNotNull())
    found = rows.mapInArrow(_anchors(anchor, window), "k1 long, doc_id long, text_hash long, pos int")
    twins = found.repartition(parallelism(docs.sparkSession), "k1").sortWithinPartitions("k1").mapInArrow(_runs(1, False), "doc_id long, text_hash long, pos int")
    places = table(twins.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("places")), "repeat-anchors")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    held = places.agg(F.count("*"), F.sum(F.size("places"))).first()
    row_bytes = 16 + 4 * -(-(held[1] or 0) // max(1, held[0]))
    joined = sized_join(rows.alias("d"), places.alias("p"), same, "inner", row_bytes, (F.col("text_hash"), F.col("text_hash")))
    near = joined.select("d.doc_id", "d.text_hash", "d.text", "p.places")
    pairs = table(near.mapInArrow(_positions(length, anchor, first, offsets[0], offsets[1:]), _KEYED.replace("k2 long, ", "")), "repeat-pairs-0")
    discard(docs.sparkSession, places)
    for k, offset in enumerate(offsets[1:], 1):
        # each shuffle ends in a table, so that the one before can go
        ranked = table(_rank(pairs), f"repeat-ranks-{k}")
        discard(docs.sparkSession, pairs)
        pairs = table(_by_place(ranked).mapInArrow(_pairs(offset), _KEYED), f"repeat-pairs-{k}")
        discard(docs.sparkSession, ranked)
    last = table(_rank(pairs).select("doc_id", "text_hash", "pos"), "repeat-positions")
    discard(docs.sparkSession, pairs)
    spans = _by_place(last).mapInArrow(_spans(length), "doc_id long, text_hash long, start int, end int")
    return spans.select("doc_id", "start", "end").distinct()
