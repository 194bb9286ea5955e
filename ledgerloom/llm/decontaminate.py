"""Benchmark decontamination by a prefix-filtered set join.

An item is the set of its word n-grams (shingles); one of fewer words is a
single shingle of all its words.  A text is contaminated by an item if some
window of the text, as many words long as the item, contains at least the
share ``threshold`` of the item's shingles.

Shingles are ordered by rarity in the whole corpus.  Of an item with ``s``
shingles, of which ``need`` must be found, only the ``s - need + 1`` rarest can
be the first to be found, so only these are joined.  Candidates then have to
pass a length bound (so many shingles must fit into the text and the item's
window), a positional bound (and into what lies around the joined position)
and a count of the item's shingles there; the rest is an exact count over
every item-sized window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, plain, sized_join, table
from ._tokens import BLOCK_BYTES, blocks, grams_of

SHINGLE = 5
THRESHOLD = 0.7
#: Bytes of the bitmap that keeps shingles which are surely in no item from
#: leaving the scan.  Its size is fixed; what slips through is joined exactly.
FILTER_BYTES = 1 << 21

_HIT = "doc_id long, text_hash long, shingle string, pos int, words int"


def _shingle_text(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int, last: int) -> str:
    return " ".join(data[start[w] : end[w]].tobytes().decode("utf-8", "replace") for w in range(first, last))


def _runs(words, n: int, shorter: tuple[int, ...], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(hash, text, first word, words) of the runs of ``n`` words, and of those
    of the ``shorter`` lengths: of each text only the first of equal ones, or
    with ``whole`` only those that are a whole text."""
    yield *grams_of(words, n, False), n
    for m in shorter:
        h, text, at = grams_of(words, m, False)
        if whole:
            keep = np.diff(words.first_word)[text] == m
        else:
            keep = np.sort(np.unique(np.column_stack((text, h.view(np.int64))), axis=0, return_index=True)[1])
        yield h[keep], text[keep], at[keep], m


def _shingles(n: int, bitmap: bytes | None, shorter: tuple[int, ...]):
    """(id, text hash, shingle, word position, words of the text) of the
    shingles in the filter, or without one of all of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8) if bitmap is not None else None
        mask = np.uint64(len(bits) * 8 - 1) if bitmap is not None else None
        for b in batches:
            for block, words in blocks(b.column(2), BLOCK_BYTES):
                count = np.diff(words.first_word).astype(np.int32)
                for h, text, at, m in _runs(words, n, shorter, bits is None):
                    if bits is not None:
                        slot = h & mask
                        keep = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                        text, at = text[keep], at[keep]
                    if not len(at):
                        continue
                    row = pa.array(block.first + text)
                    shingle = pa.array([_shingle_text(block.data, words.start, words.end, i, i + m) for i in at], pa.string())
                    pos = pa.array((at - words.first_word[text]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), shingle, pos, pa.array(count[text])], names=["doc_id", "text_hash", "shingle", "pos", "words"])

    return run


def _bitmap_part(n: int, size: int, shorter: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = [np.empty(0, np.uint64)]
        for b in batches:
            for _, words in blocks(b.column(0), BLOCK_BYTES):
                slots += [h & np.uint64(size * 8 - 1) for h, *_ in _runs(words, n, shorter, True)]
        slot = np.unique(np.concatenate(slots))
        byte, bit = (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8)
        used, back = np.unique(byte, return_inverse=True)
        value = np.zeros(len(used), np.uint8)
        np.bitwise_or.at(value, back, bit)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(value.astype(np.int32))], names=["at", "bits"])

    return run


def _short_lengths(n: int):
    """The numbers of words, below ``n``, of the items that have so few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for b in batches:
            for _, words in blocks(b.column(0), BLOCK_BYTES):
                count = np.diff(words.first_word)
                found |= set(count[(count > 0) & (count < n)].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["words"])

    return run


def _filter(items: DataFrame, n: int, size: int, shorter: tuple[int, ...]) -> bytes:
    """A bitmap of the items' shingles, at most ``size`` bytes on the driver."""
    parts = items.select("text").mapInArrow(_bitmap_part(n, size, shorter), "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    got = parts.toArrow()
    out = np.zeros(size, np.uint8)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return out.tobytes()


def contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``doc_id, text_hash, item_id, found, shingles`` of every contamination.

    ``found`` is the largest number of the item's shingles in one window of
    the text that has as many words as the item, ``shingles`` their number.
    An item of fewer than ``n`` words is one shingle of all its words, which
    every text holds that has just these words in a row.  Case doesn't count.
    Items without a word, null items, null and empty texts match nothing, so
    an empty table of either gives an empty result.  Rows with equal id and
    text are one row of the result; items that share an id count each, and the
    best of them is returned.  Ids may be null.  Of equal counts any stands.
    Other columns are ignored, whatever their names.
    """
    docs, (id_col, text_col) = plain(docs, id_col, text_col)
    items, (item_col, item_text_col) = plain(items, item_col, item_text_col)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    item_rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    # at most n - 1 different numbers
    shorter = tuple(sorted(r[0] for r in item_rows.select("text").mapInArrow(_short_lengths(n), "words int").distinct().collect()))
    item_grams = item_rows.select("item_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_shingles(n, None, shorter), _HIT)
    own = Window.partitionBy("item_id", "item_hash")
    sets = cut(
        item_grams.select(F.col("doc_id").alias("item_id"), F.col("text_hash").alias("item_hash"), "shingle", "pos", F.col("words").alias("item_words"))
        .groupBy("item_id", "item_hash", "item_words", "shingle")
        .agg(F.min("pos").alias("item_pos"))
        .withColumn("shingles", F.count("*").over(own))
        .withColumn("need", F.ceil(F.col("shingles") * F.lit(threshold) - F.lit(1e-9)).cast("long"))
    )
    bitmap = _filter(item_rows, n, filter_bytes, shorter)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    names = sets.select("shingle").distinct()
    hits = table(texts.mapInArrow(_shingles(n, bitmap, shorter), _HIT).join(names, "shingle", "left_semi").distinct(), "shingle-hits")

    # rarity: in how many texts of the corpus a shingle is; unseen is rarest
    frequency = hits.select("shingle", "doc_id", "text_hash").distinct().groupBy("shingle").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("item_id", "item_hash").orderBy("df", "shingle")
    ranked = sets.join(frequency, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", F.row_number().over(by_rarity))
    prefix = cut(ranked.where(F.col("rank") <= F.col("shingles") - F.col("need") + 1))
    joined = sized_join(hits, prefix, ["shingle"], "inner", 120)
    # where a window that holds the joined shingle can have others, and how
    # many fit there, into the text and into a window
    reach = F.greatest(F.col("item_words") - n, F.lit(0))
    last = F.greatest(F.col("words") - n, F.lit(0))
    length_bound = F.least(reach, last) + 1 >= F.col("need")
    positional_bound = F.least(last, F.col("pos") + reach) - F.greatest(F.lit(0), F.col("pos") - reach) + 1 >= F.col("need")
    candidates = joined.where((F.col("item_words") < n) | (length_bound & positional_bound)).select("doc_id", "text_hash", "item_id", "item_hash", F.col("pos").alias("at"))
    key = ["doc_id", "text_hash", "item_id", "item_hash"]
    spans = candidates.groupBy(*key).agg(F.sort_array(F.collect_set("at")).alias("ats"))

    # all hits of a candidate text that are shingles of its candidate item
    same = F.col("h.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("h.text_hash") == F.col("c.text_hash"))
    pairs = hits.alias("h").join(spans.alias("c"), same).select("h.shingle", "h.pos", *[f"c.{k}" for k in key], "c.ats")
    mine = F.col("p.item_id").eqNullSafe(F.col("s.item_id")) & (F.col("p.item_hash") == F.col("s.item_hash")) & (F.col("p.shingle") == F.col("s.shingle"))
    held = pairs.alias("p").join(sets.alias("s"), mine).select(*[f"p.{k}" for k in key], "p.shingle", "p.pos", "p.ats", "s.item_words", "s.shingles", "s.need")
    # count bound: so many different ones lie within an item's length of a
    # joined prefix shingle
    near = F.exists("ats", lambda a: F.abs(F.col("pos") - a) < F.col("item_words"))
    counted = held.where(near).groupBy(*key, "item_words", "shingles", "need").agg(F.sort_array(F.collect_list(F.struct("pos", "shingle"))).alias("hits"), F.countDistinct("shingle").alias("distinct"))
    enough = counted.where(F.col("distinct") >= F.col("need"))
    found = enough.mapInArrow(_windows(n), "doc_id long, text_hash long, item_id long, found long, shingles long, need long")
    best = found.where(F.col("found") >= F.col("need")).groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct(F.col("found") / F.col("shingles"), "found", "shingles")).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", F.col("b.found").alias("found"), F.col("b.shingles").alias("shingles"))


def _windows(n: int):
    """The most distinct shingles in any window of an item's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for hits, words in zip(b.column("hits").to_pylist(), b.column("item_words").to_pylist()):
                reach = max(words - n, 0)
                best, low, inside, kinds = 0, 0, {}, 0
                for high, hit in enumerate(hits):
                    inside[hit["shingle"]] = inside.get(hit["shingle"], 0) + 1
                    kinds += inside[hit["shingle"]] == 1
                    while hit["pos"] - hits[low]["pos"] > reach:
                        gone = hits[low]["shingle"]
                        inside[gone] -= 1
                        kinds -= inside[gone] == 0
                        low += 1
                    best = max(best, kinds)
                found.append(best)
            names = ["doc_id", "text_hash", "item_id"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(found, pa.int64()), b.column("shingles"), b.column("need")], names=[*names, "found", "shingles", "need"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, that no item contaminates.

    Rows are matched by id and text, so ids may be null or occur twice.  Null
    and empty texts stay.  Without items all rows stay, and an empty table
    gives an empty result.  Extra columns pass through, whatever their names.
    """
    bad = cut(contaminated(docs, items, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_hash").distinct())
    safe, (i, t) = plain(docs, id_col, text_col)
    same = F.col(i).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col(t)) == F.col("text_hash"))
    return sized_join(safe, bad, same, "left_anti", 16, (F.xxhash64(F.col(t)), F.col("text_hash"))).toDF(*docs.columns)
