"""Exact duplicates by a Golomb-coded fingerprint exchange.

Each input partition hashes its texts, sorts the hashes and sends every owner
of a hash range one Golomb-Rice coded list.  An owner decodes the lists of its
range, finds the hashes that occur more than once and answers each list with a
bitmap.  Only texts whose bit is set are shuffled, and those are compared byte
by byte, so a hash collision costs a little traffic and never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, parallelism, plain, sized_join, table

#: Bits of a fingerprint. 48 keep false suspects near one in 10,000 at 3e10 texts.
FINGERPRINT_BITS = 48
#: Fingerprints that one owner compares.
OWNER_PRINTS = 1 << 24
#: Rows of one range of the numbering.
RANGE_ROWS = 1 << 20


def rice_parameter(n: int, span: int) -> int:
    """Bits of the remainder for ``n`` sorted values within ``span``."""
    return max(0, int(np.log2(max(1.0, span / max(1, n) * 0.69))))


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Rice code of ascending non-negative values: gaps as a unary stream of
    quotients followed by a stream of ``k``-bit remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    quotient = gaps >> k
    unary = np.zeros(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    out = np.packbits(unary).tobytes()
    if k:
        rest = gaps & ((1 << k) - 1)
        bits = (rest[:, None] >> np.arange(k - 1, -1, -1)) & 1
        out += np.packbits(bits.astype(np.uint8).ravel()).tobytes()
    return len(unary).to_bytes(8, "little") + out


def golomb_decode(payload: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    length = int.from_bytes(payload[:8], "little")
    cut_at = 8 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(payload[8:cut_at], np.uint8), count=length)
    quotient = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    gaps = quotient.astype(np.int64) << k
    if k:
        bits = np.unpackbits(np.frombuffer(payload[cut_at:], np.uint8), count=n * k).reshape(n, k)
        for j in range(k):
            gaps += bits[:, j].astype(np.int64) << (k - 1 - j)
    return np.cumsum(gaps)


_LISTS = "sender int, owner int, n int, k int, payload binary"
_BITMAPS = "sender int, owner int, bitmap binary"


def _sender(owners: int, bits: int):
    span = -(-(1 << bits) // owners)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        me = context.partitionId() if context else 0
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        prints = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        edges = np.searchsorted(prints, np.arange(owners + 1, dtype=np.int64) * span)
        rows: list[tuple] = []
        for owner in range(owners):
            own = prints[edges[owner] : edges[owner + 1]] - owner * span
            if len(own):
                k = rice_parameter(len(own), span)
                rows.append((me, owner, len(own), k, golomb_encode(own, k)))
        if rows:
            kinds = [pa.int32()] * 4 + [pa.binary()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["sender", "owner", "n", "k", "payload"])

    return lists


def _answer(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    lists = [golomb_decode(r["payload"], r["n"], r["k"]) for r in rows]
    every = np.sort(np.concatenate(lists))
    twice = every[1:][every[1:] == every[:-1]]
    out = []
    for r, own in zip(rows, lists):
        at = np.searchsorted(twice, own)
        hit = (twice[np.minimum(at, len(twice) - 1)] == own) if len(twice) else np.zeros(len(own), bool)
        if hit.any():
            out.append({"sender": r["sender"], "owner": r["owner"], "bitmap": np.packbits(hit).tobytes()})
    kinds = pa.schema([("sender", pa.int32()), ("owner", pa.int32()), ("bitmap", pa.binary())])
    return pa.Table.from_pylist(out, kinds)


def _marked(span: int):
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.empty(0, np.int64)]
            for r in b.to_pylist():
                own = golomb_decode(r["payload"], r["n"], r["k"])
                hit = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]).astype(bool)
                found.append(np.unique(own[hit]) + r["owner"] * span)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["print"])

    return suspects


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Every copy but the first of each group of byte-equal texts.

    Returns ``doc_id, keep_id, copy_no``: the copy, the row that is kept (the
    smallest id of the group; a null id comes last) and the copy's number in
    id order, from 1.  A null text is no text and equals nothing; empty texts
    equal each other.  Repeated rows are copies of themselves, so
    ``keep_id = doc_id`` there.  Ids may be null or occur twice.  Other columns
    are ignored, whatever their names.  An empty table gives an empty result.
    """
    safe, (i, t) = plain(docs, id_col, text_col)
    rows = safe.select(F.col(i).cast("long").alias("doc_id"), F.col(t).alias("text")).where(F.col("text").isNotNull())
    # no owner holds more than OWNER_PRINTS, as hashes are even
    owners = max(parallelism(docs.sparkSession), -(-rows.count() // OWNER_PRINTS))
    span = -(-(1 << bits) // owners)
    fingerprint = F.shiftrightunsigned(F.xxhash64("text"), 64 - bits)
    lists = cut(rows.select(fingerprint.alias("print")).mapInArrow(_sender(owners, bits), _LISTS))
    bitmaps = lists.groupBy("owner").applyInArrow(_answer, _BITMAPS)
    suspects = cut(lists.join(bitmaps, ["sender", "owner"]).mapInArrow(_marked(span), "print long").distinct())
    own = F.xxhash64("print")
    sent = sized_join(rows.withColumn("print", fingerprint), suspects, ["print"], "left_semi", 16, (own, own))
    return _copies(table(_classes(sent), "copy-classes"), sent)


def _classes(sent: DataFrame) -> DataFrame:
    """Of the suspects ``print, text, doc_id``: each text once, compared byte
    by byte, with its number of rows and first id.  Equal texts are aggregated
    before they are exchanged, however many there are."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    return sent.groupBy("print", "text").agg(F.count("*").alias("n"), first.alias("first"))


def _copies(classes: DataFrame, sent: DataFrame) -> DataFrame:
    """The numbered copies.  A fingerprint of one text names its rows; only
    for one of several texts are they compared again."""
    texts = classes.groupBy("print").agg(F.count("*").alias("texts"))
    named = table(classes.where("n > 1").join(texts, "print").withColumn("class", F.monotonically_increasing_id()), "copy-names")
    clear, mixed = named.where("texts = 1"), named.where("texts > 1")
    rows = sized_join(sent.select("print", "doc_id"), table(clear.select("print", "class"), "copy-clear"), ["print"], "inner", 16).select("class", "doc_id")
    if not mixed.isEmpty():
        rows = rows.union(sent.join(mixed.select("print", "text", "class"), ["print", "text"]).select("class", "doc_id"))
    keep = named.select("class", F.col("first.doc_id").alias("keep_id"))
    copies = _numbered(table(rows, "copy-rows")).where("copy_no > 0")
    return copies.join(keep, "class").select("doc_id", "keep_id", "copy_no")


def _numbered(rows: DataFrame) -> DataFrame:
    """``class, doc_id, copy_no``: numbers from 0 in the order of ids, nulls
    last.  The rows are sorted in ranges of class and id, so a class that
    holds a third of all rows lies in many tasks, each of which counts on from
    those before it."""
    order = ["class", F.col("doc_id").asc_nulls_last()]
    ranges = max(parallelism(rows.sparkSession), -(-rows.count() // RANGE_ROWS))
    local = table(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_count_on, "class long, doc_id long, part int, no long"), "copy-numbers")
    # a row for each class and range
    sizes = local.groupBy("class", "part").agg((F.max("no") + 1).alias("n"))
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = table(sizes.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("class", "part", "before"), "copy-offsets")
    placed = sized_join(local, before, ["class", "part"], "left", 20)
    return placed.select("class", "doc_id", (F.col("no") + F.coalesce("before", F.lit(0))).alias("copy_no"))


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    last, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        of = b.column(0).to_numpy()
        head = np.concatenate(([True], of[1:] != of[:-1]))
        place = np.arange(len(of))
        no = place - np.maximum.accumulate(np.where(head, place, 0))
        if last == of[0]:
            no[: int(np.append(np.flatnonzero(head[1:]) + 1, len(of))[0])] += n
        last, n = of[-1], int(no[-1]) + 1
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(of), part, np.int32)), pa.array(no)], names=["class", "doc_id", "part", "no"])
