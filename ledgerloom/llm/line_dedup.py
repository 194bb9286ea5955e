"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

An index remembers how often each line has been inserted.  The counts are an
append-only table of signed changes keyed by a 128-bit line hash; beside it
every shard of the hash space has a cuckoo filter of the lines whose count is
positive.  A batch asks the filters first: a line that its filter doesn't hold
is surely new, and only the others are looked up in the counts.  Deleting
documents subtracts their lines and takes lines that nobody holds any more out
of the filters, after which they count as new again.  A ledger of the inserted
documents keeps a deletion to what was put in.

Within an input task the repeats of a line are collapsed before the exchange,
so a line that is everywhere costs one row per task.  Rows equal in id and text
are made one before that, wherever they lie, so every occurrence counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh_path, parallelism, plain, sized_join, table

SLOTS = 4
#: Lines for which a shard is laid out when an index is created.
LINES_PER_SHARD = 1 << 19
_KICKS = 400


class Cuckoo:
    """A cuckoo filter with 16-bit fingerprints in buckets of four, filled a
    whole array of keys at a time.  It grows by rehashing its kept keys, so
    ``add`` needs all keys of the shard when it is full; see ``build``."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @staticmethod
    def for_keys(n: int) -> Cuckoo:
        return Cuckoo(1 << max(3, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8))))))

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        print_ = (keys >> np.uint64(48)).astype(np.int64) % 65535 + 1
        return print_, (keys & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return (bucket ^ (print_ * 0x5BD1E995)) & (self.buckets - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        p, b = self._place(keys)
        here = (self.slots[b] == p[:, None]).any(1)
        return here | (self.slots[self._other(p, b)] == p[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """Whether all distinct ``keys`` found a place; if not, the filter is
        spoilt and has to be built anew."""
        p, b = self._place(keys)
        rng = np.random.default_rng(1)
        for turn in range(_KICKS):
            if not len(p):
                return True
            order = np.argsort(b, kind="stable")
            p, b = p[order], b[order]
            first = np.searchsorted(b, b)
            rank = np.arange(len(b)) - first
            empty = self.slots[b] == 0
            fits = rank < empty.sum(1)
            if fits.any():
                slot = np.argsort(~empty[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
                self.slots[b[fits], slot] = p[fits]
            p, b, rank = p[~fits], b[~fits], rank[~fits]
            if turn == 0:
                b = self._other(p, b)
                continue
            # the first of a full bucket takes the place of another
            kick = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.empty(0, np.int64)
            slot = rng.integers(0, SLOTS, len(kick))
            out = self.slots[b[kick], slot].astype(np.int64)
            self.slots[b[kick], slot] = p[kick]
            p[kick] = out
            b[kick] = self._other(out, b[kick])
        return not len(p)

    def remove(self, keys: np.ndarray) -> None:
        """Take out one fingerprint of each key; all must have been added."""
        p, b = self._place(keys)
        for x, i in zip(p, b):
            for bucket in (i, int(self._other(x, i))):
                at = np.flatnonzero(self.slots[bucket] == x)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    safe, (i, t) = plain(docs, id_col, text_col)
    return safe.select(F.col(i).cast("long").alias("doc_id"), F.xxhash64(F.col(t)).alias("text_hash"), F.col(t).alias("text")).where(F.col("text").isNotNull())


def _same(a: str, b: str) -> F.Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, text`` of the texts, repeated rows once.

    Only the rows that repeat are exchanged with their texts; all others stay
    in their tasks.
    """
    rows = _texts(docs, id_col, text_col)
    again = table(rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash"), "line-repeats")
    if again.isEmpty():
        return rows
    r, a = rows.alias("r"), again.alias("a")
    once = sized_join(r, a, _same("r", "a"), "left_semi", 16, (F.col("text_hash"), F.col("text_hash"))).groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"))
    return sized_join(r, a, _same("r", "a"), "left_anti", 16, (F.col("text_hash"), F.col("text_hash"))).unionByName(once)


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line that isn't blank."""
    split = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.where(F.col("line").rlike(r"\S")).select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


_AT = pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])
_COLLAPSED = "h1 long, h2 long, doc_id long, text_hash long, pos int, n long, others array<struct<doc_id: long, text_hash: long, pos: int>>"


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and line: its first occurrence, their number and the others."""
    parts = list(batches)
    if not sum(b.num_rows for b in parts):
        return
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    del parts
    null = whole.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    doc = whole.column("doc_id").fill_null(0).to_numpy()
    text, pos, h1, h2 = (whole.column(c).to_numpy() for c in ("text_hash", "pos", "h1", "h2"))
    order = np.lexsort((pos, text, doc, null, h2, h1))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (h1[a] == h1[b]) & (h2[a] == h2[b])
    head = np.flatnonzero(~same)
    n = np.diff(np.append(head, len(order)))
    rest = pa.array(order[same])
    offsets = np.concatenate(([0], np.cumsum(n - 1))).astype(np.int32)
    others = pa.StructArray.from_arrays([whole.column(c).take(rest) for c in ("doc_id", "text_hash", "pos")], fields=list(_AT))
    first = pa.array(order[head])
    columns = [whole.column(c).take(first) for c in ("h1", "h2", "doc_id", "text_hash", "pos")]
    out = pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), others)], names=["h1", "h2", "doc_id", "text_hash", "pos", "n", "others"])
    for at in range(0, out.num_rows, 1 << 16):
        yield out.slice(at, 1 << 16)


_LEDGER = "doc_id long, text_hash long, n long"
_FILTERS = "shard int, buckets long, payload binary"
_FILTER_ROW = pa.schema([("shard", pa.int32()), ("buckets", pa.int64()), ("payload", pa.binary())])


def _load(state: pa.Table) -> Cuckoo | None:
    if not state.num_rows:
        return None
    row = state.to_pylist()[0]
    return Cuckoo(row["buckets"], np.frombuffer(row["payload"], np.uint16).reshape(-1, SLOTS).copy())


def _keys(t: pa.Table) -> np.ndarray:
    return t.column("h1").to_numpy().view(np.uint64) if t.num_rows else np.empty(0, np.uint64)


def _probe(key: tuple, asked: pa.Table, state: pa.Table) -> pa.Table:
    held = _load(state)
    maybe = held.holds(_keys(asked)) if held and asked.num_rows else np.zeros(asked.num_rows, bool)
    return asked.select(["h1", "h2"]).filter(pa.array(maybe))


def _update(key: tuple, changes: pa.Table, state: pa.Table) -> pa.Table:
    """Changes: keys with ``live`` true are put in, with false taken out.  A
    filter without room is reported with no payload and built from the counts."""
    held = _load(state)
    live = changes.column("live").to_numpy(zero_copy_only=False).astype(bool) if changes.num_rows else np.empty(0, bool)
    keys = _keys(changes)
    if held is None:
        held = Cuckoo.for_keys(int(live.sum()))
    elif len(keys[~live]):
        held.remove(keys[~live])
    good = held.add(keys[live])
    shard = int(key[0].as_py() if hasattr(key[0], "as_py") else key[0])
    return pa.Table.from_pylist([{"shard": shard, "buckets": held.buckets, "payload": held.slots.tobytes() if good else None}], _FILTER_ROW)


def _build(group: pa.Table) -> pa.Table:
    shard, keys = group.column("shard")[0].as_py(), _keys(group)
    held = Cuckoo.for_keys(len(keys))
    while not held.add(keys):
        held = Cuckoo(held.buckets * 2)
    return pa.Table.from_pylist([{"shard": shard, "buckets": held.buckets, "payload": held.slots.tobytes()}], _FILTER_ROW)


class LineIndex:
    """The lines of all documents that were inserted and not deleted.

    Every change appends to ``changes`` and ``ledgers`` (Parquet tables in the
    shared folder) and writes a new set of filters, so a failed call leaves the
    index as it was.  ``shards`` is fixed when the index is created.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int, changes: tuple[str, ...] = (), filters: str | None = None, ledgers: tuple[str, ...] = ()):
        self.spark, self.path, self.shards, self.changes, self.filters, self.ledgers = spark, path, shards, changes, filters, ledgers

    @staticmethod
    def create(spark: SparkSession, expected_lines: int = 0, path: str | None = None) -> LineIndex:
        shards = max(parallelism(spark), -(-expected_lines // LINES_PER_SHARD))
        return LineIndex(spark, path or fresh_path(spark, "line-index"), shards)

    def _shard(self) -> F.Column:
        return F.pmod(F.shiftrightunsigned("h1", 20), F.lit(self.shards)).cast("int").alias("shard")

    def _filter_rows(self) -> DataFrame:
        if self.filters is None:
            return self.spark.createDataFrame([], _FILTERS)
        return self.spark.read.schema(_FILTERS).parquet(self.filters)

    def counts(self) -> DataFrame:
        """``h1, h2, n`` of every line whose count is positive: exact."""
        if not self.changes:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*self.changes)
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") > 0)

    def _held(self, asked: DataFrame) -> DataFrame:
        """Which of the materialised distinct keys ``asked`` the index holds, with their counts."""
        if not self.changes:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        keyed = asked.select(self._shard(), "h1", "h2")
        maybe = keyed.groupBy("shard").cogroup(self._filter_rows().groupBy("shard")).applyInArrow(_probe, "h1 long, h2 long")
        maybe = table(maybe, "line-maybe")
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*self.changes)
        return sized_join(rows, maybe, ["h1", "h2"], "left_semi", 16).groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") > 0)

    def documents(self) -> DataFrame:
        """``doc_id, text_hash, n``: the texts that are in, and how often they
        were put in: exact."""
        if not self.ledgers:
            return self.spark.createDataFrame([], _LEDGER)
        rows = self.spark.read.schema(_LEDGER).parquet(*self.ledgers)
        return rows.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n")).where(F.col("n") > 0)

    def _after(self, delta: DataFrame, moved: DataFrame, ledger: DataFrame) -> LineIndex:
        """The index with the signed counts ``delta`` of lines and ``ledger``
        of documents added and the keys of ``moved`` (``live``: came, else
        gone) changed in the filters."""
        step = f"{len(self.changes)}-{uuid.uuid4().hex}"
        at, to, docs = (f"{self.path}/{name}-{step}" for name in ("changes", "filters", "ledger"))
        delta.select("h1", "h2", "n").write.parquet(at)
        ledger.select("doc_id", "text_hash", F.col("n").cast("long").alias("n")).write.parquet(docs)
        after = LineIndex(self.spark, self.path, self.shards, (*self.changes, at), to, (*self.ledgers, docs))
        keyed = moved.select(self._shard(), "h1", "h2", "live")
        if self.filters is None:
            # an empty index: the filters are built at their right size
            keyed.where("live").groupBy("shard").applyInArrow(_build, _FILTERS).write.parquet(to)
            return after
        tried = table(keyed.groupBy("shard").cogroup(self._filter_rows().groupBy("shard")).applyInArrow(_update, _FILTERS), "line-filters")
        full = [r[0] for r in tried.where(F.col("payload").isNull()).select("shard").collect()]
        good = tried.where(F.col("payload").isNotNull())
        if full:  # at most one short row per shard came to the driver
            again = after.counts().select(self._shard(), "h1", "h2").where(F.col("shard").isin(full))
            good = good.unionByName(again.groupBy("shard").applyInArrow(_build, _FILTERS))
        good.write.parquet(to)
        return after

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> tuple[DataFrame, LineIndex]:
        """``docs`` without the lines that the index or an earlier row holds,
        and the index with all lines of ``docs``.  See ``dedup_lines``.  What
        is inserted again counts again."""
        order = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "pos")
        every = Window.partitionBy("h1", "h2")
        rows = _rows(docs, id_col, text_col)
        local = _lines(rows).mapInArrow(_collapse, _COLLAPSED)
        ranked = table(local.withColumn("rank", F.row_number().over(order)).withColumn("total", F.sum("n").over(every)), "line-ranks")
        keys = ranked.where(F.col("rank") == 1).select("h1", "h2", F.col("total").alias("n"))
        first = F.col("rank") == 1
        if self.changes:
            held = table(self._held(keys), "line-held").select("h1", "h2", F.lit(True).alias("held"))
            ranked = sized_join(ranked, held, ["h1", "h2"], "left", 17).withColumn("held", F.coalesce("held", F.lit(False)))
            first = first & ~F.col("held")
            moved = ranked.where(first).select("h1", "h2", F.lit(True).alias("live"))
        else:
            moved = keys.select("h1", "h2", F.lit(True).alias("live"))
        after = self._after(keys, moved, rows.select("doc_id", "text_hash", F.lit(1).alias("n")))
        me = F.array(F.struct("doc_id", "text_hash", "pos"))
        gone = ranked.where(~first | (F.size("others") > 0)).select(F.explode(F.when(first, F.col("others")).otherwise(F.concat(me, "others"))).alias("x"))
        drops = gone.select("x.*").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))
        return _without(docs, table(drops, "line-drops"), id_col, text_col, drop_emptied), after

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index without the lines of ``docs``, which hold their ids and
        texts as they were inserted.

        Rows that aren't in the index, by id (null equal to null) and text, are
        passed over, so that no other document's lines are taken.  Repeated
        rows are one document and taken out once, however often it was put in.
        Null texts are passed over; empty ones, and those of blank lines, have
        no lines.  An empty table changes nothing.
        """
        asked = _rows(docs, id_col, text_col)
        keys = table(asked.select("doc_id", "text_hash"), "line-asked")
        k, d = keys.alias("k"), self.documents().alias("d")
        unknown = table(k.join(d, _same("k", "d"), "left_anti"), "line-unknown")
        if not unknown.isEmpty():
            asked = sized_join(asked.alias("r"), unknown.alias("u"), _same("r", "u"), "left_anti", 16)
            keys = k.join(unknown.alias("u"), _same("k", "u"), "left_anti")
        lines = _lines(asked).groupBy("h1", "h2").agg(F.count("*").alias("less"))
        lines = table(lines, "line-deletes")
        held = self._held(lines)
        left = table(held.join(lines, ["h1", "h2"]).select("h1", "h2", "n", F.least("n", "less").alias("less")), "line-left")
        gone = left.where(F.col("n") == F.col("less")).select("h1", "h2", F.lit(False).alias("live"))
        return self._after(left.select("h1", "h2", (-F.col("less")).alias("n")), gone, keys.select("doc_id", "text_hash", F.lit(-1).alias("n")))


def _without(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str, drop_emptied: bool) -> DataFrame:
    """``docs`` less the lines at the places in ``drops``, a table.  Only if it
    is too large to broadcast do documents leave their tasks, and then only
    those that lose a line."""
    safe, (i, t) = plain(docs, id_col, text_col)
    held = drops.agg(F.count("*"), F.sum(F.size("drop"))).first()
    row_bytes = 16 + 4 * -(-(held[1] or 0) // max(1, held[0]))
    same = F.col(i).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col(t)) == F.col("text_hash"))
    joined = sized_join(safe, drops, same, "left", row_bytes, (F.xxhash64(F.col(t)), F.col("text_hash"))).select(*safe.columns, "drop")
    at, wide = safe.columns.index(t), len(safe.columns)
    kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in safe.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drop, columns, stay = b.column(wide), list(b.columns[:wide]), np.ones(b.num_rows, bool)
            if drop.null_count < b.num_rows:
                texts = columns[at].to_pylist()
                for k in np.flatnonzero(drop.is_valid().to_numpy(zero_copy_only=False)):
                    out = set(drop[int(k)].as_py())
                    left = [x for n, x in enumerate(texts[k].split("\n")) if n not in out]
                    stay[k] = any(x.strip(" \t\n\x0b\f\r") for x in left)
                    texts[k] = "\n".join(left) if stay[k] else ""
                columns[at] = pa.array(texts, columns[at].type)
            b = pa.RecordBatch.from_arrays(columns, names=kind.names)
            yield b.filter(pa.array(stay)) if drop_emptied and not stay.all() else b

    return joined.mapInArrow(run, kind).toDF(*docs.columns)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LineIndex | None = None, drop_emptied: bool = False) -> DataFrame:
    """Every row, with all its columns, its text without repeated lines.

    Of equal lines (byte by byte, parted by line feeds) the first in the order
    of id (nulls last), text hash and position stays, unless ``index`` holds
    it already; blank lines are no lines and stay.  A text none of whose lines
    is left becomes empty, or with ``drop_emptied`` its row goes.  Rows equal in id and text are one document and get
    the same text.  Null and empty texts stay as they are; an empty table
    gives an empty result.  Extra columns pass through, whatever their names.
    """
    index = index or LineIndex.create(docs.sparkSession, LINES_PER_SHARD)
    return index.insert(docs, id_col, text_col, drop_emptied)[0]


def dedup_lines_reversibly(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``dedup_lines`` gives, by every operation of the index: the rows up
    to the middle id are put in, then all others, which are taken out again
    and put back.  So every line is inserted, and those of the later rows are
    asked for in the filters, looked up in the counts and deleted."""
    safe, (i, t) = plain(docs, id_col, text_col)
    own = F.col(i).cast("long")
    middle = safe.agg(F.percentile_approx(own, 0.5)).first()[0]
    early = F.coalesce(own <= F.lit(middle), F.lit(False))
    first, later = safe.where(early), safe.where(~early)
    kept, index = LineIndex.create(docs.sparkSession, LINES_PER_SHARD).insert(first, i, t)
    _, both = index.insert(later, i, t)
    again, _ = both.delete(later, i, t).insert(later, i, t)
    return kept.unionByName(again).toDF(*docs.columns)
