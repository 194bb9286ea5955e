"""Minimax contiguous partition of ordered atomic groups into shards.

The smallest capacity with which a greedy walk needs at most ``shards`` shards
is found by binary search, and the order is cut where the greedy walk with that
capacity cuts.  Group sizes are kept as ordered blocks in the shared folder.
The driver holds one total per block and reads the sizes of only those blocks
that a cut falls into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import plain, table

#: Groups in a block.  The driver holds 16 bytes per block, about 12 MB for
#: 5e10 groups.
BLOCK = 1 << 16
#: Blocks that the driver reads at once and that it holds, 512 KiB each.
PREFETCH, HELD_BLOCKS = 64, 256

_BLOCKS = "part int, block int, n long, total long, largest long, first long, last long, sizes binary, keys binary"


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        block, keys, sizes = 0, np.empty(0, np.int64), np.empty(0, np.int64)

        def row(k: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            names = ["part", "block", "n", "total", "largest", "first", "last", "sizes", "keys"]
            values = [part, block, len(s), int(s.sum()), int(s.max()), int(k[0]), int(k[-1]), s.tobytes(), k.tobytes()]
            kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 5 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            sizes = np.concatenate((sizes, b.column(1).to_numpy()))
            while len(keys) >= width:
                yield row(keys[:width], sizes[:width])
                block, keys, sizes = block + 1, keys[width:], sizes[width:]
        if len(keys):
            yield row(keys, sizes)

    return run


class Cutter:
    """The greedy walk over block totals.  ``fetch(blocks)`` returns the sizes
    of the blocks asked for."""

    def __init__(self, totals: np.ndarray, largest: int, fetch: Callable[[list[int]], dict[int, np.ndarray]]):
        self.ends = np.cumsum(totals)
        self.begins = self.ends - totals
        self.total = int(self.ends[-1]) if len(totals) else 0
        self.largest = largest
        self._fetch, self._seen = fetch, {}

    def _sums(self, block: int, capacity: int) -> np.ndarray:
        """Running sums within a block, read along with the blocks that the
        next cuts will fall into if the groups are small."""
        if block not in self._seen:
            marks = int(self.begins[block]) + max(1, capacity) * np.arange(1, PREFETCH)
            marks = marks[marks < self.total]
            likely = {block, *np.searchsorted(self.ends, marks, side="right").tolist()}
            for b, sizes in self._fetch([b for b in likely if b < len(self.ends) and b not in self._seen]).items():
                self._seen[b] = np.cumsum(sizes)
            while len(self._seen) > HELD_BLOCKS:
                oldest = next(iter(self._seen))
                if oldest == block:
                    self._seen[block] = self._seen.pop(block)
                else:
                    del self._seen[oldest]
        return self._seen[block]

    def cuts(self, capacity: int, at_most: int) -> list[tuple[int, int]] | None:
        """(block, groups of it before the cut) of each cut, or None if more
        than ``at_most`` shards are needed."""
        out: list[tuple[int, int]] = []
        done = 0
        while self.total - done > capacity:
            if len(out) + 1 >= at_most:
                return None
            block = int(np.searchsorted(self.ends, done + capacity, side="right"))
            sums = self._sums(block, capacity)
            inside = int(np.searchsorted(sums, done + capacity - int(self.begins[block]), side="right"))
            out.append((block, inside))
            done = int(self.begins[block]) + (int(sums[inside - 1]) if inside else 0)
        return out

    def smallest(self, shards: int) -> int:
        low = max(self.largest, -(-self.total // shards))
        high = low + self.largest
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards) is None:
                low = middle + 1
            else:
                high = middle
        return low


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, shard`` of every row: a minimax contiguous partition.

    The rows of one id are an atomic group, the ids in ascending order, rows
    without an id the last group.  A row's size is the bytes of its text, null
    or empty counting 0.  The largest shard is as small as it can be with at
    most ``shards`` shards; shards are numbered from 0 in id order and each is
    filled as far as the capacity allows, so the last ones may stay unused.
    Repeated rows each have their size and are all returned.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    safe, (i, t) = plain(docs, id_col, text_col)
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    rows = safe.select(F.col(i).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(t)), F.lit(0)).cast("long").alias("size"))
    groups = table(rows.groupBy("doc_id").agg(F.sum("size").alias("size")), "shard-groups")
    known = groups.where(F.col("doc_id").isNotNull())
    parts = max(1, -(-known.count() // block))
    ordered = known.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    blocks = table(ordered.mapInArrow(_pack(block), _BLOCKS), "shard-blocks")
    heads = blocks.select("part", "block", "total", "largest").toArrow().sort_by([("part", "ascending"), ("block", "ascending")])
    where = list(zip(heads.column("part").to_pylist(), heads.column("block").to_pylist()))
    rest = groups.where(F.col("doc_id").isNull()).agg(F.sum("size"), F.count("*")).first()
    totals, largest = heads.column("total").to_numpy(), heads.column("largest").to_numpy()
    if rest[1]:
        totals, largest = np.append(totals, rest[0]), np.append(largest, rest[0])

    def read(wanted: list[int], column: str) -> dict[int, np.ndarray]:
        stored = [b for b in wanted if b < len(where)]
        out = {b: np.array([int(rest[0])], np.int64) for b in wanted if b >= len(where)}
        if stored:
            named = {where[b]: b for b in stored}
            some = F.struct("part", "block").isin([F.struct(F.lit(p).alias("part"), F.lit(k).alias("block")) for p, k in named])
            for r in blocks.where(some).select("part", "block", column).collect():
                out[named[r[0], r[1]]] = np.frombuffer(r[2], np.int64)
        return out

    cutter = Cutter(totals.astype(np.int64), int(largest.max()) if len(largest) else 0, lambda b: read(b, "sizes"))
    cuts = cutter.cuts(cutter.smallest(shards), shards) if cutter.total else []
    # the first id of each shard but the first; a cut at a block's end is at
    # the first id of the next block
    need = sorted({b for b, _ in cuts if b < len(where)})
    keys = read(need, "keys") if need else {}
    bounds, last = [], 0
    for b, inside in cuts:
        if b < len(where):
            bounds.append(int(keys[b][inside]))
        else:
            last += 1
    # shard = number of bounds up to the id; as a sorted array in a literal
    # join-free lookup by width_bucket's generalisation
    edges = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            shard = np.searchsorted(edges.value, column.fill_null(0).to_numpy(), side="right")
            shard[column.is_null().to_numpy(zero_copy_only=False)] = len(edges.value) + last
            yield pa.RecordBatch.from_arrays([column, pa.array(shard.astype(np.int32))], names=["doc_id", "shard"])

    return safe.select(F.col(i).cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, shard int")
