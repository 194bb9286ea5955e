"""Vector best-fit packing of documents into training sequences.

An item is a document, or a piece of one that is longer than a sequence.  Its
demand has three parts: tokens, documents (1) and attention cost (the square
of its tokens).  A bin has a capacity for each.  Items are taken in falling
order; of the bins in which every part still fits, the one with the best score
gets the item: the largest weighted dot product of demand and residual, or the
smallest weighted norm of what would remain.

Beyond ``GROUP_ITEMS`` items, groups of that size are packed first.  Bins that
they leave part-filled are emptied again and their items packed together, in
as many rounds as it takes until one group holds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import plain, table
from ._tokens import blocks


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 32
    attention: int = 4096 * 2048

    @property
    def longest(self) -> int:
        """The longest piece that fits an empty bin."""
        return max(1, min(self.tokens, int(np.sqrt(self.attention))))


#: Items that are packed together in one task.
GROUP_ITEMS = 40_000
#: A bin that is filled to this share in no respect is part-filled.
PART_FILLED = 0.9
WEIGHTS = (1.0, 0.25, 0.5)


def best_fit(tokens: np.ndarray, capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The bin of each item; items come in falling order of tokens."""
    demand = np.column_stack((tokens, np.ones(len(tokens)), tokens.astype(float) ** 2)).astype(float)
    return best_fit_vectors(demand, capacity, rule, weights)


def best_fit_vectors(demand: np.ndarray, capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The bin of each item of demands (tokens, documents, attention), taken
    in their order.

    Ties of the score go to the oldest bin.  Bins that can't take even the
    least of every demand are set aside, which changes nothing.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    w = np.array(weights)
    out = np.empty(len(demand), np.int64)
    least = demand.min(0) if len(demand) else full
    left = np.empty((256, 3))
    names = np.empty(256, np.int64)
    live, bins = 0, 0
    for i, d in enumerate(demand):
        r = left[:live]
        ok = np.flatnonzero((r[:, 0] >= d[0]) & (r[:, 1] >= d[1]) & (r[:, 2] >= d[2]))
        if len(ok):
            if rule == "dot":
                score = -((r[ok] / full) @ (w * d / full))
            else:
                score = (((r[ok] - d) / full) ** 2) @ w
            at = int(ok[score.argmin()])
        else:
            if live == len(left):
                left, names = np.concatenate((left, left)), np.concatenate((names, names))
            at, live = live, live + 1
            left[at], names[at] = full, bins
            bins += 1
        left[at] -= d
        out[i] = names[at]
        if (left[at] < least).any():
            # keep the order, so that ties still go to the oldest
            left[at : live - 1], names[at : live - 1] = left[at + 1 : live].copy(), names[at + 1 : live].copy()
            live -= 1
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, words in blocks(b.column(1)):
            n = np.diff(words.first_word)
            own = [b.column(c).slice(block.first, block.texts) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64))], names=["doc_id", "text_hash", "tokens"])


_OUT = "bin string, slot int, doc_id long, piece int, start long, tokens long, text_hash long, open boolean"


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``bin, slot, doc_id, piece, start, tokens``: where each piece goes.

    Tokens are words.  A text longer than a bin allows is cut into pieces of
    the greatest length and a rest, ``start`` being the piece's first token.
    Every row with a token is packed whole, repeated rows each for itself;
    texts that are null, empty or without a word have nothing to pack and are
    left out.  Ids may be null or occur twice.  Items are packed in the order
    of tokens (falling), id (nulls last), text hash and piece; of more than
    ``group_items`` each group for itself, then those of the bins that were
    left part-filled, and so on while they become fewer.  Other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    safe, (i, t) = plain(docs, id_col, text_col)
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be 'norm' or 'dot'")
    if min(capacity.tokens, capacity.documents, capacity.attention) < 1:
        raise ValueError("capacities must be positive")
    longest = capacity.longest
    rows = safe.select(F.col(i).cast("long").alias("doc_id"), F.col(t).alias("text"), F.xxhash64(F.col(t)).alias("text_hash"))
    counted = rows.mapInArrow(_count, "doc_id long, text_hash long, tokens long").where(F.col("tokens") > 0)
    number = F.ceil(F.col("tokens") / F.lit(longest)).cast("int")
    pieces = counted.select("doc_id", "text_hash", "tokens", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    items = table(pieces.select("doc_id", "text_hash", "piece", start.alias("start"), F.least(F.lit(longest), F.col("tokens") - start).alias("tokens")), "pack-items")
    count, parts, turn = items.count(), [], 0
    while True:
        groups = max(1, -(-count // group_items))
        group = F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(groups)).cast("int")
        packed = items.withColumn("group", group).groupBy("group").applyInArrow(_packer(capacity, rule, weights, turn), _OUT)
        if groups > 1:
            packed = table(packed, f"pack-{turn}")
            items = packed.where("open").select("doc_id", "text_hash", "piece", "start", "tokens")
            left = items.count()
            if left <= count // 2:  # else groups are too small to fill their bins
                parts.append(packed.where("NOT open"))
                if not left:
                    break
                count, turn = left, turn + 1
                continue
        parts.append(packed)
        break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("bin", "slot", "doc_id", "piece", "start", "tokens")


def _packer(capacity: Capacity, rule: str, weights: tuple[float, float, float], turn: int):
    def pack(t: pa.Table) -> pa.Table:
        # stable sorts from the last key to the first
        t = t.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending"), ("piece", "ascending")])
        tokens = t.column("tokens").to_numpy()
        bins = best_fit(tokens, capacity, rule, weights)
        filled = [np.bincount(bins, w) / full for w, full in ((tokens, capacity.tokens), (None, capacity.documents), (tokens.astype(float) ** 2, capacity.attention))]
        part = np.max(filled, axis=0) < PART_FILLED
        order = np.argsort(bins, kind="stable")
        ordered = bins[order]
        slot = np.arange(len(bins)) - np.searchsorted(ordered, ordered)
        t = t.take(pa.array(order))
        g = t.column("group")[0].as_py()
        name = pa.array([f"{turn}-{g}-{b}" for b in ordered], pa.string())
        columns = [name, pa.array(slot.astype(np.int32)), *[t.column(c) for c in ("doc_id", "piece", "start", "tokens", "text_hash")], pa.array(part[ordered])]
        return pa.Table.from_arrays(columns, names=["bin", "slot", "doc_id", "piece", "start", "tokens", "text_hash", "open"])

    return pack
