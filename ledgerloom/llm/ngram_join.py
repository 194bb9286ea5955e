"""Size-aware Jaccard join of word n-gram sets.

Small (light) sets are paired by the fixed-size subsets they share: two sets
of sizes r and s are similar exactly if they have a common subset of the size
that the threshold asks of r and s.  Large (heavy) sets are paired with all
others by scanning inverted lists.  Where light ends and heavy begins is
chosen by comparing the cost of both ways over all sets.

Lists are kept for the rarest grams of each set only: of those, two similar
sets share at least ``COMMON``.  Rarity comes from a count sketch over all
grams of all texts, with more counters for more text.  Grams go to the owners
of their hash range as packed, sorted lists; equal sets travel as one.

Pairs never leave an owner one by one.  A list's smallest set is its lead; all
that share enough lists with their lead hang together through it, and only
pairs that don't are summed over the owners, packed.  So a group of near
copies costs no more than its lists.  Of each part of the graph so found every
set is shipped once (a large part in pieces that meet in pairs), and there all
overlaps are counted from the whole sets of 64-bit gram hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, parallelism, plain, sized_join, table
from ._tokens import blocks, grams_of, mix

NGRAM = 5
THRESHOLD = 0.4
#: Similar sets must share so many of their rarest grams, or all they need to.
COMMON = 12
#: Bytes of text for each counter of the rarity sketch, and the most counters:
#: the driver and each task hold a byte for each.
COUNTER_BYTES, MOST_COUNTERS = 1024, 1 << 26
#: List entries of one owner of a hash range.
OWNER_ENTRIES = 4_000_000
#: Grams and sets of which all overlaps are counted together.
BLOCK_GRAMS, BLOCK_SETS = 1_000_000, 2048
#: Entries that a task packs at once, and pairs that an owner holds at once.
SEND_ENTRIES, PAIR_BUDGET = 1_000_000, 1_000_000
#: List entries that are scanned in the time in which one subset is sent to
#: where it meets its equals: 24 bytes through a shuffle and a sort.
SUBSET_COST = 32
#: Edges that one task may contract alone.
FEW_EDGES = 1_000_000

_LOW32 = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def needed(r: np.ndarray | int, s: np.ndarray | int, threshold: float) -> np.ndarray:
    """Least overlap of sets of sizes r and s with Jaccard >= threshold."""
    return np.ceil(threshold / (1 + threshold) * (np.asarray(r) + np.asarray(s)) - 1e-9).astype(np.int64)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """So many of the rarest grams hold ``COMMON`` common ones, or all."""
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    return np.minimum(size, size - least + np.minimum(COMMON, np.maximum(least, 1)))


class Sets:
    """The gram sets of the texts of a block, ascending within each."""

    def __init__(self, block, words, n: int):
        h, text, _ = grams_of(words, n)
        edges = np.searchsorted(text, np.arange(block.texts + 1)).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                h[a:b].sort()
        if len(h):
            keep = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
            if not keep.all():
                h, text = h[keep], text[keep]
        self.first, self.texts = block.first, block.texts
        self.gram, self.text = h, text
        self.size = np.bincount(text, minlength=block.texts).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        # of each set a 128-bit fingerprint; equal sets have equal ones
        self.id = self._sum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        self.check = self._sum(mix(h + np.uint64(0x1234567)))

    def _sum(self, value: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        return mix(total[self.begin[1:]] - total[self.begin[:-1]] + self.size.astype(np.uint64)).view(np.int64)


def _sets(column: pa.Array, n: int) -> Iterator[Sets]:
    for block, words in blocks(column):
        yield Sets(block, words, n)


_SCAN = "kind int, doc_id long, row long, set_id long, set_check long, size int, payload binary"
_ROW, _SMALL, _COUNTS = 0, 1, 2
_CHUNK = 1 << 14


def _survey(n: int, counters: int, light: int):
    """Per text its set's id and size, sets of up to ``light`` grams in full,
    and per task the counts of the sketch."""
    chunk = min(_CHUNK, counters)

    def rows(kind, doc, row, set_id, check, size, payload) -> pa.RecordBatch:
        m = len(set_id)
        columns = [pa.array(np.full(m, kind, np.int32)), doc, row, pa.array(set_id), pa.array(check), pa.array(size.astype(np.int32)), payload]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "doc_id", "row", "set_id", "set_check", "size", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts = np.zeros(counters, np.uint32)
        for b in batches:
            for s in _sets(b.column(1), n):
                np.add.at(counts, (s.gram & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
                some = np.flatnonzero(s.size > 0)
                at = pa.array(s.first + some)
                yield rows(_ROW, b.column(0).take(at), b.column(2).take(at), s.id[some], s.check[some], s.size[some], pa.nulls(len(some), pa.binary()))
                small = np.flatnonzero((s.size > 0) & (s.size <= light))
                if len(small):
                    payload = pa.array([s.gram[s.begin[i] : s.begin[i + 1]].tobytes() for i in small], pa.binary())
                    none = pa.nulls(len(small), pa.int64())
                    yield rows(_SMALL, none, none, s.id[small], s.check[small], s.size[small], payload)
        pack = zstandard.ZstdCompressor(level=1)
        for lo in range(0, counters // chunk, 256):
            chunks = [c for c in range(lo, min(lo + 256, counters // chunk)) if counts[c * chunk : (c + 1) * chunk].any()]
            if chunks:
                payload = pa.array([pack.compress(_planes(counts[c * chunk : (c + 1) * chunk], 4)) for c in chunks], pa.binary())
                zero = np.zeros(len(chunks), np.int64)
                none = pa.nulls(len(chunks), pa.int64())
                yield rows(_COUNTS, none, none, zero, zero, np.array(chunks), payload)

    return run


def _scale(counts: np.ndarray) -> np.ndarray:
    """Counts as quarters of their power of two, a byte for each."""
    return np.round(np.log2(counts.astype(float) + 1) * 4).astype(np.uint8)


def _unscale(scaled: np.ndarray) -> np.ndarray:
    return np.exp2(scaled / 4) - 1


def _sketch(surveyed: DataFrame, counters: int) -> np.ndarray:
    """The scaled counts of the sketch, a byte for each counter."""
    chunk = min(_CHUNK, counters)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, total, at = zstandard.ZstdDecompressor(), np.zeros(chunk, np.uint64), 0
        for b in batches:
            at = b.column(0)[0].as_py()
            for p in b.column(1):
                total += _unplanes(unpack.decompress(p.as_buffer(), max_output_size=chunk * 4), chunk, 4)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_scale(total).tobytes()], pa.binary())], names=["size", "payload"])

    out = np.zeros(counters, np.uint8)
    got = surveyed.where(F.col("kind") == _COUNTS).select("size", "payload").groupBy("size").applyInArrow(add, "size int, payload binary").toArrow()
    for c, p in zip(got.column("size").to_pylist(), got.column("payload")):
        out[c * chunk : (c + 1) * chunk] = np.frombuffer(p.as_buffer(), np.uint8)
    return out


def _usual(scaled: np.ndarray) -> float:
    return max(1.0, float(_unscale(np.median(scaled))))


def _levels(scaled: np.ndarray) -> np.ndarray:
    """How far above the usual a counter is, as a power of two."""
    return np.clip(np.floor(np.log2(np.maximum(_unscale(scaled), 1) / _usual(scaled)) + 0.5), 0, 250).astype(np.uint8)


def counters_for(text_bytes: int) -> int:
    """A power of two that grows with the text."""
    return 1 << int(np.clip(int(text_bytes / COUNTER_BYTES).bit_length(), 12, MOST_COUNTERS.bit_length() - 1))


def subset_keys(size: int, upto: int, threshold: float) -> dict[tuple[int, int], int]:
    """For a light set: (smaller size, larger size) -> size of the subsets it
    has to enumerate for partners of the other size."""
    out = {}
    for other in range(max(1, int(np.ceil(threshold * size - 1e-9))), min(upto, int(size / threshold + 1e-9)) + 1):
        c = int(needed(size, other, threshold))
        if c <= min(size, other):
            out[min(size, other), max(size, other)] = c
    return out


def _subsets(size: int, upto: int, threshold: float) -> int:
    return sum(comb(size, c) for c in subset_keys(size, upto, threshold).values())


def light_limit(texts: int, threshold: float) -> int:
    """Beyond this size the subsets of a set cost more than all its lists could
    if every text were in each of them, so it is never light."""
    size = 1
    while SUBSET_COST * _subsets(size, size, threshold) <= int(prefix_length(np.array(size), threshold)) * max(1, texts):
        size += 1
    return size - 1


def boundary(sets_of_size: dict[int, int], scanned: dict[int, float], threshold: float) -> int:
    """The size up to which enumeration is cheaper than scanning, in all.

    ``scanned`` has for each size the list entries that its sets would read.
    """
    best, upto = float(sum(scanned.values())), 0
    for x in range(1, max(sets_of_size, default=0) + 1):
        enumerated = SUBSET_COST * sum(n * _subsets(s, x, threshold) for s, n in sets_of_size.items() if s <= x)
        cost = enumerated + sum(v for s, v in scanned.items() if s > x)
        if cost <= best:
            best, upto = cost, x
    return upto


def _light(upto: int, threshold: float):
    plans = {s: subset_keys(s, upto, threshold) for s in range(1, upto + 1)}
    step = 1 << 16

    def picks(size: int, c: int) -> Iterator[np.ndarray]:
        every = combinations(range(size), c)
        while part := list(islice(every, step)):
            yield np.array(part, np.int64)

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["key", "key2", "set_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for set_id, size, payload in zip(b.column("set_id").to_pylist(), b.column("size").to_pylist(), b.column("payload").to_pylist()):
                gram = np.frombuffer(payload, np.uint64)
                for (r, s), c in plans[size].items():
                    salt = np.uint64(r * 100_000 + s)
                    for at in picks(size, c):
                        chosen = gram[at]
                        key = mix(mix(chosen).sum(1, dtype=np.uint64) + salt)
                        check = mix(mix(chosen ^ np.uint64(0xC3C3C3C3)).sum(1, dtype=np.uint64) + salt)
                        held.append((key.view(np.int64), check.view(np.int64), np.full(len(key), set_id, np.int64)))
                        if sum(len(k) for k, *_ in held[-256:]) >= step or len(held) >= 256:
                            yield out(held)
                            held = []
        if held:
            yield out(held)

    return run


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers with all first bytes first, then all second."""
    whole = 4 if width <= 4 else 8
    return np.ascontiguousarray(values.astype(f"<u{whole}").view(np.uint8).reshape(-1, whole)[:, :width].T).tobytes()


def _unplanes(payload: bytes, n: int, width: int) -> np.ndarray:
    """As uint32 if that is wide enough, else as uint64."""
    whole = 4 if width <= 4 else 8
    out = np.zeros((n, whole), np.uint8)
    out[:, :width] = np.frombuffer(payload, np.uint8, count=n * width).reshape(width, n).T
    return out.view(f"<u{whole}").ravel()


def encode_list(gram: np.ndarray, index: np.ndarray) -> bytes:
    """Ascending uint32 values with their set numbers, compressed."""
    import zstandard

    gaps = np.diff(gram, prepend=np.uint32(0))
    width = max(1, (int(index.max(initial=0)).bit_length() + 7) // 8)
    body = _planes(gaps, 4) + _planes(index, width)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(body)


def decode_list(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    width = payload[0]
    body = memoryview(zstandard.ZstdDecompressor().decompress(payload[1:], max_output_size=n * (4 + width)))
    return np.cumsum(_unplanes(body, n, 4), dtype=np.uint32), _unplanes(body[4 * n :], n, width)


def _codes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two 32-bit numbers as one, that sorts by the first."""
    code = high.astype(np.uint64)
    code <<= _32
    code |= low.astype(np.uint64)
    return code


_LISTS = "owner int, n int, payload binary, set_ids binary, sizes binary"


def _packed(owner: np.ndarray, low: np.ndarray, index: np.ndarray, ids: np.ndarray, sizes: np.ndarray, owners: int) -> Iterator[pa.RecordBatch]:
    """A row per owner of the entries (uint32 value, number of the set)."""
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(owners + 1))
    out = []
    for o in range(owners):
        a, b = edges[o], edges[o + 1]
        if b > a:
            code = _codes(low[order[a:b]], index[order[a:b]])
            code.sort()
            used, number = np.unique(code.astype(np.uint32), return_inverse=True)
            out.append((o, int(b - a), encode_list((code >> _32).astype(np.uint32), number), ids[used].tobytes(), sizes[used].astype(np.int32).tobytes()))
    if out:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=["owner", "n", "payload", "set_ids", "sizes"])


def _once(code: np.ndarray) -> np.ndarray:
    """Sorted, in place, and without repeats."""
    code.sort()
    keep = np.ones(len(code), bool)
    np.not_equal(code[1:], code[:-1], out=keep[1:])
    return code if keep.all() else code[keep]


def _unpack(tables: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The entries, and the ids, ascending, and sizes of their sets.

    An entry is a list's value and the place of its set's id, as one code.
    They are sorted, each once, and apart by how many grams of the same set
    came with that value before: so grams of one value still count each.
    All entries of an owner are here at once, so they are held as narrow as
    can be and never twice.
    """
    parts, names, widths = [], [], []
    for t in tables:
        for n, payload, set_ids, set_sizes in zip(*(t.column(c) for c in ("n", "payload", "set_ids", "sizes"))):
            parts.append(decode_list(payload.as_py(), n.as_py()))
            names.append(np.frombuffer(set_ids.as_buffer(), np.int64).copy())
            widths.append(np.frombuffer(set_sizes.as_buffer(), np.int32).copy())
    ids = np.unique(np.concatenate(names)) if names else np.empty(0, np.int64)
    sizes = np.zeros(len(ids), np.int32)
    first, end = np.empty(sum(len(low) for low, _ in parts), np.uint64), 0
    more: list[list[np.ndarray]] = []
    for k in range(len(parts)):
        (low, index), parts[k] = parts[k], None
        place = np.searchsorted(ids, names[k]).astype(np.uint32)
        sizes[place] = widths[k]
        code = _codes(low, place[index])
        same = np.concatenate(([False], (low[1:] == low[:-1]) & (index[1:] == index[:-1])))
        if same.any():
            at = np.arange(len(code))
            before = at - np.maximum.accumulate(np.where(same, 0, at))
            more += [[] for _ in range(int(before.max()) - len(more))]
            for x in range(1, int(before.max()) + 1):
                more[x - 1].append(code[before == x])
            code = code[before == 0]
        first[end : end + len(code)] = code
        end += len(code)
    return [_once(first[:end]), *(_once(np.concatenate(x)) for x in more)], ids, sizes


def _joint(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(list, place of the set) of the lists with more than one entry."""
    lists, own = [], []
    for k, code in enumerate(codes):
        value = (code >> _32).astype(np.uint32)
        same = value[1:] == value[:-1]
        keep = np.zeros(len(code), bool)
        keep[1:] = same
        keep[:-1] |= same
        lists.append(value[keep] + (np.uint64(k) << _32))
        own.append(code[keep].astype(np.uint32))
    return np.concatenate(lists), np.concatenate(own)


def _prefixes(n: int, owners: int, threshold: float, levels, per_send: int):
    """The rarest grams of every set, packed for their owners."""

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        # a task's memory peaks here, so nothing is kept wider or longer than needed
        gram, text, ids, sizes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        owner = ((gram >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)
        low = (mix(gram) & _LOW32).astype(np.uint32)
        del gram
        return _packed(owner, low, text, ids, sizes, owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        mask = np.uint64(len(level) - 1)
        held: list[tuple] = []
        entries = texts = 0
        for b in batches:
            for s in _sets(b.column(0), n):
                # by level within a text; most are of level 0 and in order
                rank = np.argsort(s.text * 256 + level[(s.gram & mask).astype(np.int64)], kind="stable")
                place = np.arange(len(rank)) - s.begin[s.text]
                keep = place < prefix_length(s.size, threshold)[s.text]
                # of equal sets within a task one is enough
                leads = np.zeros(s.texts, bool)
                leads[np.unique(np.column_stack((s.id, s.check)), axis=0, return_index=True)[1]] = True
                keep &= leads[s.text]
                held.append((s.gram[rank[keep]], (s.text[keep] + texts).astype(np.int32), s.id, s.size.astype(np.int32)))
                entries, texts = entries + int(keep.sum()), texts + s.texts
                if entries >= per_send:
                    yield from send(held)
                    entries = texts = 0
        if entries:
            yield from send(held)

    return run


def _heads(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, np.int64)


def _gather(owners: int, per_owner: int):
    """Keeps the lists with more than one entry and sends each on to the owner
    of its lead.  The lists of a lead that has too many for one owner are
    spread over several."""

    def run(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, sizes = _unpack(tables)
        lists, own = _joint(codes)
        del codes
        if not len(lists):
            return
        head = _heads(lists)
        lead = np.repeat(own[head], np.diff(np.append(head, len(lists))))
        # a list's value is unique only within its first owner
        mixed = (mix(mix(lists) + np.uint64(int(key[0].as_py()))) & _LOW32).astype(np.uint32)
        spread = (np.bincount(lead, minlength=len(ids)) * owners // per_owner + 1).astype(np.uint64)
        to = (mix(ids.view(np.uint64)[lead] + mixed % spread[lead]) % np.uint64(owners)).astype(np.int32)
        del lists, lead
        yield from _packed(to, mixed, own, ids, sizes, owners)

    return run


_FOUND = "bucket int, n int, payload binary, ids binary"
_FOUND_NAMES = ["bucket", "n", "payload", "ids"]


def _pack_pairs(a: np.ndarray, b: np.ndarray, common: np.ndarray, need: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs and how many grams they share, a row per bucket of their first."""
    import zstandard

    bucket = (mix(a.view(np.uint64).copy()) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    out = []
    for lo, hi in zip(h := _heads(bucket), np.append(h[1:], len(bucket))):
        at = order[lo:hi]
        ids, number = np.unique(np.concatenate((a[at], b[at])), return_inverse=True)
        code = number[: len(at)].astype(np.uint64) * np.uint64(len(ids)) + number[len(at) :].astype(np.uint64)
        by = np.argsort(code)
        body = _planes(np.diff(code[by], prepend=np.uint64(0)), 8) + common[at][by].astype(np.uint8).tobytes() + need[at][by].astype(np.uint8).tobytes()
        out.append((int(bucket[lo]), len(at), zstandard.ZstdCompressor(level=1).compress(body), ids.tobytes()))
    if out:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=_FOUND_NAMES)


def _unpack_pairs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    import zstandard

    for n, payload, ids in zip(b.column("n").to_pylist(), b.column("payload"), b.column("ids")):
        names = np.frombuffer(ids.as_buffer(), np.int64)
        body = zstandard.ZstdDecompressor().decompress(payload.as_buffer(), max_output_size=n * 10)
        code = np.cumsum(_unplanes(body[: 8 * n], n, 8), dtype=np.uint64)
        counts = np.frombuffer(body, np.uint8, offset=8 * n).reshape(2, n)
        yield names[(code // np.uint64(len(names))).astype(np.int64)], names[(code % np.uint64(len(names))).astype(np.int64)], counts[0].astype(np.int64), counts[1].astype(np.int64)


def _sum_pairs(a: np.ndarray, b: np.ndarray, common: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[new], b[new], np.add.reduceat(common[order], new), need[order][new]


def scan_lists(lists: np.ndarray, own: np.ndarray, ids: np.ndarray, sizes: np.ndarray, threshold: float, upto: int = 0, budget: int = PAIR_BUDGET) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    """What lists sorted by list and set show of their pairs.

    Yields (True, (a, b)) of pairs that share enough lists, and (False, (a, b,
    common, needed)) with a part of what other pairs share.  Pairs both of
    which share enough with their lead are left out, as they hang together by
    it, and so are those of two light sets and of sizes too far apart.  In the
    lists a set is the place of its id and size, and none is alone.
    """
    head = _heads(lists)
    length = np.diff(np.append(head, len(lists)))
    of = np.repeat(np.arange(len(head), dtype=np.int32), length)
    lead = own[head][of]

    def far(r: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.minimum(r, s) < threshold * np.maximum(r, s) - 1e-9

    def enough(r: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.minimum(needed(r, s, threshold), COMMON)

    code, back, shared = np.unique(_codes(lead, own), return_inverse=True, return_counts=True)
    a, b = (code >> _32).astype(np.uint32), code.astype(np.uint32)
    tied = (shared >= enough(sizes[a], sizes[b])) & ~far(sizes[a], sizes[b]) & (a != b)
    if tied.any():
        yield True, (ids[a[tied]], ids[b[tied]])
    loose = ~tied[back] & (own != lead)
    del lead, code, back, shared, a, b, tied
    # in each list the loose come first: each pairs with all that follow
    order = np.argsort(of * 2 + ~loose, kind="stable")
    own, of, loose = own[order], of[order], loose[order]
    size = sizes[own]
    del order
    x = np.flatnonzero(loose)
    count = (head + length)[of[x]] - x - 1
    ends = np.cumsum(count)
    low = 0
    while low < len(x):
        base = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + budget, side="right")))
        c = count[low:high]
        i = np.repeat(x[low:high], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        keep = ~far(size[i], size[j])
        if upto:
            keep &= np.maximum(size[i], size[j]) > upto
        i, j = i[keep], j[keep]
        if len(i):
            i, j = own[i], own[j]
            code, common = np.unique(_codes(np.minimum(i, j), np.maximum(i, j)), return_counts=True)
            i, j = (code >> _32).astype(np.uint32), code.astype(np.uint32)
            yield False, (ids[i], ids[j], common, enough(sizes[i], sizes[j]))
        low = high


def _owner(threshold: float, upto: int, buckets: int):
    """Edges (bucket -1) and packed pairs of the lists of one owner."""

    def run(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, sizes = _unpack(tables)
        lists, own = _joint(codes)
        del codes
        edges = [np.empty((0, 2), np.int64)]
        for sure, found in scan_lists(lists, own, ids, sizes, threshold, upto):
            if sure:
                edges.append(np.column_stack(found))
                continue
            a, b, common, need = found
            met = common >= need
            edges.append(np.column_stack((a[met], b[met])))
            if not met.all():
                yield from _pack_pairs(a[~met], b[~met], common[~met], need[~met], buckets)
        stars = _stars(np.concatenate(edges))
        if len(stars):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([len(stars)], pa.int32()), pa.array([b""], pa.binary()), pa.array([stars.tobytes()], pa.binary())], names=_FOUND_NAMES)

    return run


def _enough(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a bucket that share enough in all lists together."""
    parts = [p for b in batches for p in _unpack_pairs(b)]
    a, b, common, need = _sum_pairs(*(np.concatenate(x) for x in zip(*parts)))
    stars = _stars(np.column_stack((a, b))[common >= need])
    yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["a", "b"])


def _edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids in b.column("ids"):
            stars = np.frombuffer(ids.as_buffer(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["a", "b"])


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node each is connected to."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _stars(edges: np.ndarray) -> np.ndarray:
    """Edges that connect the same nodes, each part by its smallest node."""
    if not len(edges):
        return np.empty((0, 2), np.int64)
    nodes, root = _union(edges[:, 0], edges[:, 1])
    leaf = nodes != root
    stars = np.column_stack((root[leaf], nodes[leaf]))
    return stars[np.lexsort((stars[:, 1], stars[:, 0]))]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars, and in ``loose`` whether they were
    anything else before."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    edges = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0)
    stars = _stars(edges)
    loose = len(stars) != len(edges) or bool((stars != edges).any())
    yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1]), pa.array(np.full(len(stars), loose))], names=["a", "b", "loose"])


_EDGES = "a long, b long, loose boolean"


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``node, component`` (its smallest node) of every node of the edges
    ``a, b``.  Loops, repeated edges and no edges at all are allowed; a null
    end is not.

    Each task turns its edges into stars, which leaves at most one edge per
    node of the task whatever the number of edges.  Then the stars meet by
    node and are contracted again, until none changes.  Once there are no more
    than ``few`` of them, one task does the rest.
    """
    spark = edges.sparkSession
    now, settled = table(edges.select("a", "b").mapInArrow(_contract, _EDGES), "stars"), False
    while not settled:
        before = now
        if now.count() <= few:
            now, settled = table(now.select("a", "b").repartition(1).mapInArrow(_contract, _EDGES), "stars"), True
        else:
            met = now.select("a", "b", F.col("a").alias("at")).union(now.select("a", "b", F.col("b").alias("at")))
            now = table(met.repartition(parallelism(spark), "at").select("a", "b").mapInArrow(_contract, _EDGES), "stars")
            settled = now.where("loose").isEmpty()
        discard(spark, before)
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("component")).distinct()
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return leaves.union(roots)


def _whole(n: int):
    """The whole sets of the texts that stand for a class."""
    names = ["node", "n", "component", "large", "at", "piece", "pieces", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, checks = b.column("set_id").to_numpy(), b.column("set_check").to_numpy()
            for s in _sets(b.column("text"), n):
                at = s.first + np.arange(s.texts)
                mine = np.flatnonzero((ids[at] == s.id) & (checks[at] == s.check) & (s.size > 0))
                if len(mine):
                    row = pa.array(s.first + mine)
                    grams = pa.array([s.gram[s.begin[i] : s.begin[i + 1]].tobytes() for i in mine], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in names[:-1]), grams], names=names)

    return run


def overlaps(grams: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """How many grams each two of the sets share; with ``split``, each of the
    first ``split`` with each of the others."""
    m = len(grams)
    size = np.array([len(g) for g in grams])
    if m == 2:
        both = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        return np.array([[both]]) if split else np.array([[size[0], both], [both, size[1]]])
    to = split or m  # the rows of the result, and from here its columns
    at = split or 0
    of = np.repeat(np.arange(m), size)
    _, number, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[number]
    of, number, count = of[keep], (np.cumsum(shared) - 1)[number[keep]], count[shared]
    order = np.argsort(number, kind="stable")
    of, number = of[order], number[order]
    out = np.zeros((to, m - at), np.int32)
    if float(m) * m * len(count) > 200 * float((count.astype(float) ** 2).sum()):
        # a gram is in few of the sets: by the pairs of its list
        follow = np.repeat(np.cumsum(count), count) - np.arange(len(of)) - 1
        ends, low = np.cumsum(follow), 0
        while low < len(of):
            base = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + PAIR_BUDGET, side="right")))
            c = follow[low:high]
            x = np.repeat(np.arange(low, high), c)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
            x, y = of[x], of[y]
            if split is not None:
                across = (x < split) & (y >= split)
                x, y = x[across], y[across] - split
            np.add.at(out.reshape(-1), x * (m - at) + y, 1)
            low = high
        if split is None:
            out += out.T.copy()
    else:
        for lo in range(0, len(count), 2048):
            a, b = np.searchsorted(number, (lo, lo + 2048))
            held = np.zeros((m, min(2048, len(count) - lo)), np.float32)
            held[of[a:b], number[a:b] - lo] = 1
            for k in range(0, to, 1024):
                out[k : min(k + 1024, to)] += (held[k : min(k + 1024, to)] @ held[at:].T).astype(np.int32)
    if split is None:
        np.fill_diagonal(out, size)
    return out


_LINKS = "final boolean, node long, root long, links long"
_PAIRS = "a long, b long, jaccard double"


def _verify(threshold: float, pairs: bool):
    """Exact Jaccard of all pairs of sets of the parts in one block, or of two
    pieces of one part."""

    def batch(*columns) -> pa.RecordBatch:
        names = ["a", "b", "jaccard"] if pairs else ["final", "node", "root", "links"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, _, x, y = (k.as_py() for k in key)
        whole = pa.Table.from_batches(list(batches))
        node, copies, part, piece = (whole.column(c).to_numpy() for c in ("node", "n", "component", "piece"))
        grams = whole.column("grams")
        _, once = np.unique(node, return_index=True)  # a text may be there twice
        order = once[np.lexsort((piece[once], part[once]))]
        for lo, hi in zip(h := _heads(part[order]), np.append(h[1:], len(order))):
            mine = order[lo:hi]
            if len(mine) < 2:
                continue
            held = [np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in mine]
            split = int((piece[mine] == x).sum()) if large and x != y else None
            if split in (0, len(mine)):
                continue
            common = overlaps(held, split)
            size = np.array([len(g) for g in held])
            left, right = (slice(None), slice(None)) if split is None else (slice(None, split), slice(split, None))
            names, weight = node[mine], copies[mine]
            first, second = names[left], names[right]
            links = np.zeros(len(mine), np.int64)
            stars = np.empty((0, 2), np.int64)
            step = max(1, PAIR_BUDGET // len(second))
            for lo in range(0, len(first), step):  # all pairs at once would take many times the sets
                some = slice(lo, lo + step)
                jaccard = common[some] / (size[left][some, None] + size[right][None, :] - common[some])
                near = jaccard >= threshold - 1e-12
                if split is None:
                    near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                a, b = first[some][i], second[j]
                if pairs:
                    ahead = a < b if split is None else np.ones(len(i), bool)
                    yield batch(np.minimum(a, b)[ahead], np.maximum(a, b)[ahead], jaccard[i, j][ahead])
                    continue
                links[left][some] += near @ weight[right]
                if split is not None:
                    links[right] += weight[left][some] @ near
                stars = _stars(np.concatenate((stars, np.column_stack((a, b)))))
            if len(stars):
                nodes, root = _union(stars[:, 0], stars[:, 1])
                place = np.searchsorted(nodes, names)
                found = np.flatnonzero(nodes[np.minimum(place, len(nodes) - 1)] == names)
                yield batch(np.full(len(found), not large), names[found], root[place[found]], links[found])

    return run


def _classes_of_equals(surveyed: DataFrame) -> DataFrame:
    """A row per class of equal sets, by the 128 bits of their fingerprint:
    its number ``node``, size, rows, smallest id and a row of it."""
    rows = surveyed.where(F.col("kind") == _ROW)
    made = rows.groupBy("set_id", "set_check").agg(F.first("size").alias("size"), F.count("*").alias("n"), F.min("row").alias("row"), F.min("doc_id").alias("least"))
    return table(made.withColumn("node", F.monotonically_increasing_id()), "join-classes")


def _candidates(rows: DataFrame, surveyed: DataFrame, scaled: np.ndarray, light: int, n: int, threshold: float) -> DataFrame:
    """Edges ``a, b`` (set ids) that connect all sets that may be similar.  Sets
    of up to ``light`` grams were surveyed in full."""
    spark = rows.sparkSession
    counters, usual = len(scaled), _usual(scaled)
    shared = spark.sparkContext.broadcast(scaled)
    small = table(surveyed.where(F.col("kind") == _SMALL).groupBy("set_id", "set_check").agg(F.first("size").alias("size"), F.first("payload").alias("payload")), "join-small")

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy()
            scan = []
            for s, p in zip(size, b.column("payload")):
                # what a counter has beyond the usual and its chance variation
                other = _unscale(shared.value[(np.frombuffer(p.as_buffer(), np.uint64) & np.uint64(counters - 1)).astype(np.int64)]) - usual - 3 * usual**0.5
                scan.append(float(np.sort(np.maximum(other, 1.0))[: int(prefix_length(np.array(s), threshold))].sum()))
            yield pa.RecordBatch.from_arrays([b.column("size"), pa.array(scan, pa.float64())], names=["size", "scan"])

    by_size = small.select("size", "payload").mapInArrow(cost, "size int, scan double").groupBy("size").agg(F.count("*"), F.sum("scan")).collect()
    upto = min(light, boundary({r[0]: r[1] for r in by_size}, {r[0]: r[2] for r in by_size}, threshold))
    levels = spark.sparkContext.broadcast(_levels(scaled))

    total = surveyed.where(F.col("kind") == _ROW).agg(F.sum("size")).first()[0] or 0
    owners = int(max(1, -(-total // OWNER_ENTRIES)))
    lists = rows.select("text").mapInArrow(_prefixes(n, owners, threshold, levels, SEND_ENTRIES), _LISTS)
    gathered = lists.groupBy("owner").applyInArrow(_gather(owners, OWNER_ENTRIES), _LISTS)
    found = table(gathered.groupBy("owner").applyInArrow(_owner(threshold, upto, owners), _FOUND), "join-found")
    edges = found.where(F.col("bucket") < 0).mapInArrow(_edges_of, "a long, b long")
    edges = edges.union(found.where(F.col("bucket") >= 0).groupBy("bucket").applyInArrow(_enough, "a long, b long"))
    if upto:
        # sets with a common subset hang together by the smallest of them
        subsets = small.where(F.col("size") <= upto).select("set_id", "size", "payload").mapInArrow(_light(upto, threshold), "key long, key2 long, set_id long")
        subsets = table(subsets, "join-subsets")
        least = subsets.groupBy("key", "key2").agg(F.min("set_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "key2", "a")
        edges = edges.union(subsets.join(least, ["key", "key2"]).where(F.col("a") != F.col("set_id")).select("a", F.col("set_id").alias("b")).distinct())
    edges = table(edges, "join-edges")
    discard(spark, small, found)
    return edges


def _verified(rows: DataFrame, classes: DataFrame, edges: DataFrame, n: int, threshold: float, pairs: bool) -> DataFrame:
    """All similar pairs among sets that hang together by ``edges``: links and
    stars of them, or the pairs themselves."""
    spark = rows.sparkSession
    parts = components(edges).select(F.col("node").alias("set_id"), "component")
    placed = table(classes.join(parts, "set_id"), "join-placed")
    weight = placed.groupBy("component").agg(F.sum("size").alias("grams"), F.count("*").alias("sets"))
    pieces = F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    large = table(weight.select("component", pieces.alias("pieces")).where("pieces > 1"), "join-large")
    total = placed.agg(F.sum("size")).first()[0] or 0
    groups = int(max(1, -(-total // BLOCK_GRAMS)))
    where = sized_join(placed, large, ["component"], "left", 12).select(
        "set_id",
        "set_check",
        "row",
        "node",
        "n",
        "component",
        F.col("pieces").isNotNull().alias("large"),
        F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.col("component")).alias("at"),
        F.coalesce(F.pmod(F.xxhash64("node"), F.col("pieces")), F.lit(0)).cast("int").alias("piece"),
        F.coalesce("pieces", F.lit(1)).alias("pieces"),
    )
    where = table(where, "join-where")
    whole = sized_join(rows, where, ["row"], "inner", 64, (F.col("row"), F.col("row"))).mapInArrow(_whole(n), "node long, n long, component long, large boolean, at long, piece int, pieces int, grams binary")
    met = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("x", F.least("piece", "other")).withColumn("y", F.greatest("piece", "other"))
    checked = met.groupBy("large", "at", "x", "y").applyInArrow(_verify(threshold, pairs), _PAIRS if pairs else _LINKS)
    checked = table(checked, "join-checked")
    discard(spark, placed, large, where)
    return checked


def similar_sets(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``doc_id, row, set_id, set_check`` of every row with a word, the
    classes of equal sets, and of these what ``_verify`` finds)."""
    safe, (i, t) = plain(docs, id_col, text_col)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows = safe.select(F.col(i).cast("long").alias("doc_id"), F.col(t).alias("text")).where(F.col("text").isNotNull()).withColumn("row", F.xxhash64("doc_id", "text"))
    size, texts = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    counters, light = counters_for(size or 0), light_limit(texts, threshold)
    surveyed = table(rows.mapInArrow(_survey(n, counters, light), _SCAN), "join-survey")
    classes = _classes_of_equals(surveyed)
    edges = _candidates(rows, surveyed, _sketch(surveyed, counters), light, n, threshold)
    checked = _verified(rows, classes, edges, n, threshold, pairs)
    discard(docs.sparkSession, edges)
    return surveyed.where(F.col("kind") == _ROW).select("doc_id", "row", "set_id", "set_check"), classes, checked


def _linked(classes: DataFrame, checked: DataFrame) -> DataFrame:
    """``set_id, set_check, root, links, least, n`` of every class that is
    similar to another or has several rows.  ``root`` names the group."""
    done = checked.where("final").select("node", "root", "links")
    rest = checked.where(~F.col("final"))
    if not rest.isEmpty():
        # large parts: links and stars came from several pairs of pieces
        links = rest.groupBy("node").agg(F.sum("links").alias("links"))
        stars = table(rest.where(F.col("node") != F.col("root")).select(F.col("root").alias("a"), F.col("node").alias("b")), "join-stars")
        done = done.unionByName(links.join(components(stars).withColumnRenamed("component", "root"), "node").select("node", "root", "links"))
    joined = classes.join(done, "node", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    return table(joined.select("set_id", "set_check", F.coalesce("root", "node").alias("root"), links.alias("links"), "least", "n").where("links > 0"), "join-linked")


def jaccard_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, links`` of every row that is similar to another.

    A text's set are its distinct runs of ``n`` words; a text of fewer words
    has one run of all of them.  Case doesn't count.  Two rows are similar if
    the Jaccard of their sets reaches the threshold; ``links`` is the number
    of other rows that a row is similar to, and ``class_id`` the smallest id
    among all that chains of similar rows connect (null if they have none).
    Null and empty texts, and those without a word, are similar to nothing.
    Repeated rows are similar to each other and each returned, so a class may
    be of one id.  A null id is given as null.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    owned, classes, checked = similar_sets(docs, n, threshold, id_col, text_col)
    linked = _linked(classes, checked)
    least = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    named = table(linked.join(least, "root").select("set_id", "set_check", "class_id", "links"), "join-named")
    return sized_join(owned, named, ["set_id", "set_check"], "inner", 32).select("doc_id", "class_id", "links")


def jaccard_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, other_id, jaccard`` of the similar classes of equal sets.

    A class is named by its smallest id (null if it has none), the smaller
    name comes first.  Rows of one class are not listed; see
    ``jaccard_classes`` for them and for what counts as similar.  The number
    of pairs in a group of near copies grows with its square.  An empty table
    gives an empty result.
    """
    _, classes, checked = similar_sets(docs, n, threshold, id_col, text_col, True)
    name = classes.select("node", "least")
    named = checked.join(name.select(F.col("node").alias("a"), F.col("least").alias("p")), "a").join(name.select(F.col("node").alias("b"), F.col("least").alias("q")), "b")
    swap = F.col("p").isNull() | (F.col("q") < F.col("p"))
    return named.select(F.when(swap, F.col("q")).otherwise(F.col("p")).alias("doc_id"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("other_id"), "jaccard")


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, less all but one of each group.

    A group are the documents that chains of similar pairs connect; the one
    with the smallest id (nulls last), then the smallest text hash, stays.  Of
    rows equal in id and text one stays.  Rows without a word all stay: null
    and empty texts are similar to nothing.  Extra columns pass through,
    whatever their names; an empty table gives an empty result.
    """
    owned, classes, checked = similar_sets(docs, n, threshold, id_col, text_col)
    linked = _linked(classes, checked)
    members = table(sized_join(owned, linked.select("set_id", "set_check", "root"), ["set_id", "set_check"], "inner", 32).select("root", "doc_id", "row"), "join-members")
    kept = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    counted = members.groupBy("row").agg(F.count("*").alias("rows"))
    some = table(counted.join(kept.withColumn("kept", F.lit(True)), "row", "left"), "join-gone")
    safe, (i, t) = plain(docs, id_col, text_col)
    keyed = safe.withColumn("row", F.xxhash64(F.col(i).cast("long"), F.col(t)))
    # what a row that is kept repeats
    again = table(some.where("kept AND rows > 1").select("row"), "join-again")
    gone = table(some.where("kept IS NULL").select("row").union(again), "join-out")
    own = (F.col("row"), F.col("row"))
    left = sized_join(keyed, gone, ["row"], "left_anti", 8, own)
    if not again.isEmpty():
        left = left.unionByName(sized_join(keyed, again, ["row"], "left_semi", 8, own).dropDuplicates(["row"]))
    return left.drop("row").toDF(*docs.columns)
