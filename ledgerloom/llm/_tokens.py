"""Words and word n-grams of Arrow string columns, computed a block at a time.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters.  Letters of every script are lower-cased, character by character.
Everything works on the UTF-8 bytes of whole texts; blocks only bound the
memory that one step needs and never cut a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once (a longer text is a block of its own).
BLOCK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

_RANDOM = np.random.default_rng(20240229)
_BYTE_MULT = _RANDOM.integers(1, 2**63, size=1 << 12, dtype=np.uint64) | np.uint64(1)
_GRAM_MULT = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Block:
    """Some consecutive texts: ``first`` is the row of the first of them."""

    first: int
    data: np.ndarray  # uint8, lower-cased
    offsets: np.ndarray  # int64, one more than texts

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, count=n + 1, offset=at * kind.itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def raw_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in order, unchanged, in blocks of about ``limit`` bytes."""
    data, offsets = bytes_of(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(max(to, row + 1), n)
        yield Block(row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters lower-cased, all in their places."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.empty(0, np.int64)
    if len(lead):
        second = data[lead]
        out[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
    return out


@dataclass
class Words:
    """Words of a block: byte range, text (row within the block) and hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first_word: np.ndarray  # per text, and one more: index of its first word


def words_of(block: Block) -> Words:
    """``block.data`` must be lower-cased if hashes are to ignore case."""
    data, offsets = block.data, block.offsets
    inside = _WORD[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        heads = offsets[:-1]
        before[heads[heads < len(data)]] = False
    begins = inside & ~before
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.empty(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), np.zeros(block.texts + 1, np.int64))
    # a word ends where the next byte is outside or begins another word
    stops = np.empty_like(inside)
    stops[-1] = inside[-1]
    stops[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
    end = np.flatnonzero(stops) + 1
    where = np.arange(len(data), dtype=np.int64)
    where -= np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(data)]))))
    np.bitwise_and(where, len(_BYTE_MULT) - 1, out=where)
    value = _BYTE_MULT[where]
    value *= np.where(inside, data, 0).astype(np.uint64) + inside
    h = mix(np.add.reduceat(value, start) + (end - start).astype(np.uint64))
    first_word = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(block.texts), np.diff(first_word))
    return Words(start, end, text, h, first_word)


def grams_of(words: Words, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, index of first word) of every run of ``n`` words.

    A text of fewer than ``n`` words, but at least one, has one gram of all
    its words if ``whole_if_short``.
    """
    m = len(words.hash)
    if m >= n:
        h = np.zeros(m - n + 1, np.uint64)
        for k in range(n):
            h += words.hash[k : m - n + 1 + k] * _GRAM_MULT[k % len(_GRAM_MULT)]
        at = np.flatnonzero(words.text[: m - n + 1] == words.text[n - 1 :])
        h, text = mix(h[at]), words.text[at]
    else:
        h, text, at = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if whole_if_short and n > 1:
        count = np.diff(words.first_word)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for i, t in enumerate(short):
                own = words.hash[words.first_word[t] : words.first_word[t + 1]]
                extra[i] = (own * _GRAM_MULT[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
            h = np.concatenate((h, mix(extra)))
            text = np.concatenate((text, short))
            at = np.concatenate((at, words.first_word[short]))
            order = np.argsort(at, kind="stable")
            h, text, at = h[order], text[order], at[order]
    return h, text, at


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[Block, Words]]:
    """Lower-cased blocks with their words."""
    for block in raw_blocks(column, limit):
        low = _lower_block(block)
        yield low, words_of(low)


def _lower_block(block: Block) -> Block:
    """Lower-cased in every script.  Where all bytes are of ASCII or Latin-1
    letters nothing moves; else characters may change their length."""
    if not len(block.data) or int(block.data.max()) < 0xC4 or not (block.data >= 0xC4).any():
        return Block(block.first, lowered(block.data), block.offsets)
    texts = pa.LargeStringArray.from_buffers(block.texts, pa.py_buffer(block.offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(block.data)))
    data, offsets = bytes_of(pc.utf8_lower(texts))
    return Block(block.first, data, offsets)
