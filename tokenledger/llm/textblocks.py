"""Vectorised word and n-gram views of text columns, for use inside Spark tasks.

An Arrow batch of texts is cut into blocks of about ``BLOCK_BYTES`` bytes (a
longer text is one block of its own; texts are never split). A ``Block`` finds
the words of all its texts at once from the raw UTF-8 bytes and gives each word
and word n-gram a 64-bit hash. Memory is a small multiple of the block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: lower-cases A-Z, leaves every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words ``[^\x20\x09-\x0D]+``
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False

#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: 0-9, a-z and all beyond ASCII
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_1
    h ^= h >> np.uint64(33)
    h = h * _MIX_2
    h ^= h >> np.uint64(33)
    return h


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, BLOCK_BYTES + 1)
            ones = np.full(size, _BASE, np.uint64)
            ones[0] = 1
            self.up = np.multiply.accumulate(ones)
            ones = np.full(size, _BASE_INV, np.uint64)
            ones[0] = 1
            self.down = np.multiply.accumulate(ones)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Block:
    """Texts ``first .. first + n - 1`` of a batch as one byte array.

    ``data``: bytes (lower-cased when asked); ``bounds``: n + 1 byte offsets of
    the texts; ``starts`` / ``ends``: byte range of each word; ``doc``: text of
    each word, counted from 0 in the block; ``word_bounds``: n + 1 word offsets.
    """

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> None:
        self.first, self.data, self.bounds = first, data, bounds
        self.n = len(bounds) - 1
        inside = is_word[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.word_bounds = np.searchsorted(self.starts, bounds)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.word_bounds))

    def prefix(self) -> np.ndarray:
        """Exclusive prefix sums of byte x base**position."""
        up, _ = _POWERS.get(len(self.data) + 1)
        p = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=p[1:])
        return p

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        _, down = _POWERS.get(len(self.data) + 1)
        p = self.prefix()
        return mix((p[self.ends] - p[self.starts]) * down[self.starts])

    def gram_hashes(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``k`` words of one text."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = words[:n].copy()
        for j in range(1, k):
            h = h * _STEP + words[j:j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return at, mix(h[at] + np.uint64(k))

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, is_word: np.ndarray, lower: bool = False,
           block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string column in blocks of about ``block_bytes`` bytes."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        part = data[offsets[first]:offsets[last]]
        yield Block(first, LOWER[part] if lower else part, offsets[first:last + 1] - offsets[first], is_word)
        first = last


