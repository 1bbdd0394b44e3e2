"""Vectorised byte-level text work shared by the operators that run in Arrow batches.

A batch of texts is one byte buffer and its offsets.  Words are found by byte
class and hashed by prefix sums, so the cost is a few array passes per byte and
no Python object is made per word.  Buffers are worked through in blocks cut at
separators, so memory stays bounded however long a text is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 16
_MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit; changes x."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


class _Powers:
    """Powers of an odd base and of its inverse, grown when a longer block comes."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, _BLOCK + 1), _powers(_BASE_INV, _BLOCK + 1)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            size = 1 << int(n).bit_length()
            return _powers(_BASE, size + 1), _powers(_BASE_INV, size + 1)
        return self.up, self.down


_POWERS = _Powers()


def byte_values(lower: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit value for each byte; lower maps bytes first."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)
    x = mix(x)
    return x[lower] if lower is not None else x


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
VALUES = byte_values()
VALUES_LOWER = byte_values(ASCII_LOWER)
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def span_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A never-zero 64-bit hash of block[start:end] for each span, by content alone."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _POWERS.of(len(block))
    sums = np.empty(len(block) + 1, dtype=np.uint64)
    sums[0] = 0
    x = values[block]
    x *= up[: len(block)]
    np.cumsum(x, out=sums[1:])
    h = sums[ends]
    h -= sums[starts]
    h *= down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = mix(h)
    h[h == 0] = 1
    return h


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) of about size bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to
        at = to


@dataclass
class Words:
    """The words of a batch: their hashes, and each text's range of them."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def _blocks(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about _BLOCK bytes that end behind a separator."""
    at, n = 0, len(data)
    while at < n:
        to, step = min(at + _BLOCK, n), 4096
        while to < n and is_word[data[to - 1]]:
            stop = np.flatnonzero(~is_word[data[to : to + step]])
            to, step = (to + int(stop[0]) + 1, step) if len(stop) else (min(n, to + step), step * 2)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, *, lower: bool, is_word: np.ndarray = NOT_SPACE, spans: bool = False) -> Words:
    """Hashes of the maximal runs of word bytes in every text.

    lower: A-Z hash as a-z.  spans: byte ranges of the words are returned too.
    """
    n = len(offsets) - 1
    cut = offsets[1:-1][np.diff(offsets)[:-1] > 0] if n > 1 else offsets[:0]
    values = VALUES_LOWER if lower else VALUES
    parts, begin, finish = [], [], []
    for at, to in _blocks(data, is_word):
        block = data[at:to]
        w = is_word[block]
        edge = np.empty(len(block) + 1, dtype=bool)
        edge[0], edge[-1] = w[0], w[-1]
        np.not_equal(w[1:], w[:-1], out=edge[1:-1])
        inside = cut[np.searchsorted(cut, at, "right") : np.searchsorted(cut, to, "left")] - at
        both = inside[w[inside] & w[inside - 1]] if len(inside) else inside
        edges = np.flatnonzero(edge)
        if len(both):
            edges = np.sort(np.concatenate([edges, both, both]))
        s, e = edges[0::2], edges[1::2]
        parts.append(span_hashes(block, s, e, values))
        begin.append(s + at)
        if spans:
            finish.append(e + at)
    starts = np.concatenate(begin) if begin else np.empty(0, dtype=np.int64)
    bounds = np.searchsorted(starts, offsets, side="left")
    return Words(np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64), bounds, starts if spans else None, (np.concatenate(finish) if finish else starts[:0]) if spans else None)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of width consecutive words of one sequence, texts' borders ignored."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    step = 1 << 17
    for at in range(0, n, step):
        part = hashes[at : min(n, at + step) + width - 1]
        up, down = _POWERS.of(len(part))
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1:])
        h = sums[width:] - sums[:-width]
        h *= down[: len(h)]
        h += np.uint64((width * 0xA0761D6478BD642F) & _MASK64)
        out[at : at + len(h)] = mix(h)
    out[out == 0] = 1
    return out


def tidy() -> None:
    """Give freed memory back to the machine: workers stay, idle, beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with tidy() at the end of every task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return wrapped


def tidied_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run, for applyInArrow, with tidy() after every group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        tidy()
        return out

    return wrapped


class HashMap:
    """Open addressing from 64-bit hashes (never 0) to 0, 1, 2, ... in order of insertion."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        at = (h & mask).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.values[at], np.int32(-1))
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(mask)
            key, own = self.keys[at[todo]], h[todo]
            hit = key == own
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Insert distinct hashes that are not there yet."""
        while (self.n + len(h)) * 3 > (1 << self.bits):
            old = np.flatnonzero(self.keys)
            keys, values = self.keys[old], self.values[old]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
            self._place(keys, values)
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _place(self, h: np.ndarray, v: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = h[free]
            won = free[self.keys[at[free]] == h[free]]
            self.values[at[won]] = v[won]
            placed = np.zeros(len(h), dtype=bool)
            placed[won] = True
            todo = todo[~placed[todo]]
            at[todo] = (at[todo] + 1) & mask


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
