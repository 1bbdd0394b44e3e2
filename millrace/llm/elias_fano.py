"""Elias-Fano coding of a non-decreasing sequence, with a select structure, and the shard file that uses it.

A value's low bits are stored as they are and its high bits in unary, so n values
up to u take about n * (2 + log2(u / n)) bits.  select(i) starts from the sampled
position of every 64th value and counts bits from there: no table of 64-bit
offsets is kept or built.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_HEAD = struct.Struct("<QQBQQ")
_EVERY = 64
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


@dataclass
class EliasFano:
    """n values in [0, u]: low bits, unary high bits, and the bit position of every 64th value."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, dtype=bool)
        bits[high] = True
        shifts = np.arange(width, dtype=np.uint64)
        low = np.concatenate([np.packbits(((values[a : a + 8192, None] >> shifts) & np.uint64(1)).astype(bool), bitorder="little") for a in range(0, n, 8192)]) if n and width else np.empty(0, dtype=np.uint8)
        return cls(n, width, low, np.packbits(bits, bitorder="little"), high[::_EVERY].astype(np.uint32 if not n or high[-1] < 1 << 32 else np.uint64))

    def tobytes(self) -> bytes:
        return _HEAD.pack(self.n, self.low_bits, self.samples.itemsize, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, raw: bytes | memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, item, n_low, n_high = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        k = -(-n // _EVERY)
        samples = np.frombuffer(raw, np.uint32 if item == 4 else np.uint64, k, at + n_low + n_high)
        return cls(n, width, low, high, samples), at + n_low + n_high + k * item

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        block, k = divmod(i, 8192)
        first = block * 8192 * self.low_bits + k * self.low_bits
        a, b = first // 8, -(-(first + self.low_bits) // 8)
        return int.from_bytes(self.low[a:b].tobytes(), "little") >> (first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, from its sample and a count of at most a few bytes' bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // _EVERY]), i % _EVERY
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := int(_ONES[word])) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        return (position - i) << self.low_bits | self._low(i)

    def values(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Values a to b, decoded together."""
        b = self.n if b is None else b
        if a >= b:
            return np.empty(0, dtype=np.int64)
        from_byte = int(self.samples[a // _EVERY]) // 8
        last = int(self.samples[(b - 1) // _EVERY]) // 8
        end = int(self.samples[(b - 1) // _EVERY + 1]) // 8 + 1 if (b - 1) // _EVERY + 1 < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[from_byte : max(end, last + 1)], bitorder="little")
        bits[: int(self.samples[a // _EVERY]) % 8] = 0
        first = a // _EVERY * _EVERY
        position = np.flatnonzero(bits)[a - first : b - first] + from_byte * 8
        high = (position - np.arange(a, b)).astype(np.int64)
        if not self.low_bits:
            return high
        low = np.empty(b - a, dtype=np.int64)
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        per_block = 8192 * self.low_bits // 8
        for block in range(a // 8192, (b - 1) // 8192 + 1):
            x, y = max(a, block * 8192), min(b, (block + 1) * 8192)
            own = np.unpackbits(self.low[block * per_block : (block + 1) * per_block], bitorder="little")
            k = x - block * 8192
            low[x - a : y - a] = own[k * self.low_bits : (k + y - x) * self.low_bits].reshape(-1, self.low_bits) @ weights
        return high << self.low_bits | low


_MAGIC = b"MRTOKID1"
_SHARD = struct.Struct("<8sQQQqB")


def pack_shard(doc_ids: np.ndarray, n_null: int, bounds: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file: header, boundaries, document ids, token ids.

    doc_ids ascend and follow n_null documents without an id; bounds has one value
    more than there are documents.  Token ids take 2 bytes where all fit, else 4.
    """
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    base = int(doc_ids[0]) if len(doc_ids) else 0
    known = EliasFano.of((doc_ids - base).astype(np.uint64))
    head = _SHARD.pack(_MAGIC, len(bounds) - 1, len(ids), n_null, base, width)
    return head + EliasFano.of(bounds).tobytes() + known.tobytes() + ids.astype("<u2" if width == 2 else "<u4").tobytes()


class Shard:
    """A shard file's documents, found without decoding what comes before them."""

    def __init__(self, raw: bytes) -> None:
        magic, self.n_docs, self.n_tokens, self.n_null, self.base, width = _SHARD.unpack_from(raw, 0)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        self.bounds, at = EliasFano.read(raw, _SHARD.size)
        self.known, at = EliasFano.read(raw, at)
        self.ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4", self.n_tokens, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.known.select(i - self.n_null)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of document i."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]
