"""Elias-Fano sequences on memory-mapped bytes, read by vectorised select and search.

A monotone sequence of n values below 2^63 keeps its low bits packed and its high
bits in unary, with a directory of the zeros before each 64-bit word.
"""

from __future__ import annotations

import json
import struct

import numpy as np

#: Position of the r-th set bit of a byte.
_SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    for _r, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _SELECT[_b, _r] = _p


class Sequence:
    """Arrays of one sequence: low (bytes), high (words), zeros (directory of zeros), ones (directory of ones)."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> Sequence:
        n = len(values)
        bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        v = values.astype(np.uint64)
        top = (v >> np.uint64(bits)).astype(np.int64)
        size = n + (universe >> bits) + 2
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[top + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        if bits:
            wide = np.ascontiguousarray((v & np.uint64((1 << bits) - 1))).view(np.uint8).reshape(n, 8)
            low = np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")
        else:
            low = np.empty(0, np.uint8)
        low = np.r_[low, np.zeros(16, np.uint8)]
        low = np.r_[low, np.zeros(-len(low) % 8, np.uint8)]
        zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]
        return cls(n, bits, low, high, zeros)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        # A value lies in at most two of the 64-bit words; the array has whole words and two to spare.
        words, at = self.low.view(np.uint64), i * self.bits
        k, shift = at >> 6, (at & 63).astype(np.uint64)
        spill = words[k + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return ((words[k] >> shift) | spill) & np.uint64((1 << self.bits) - 1)

    def _in_word(self, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.zeros(len(words), np.int64)
        for half in (32, 16, 8):
            low = words & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            up = rank >= ones
            rank = rank - np.where(up, ones, 0)
            words = np.where(up, words >> np.uint64(half), low)
            at += up * half
        return at + _SELECT[words.astype(np.int64), rank]

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high part."""
        w = np.searchsorted(self.zeros, k, "right") - 1
        return w * 64 + self._in_word(~self.high[w], k - self.zeros[w])

    def select1(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        w = np.searchsorted(ones, k, "right") - 1
        return w * 64 + self._in_word(self.high[w], k - ones[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the given indices."""
        top = (self.select1(i) - i).astype(np.uint64)
        return (top << np.uint64(self.bits)) | self.lows(i)

    def bucket(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices [a, b) of the values that share the high bits of each x."""
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        begin = np.where(h > 0, self.select0(np.maximum(h - 1, 0)) + 1, 0)
        # The run of ones from there on, read from 64 bits; longer ones end at the next zero.
        k, shift = begin >> 6, (begin & 63).astype(np.uint64)
        after = self.high[np.minimum(k + 1, len(self.high) - 1)]
        bits = (self.high[k] >> shift) | (after << (np.uint64(63) - shift) << np.uint64(1))
        run = np.bitwise_count(bits & ~(bits + np.uint64(1))).astype(np.int64)
        long = np.flatnonzero(bits == np.uint64(0xFFFFFFFFFFFFFFFF))
        a = begin - h
        end = a + run
        end[long] = self.select0(h[long]) - h[long]
        return a, end

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, or -1; only looked for in [lo, hi) if given."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        a, b = self.bucket(x)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        want = x & np.uint64((1 << self.bits) - 1)
        end = b.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            less = self.lows(mid) < want[todo]
            a[todo[less]] = mid[less] + 1
            b[todo[~less]] = mid[~less]
            todo = todo[a[todo] < b[todo]]
        here = np.flatnonzero(a < end)
        here = here[self.lows(a[here]) == want[here]]
        out[here] = a[here]
        return out

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros, f"{name}.size": np.array([self.n, self.bits], np.int64)}


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One block of bytes: a header with names, types and places, then the arrays at multiples of 8."""
    at, head, body = 0, {}, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = (a.dtype.str, at, a.size)
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(body)


def from_buffer(buf) -> dict[str, np.ndarray]:
    """Views of the arrays in a buffer, such as a memory map; nothing is copied."""
    view = memoryview(buf)
    (size,) = struct.unpack("<Q", view[:8])
    head = json.loads(bytes(view[8 : 8 + size]))
    return {name: np.frombuffer(view, np.dtype(kind), count, 8 + size + at) for name, (kind, at, count) in head.items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> Sequence:
    n, bits = arrays[f"{name}.size"].tolist()
    return Sequence(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])
