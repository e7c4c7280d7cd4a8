"""Elias-Fano coding of monotone sequences, and an n-gram trie of such levels in one flat buffer."""

from __future__ import annotations

import mmap
import struct
import tempfile
from dataclasses import dataclass

import numpy as np

U64 = np.uint64


@dataclass
class EliasFano:
    """A non-decreasing sequence: low bits in a packed array, high bits in unary.

    ``ones`` has the number of ones before each 64-bit word of the unary part, so that the i-th one is
    found by a search over words and a few steps within one.
    """

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n * low_bits + 63) // 64 + 1, U64)
        if low_bits:
            part = values & U64((1 << low_bits) - 1)
            at = np.arange(n, dtype=U64) * U64(low_bits)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U64(low_bits) > U64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        spots = (values >> U64(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(spots[-1]) + 64) // 64 if n else 1
        bits = np.zeros(size * 64, np.uint8)
        bits[spots] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        return EliasFano(n, low_bits, low, high, EliasFano._directory(high))

    @staticmethod
    def _directory(high: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]

    def low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i.astype(U64) * U64(self.low_bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        first = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return (first | spill) & U64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        left = (i - self.ones[word]).astype(U64)
        bits, at = self.high[word], np.zeros(len(i), U64)
        for step in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((bits >> at) & U64((1 << step) - 1)).astype(U64)
            skip = here <= left
            left -= np.where(skip, here, U64(0))
            at += np.where(skip, U64(step), U64(0))
        high = word * 64 + at.astype(np.int64) - i
        return (high.astype(U64) << U64(self.low_bits)) | self.low_part(i)

    def values(self) -> np.ndarray:
        """The whole sequence."""
        spots = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        return ((spots - np.arange(self.n)).astype(U64) << U64(self.low_bits)) | self.low_part(np.arange(self.n))

    def successors(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each x the first place in its [lo, hi) whose value is x or more, else hi: binary searches side by side."""
        lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.access(mid) < x[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @staticmethod
    def read(buffer: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high = struct.unpack_from("<QQQQ", buffer, at)
        low = np.frombuffer(buffer, U64, n_low, at + 32)
        high = np.frombuffer(buffer, U64, n_high, at + 32 + 8 * n_low)
        return EliasFano(n, low_bits, low, high, EliasFano._directory(high)), at + 32 + 8 * (n_low + n_high)


#: Steps of a quantised logarithm in a decade; 16 bits reach 13 decades.
STEPS = 5000


def quantise(shares: np.ndarray) -> np.ndarray:
    """Codes of two bytes for shares in (0, 1]: log10 in fixed steps, so that equal shares have equal codes
    in every shard; 0 stands for a share of zero."""
    codes = np.zeros(len(shares), np.uint16)
    some = shares > 0
    codes[some] = np.minimum(np.round(-np.log10(shares[some]) * STEPS) + 1, 65535).astype(np.uint16)
    return codes


def dequantise(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes > 0, 10.0 ** ((1 - codes) / STEPS), 0.0)


@dataclass
class Level:
    """The children of all nodes of the level above: ``pointers`` say where the children of a node begin,
    and child ids are stored relative to their parent, id + place of the parent * ``ids``, which makes one
    monotone sequence. Each child has a quantised probability."""

    ids: int
    pointers: EliasFano
    children: EliasFano
    codes: np.ndarray

    @staticmethod
    def build(parent: np.ndarray, child: np.ndarray, n_parents: int, codes: np.ndarray) -> bytes:
        """From distinct (parent, child) in ascending order and their codes."""
        ids = int(child.max()) + 1 if len(child) else 1
        starts = np.searchsorted(parent, np.arange(n_parents + 1))
        parts = [EliasFano.build(x).to_bytes() for x in (starts, child.astype(U64) + parent.astype(U64) * U64(ids))]
        pad = b"\0" * (-2 * len(codes) % 8)
        return struct.pack("<QQ", ids, len(codes)) + b"".join(parts) + codes.astype(np.uint16).tobytes() + pad

    @staticmethod
    def read(buffer: memoryview, at: int) -> tuple[Level, int]:
        ids, n = struct.unpack_from("<QQ", buffer, at)
        pointers, at = EliasFano.read(buffer, at + 16)
        children, at = EliasFano.read(buffer, at)
        return Level(ids, pointers, children, np.frombuffer(buffer, np.uint16, n, at)), at + 2 * n + (-2 * n % 8)

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place of each child of a parent, -1 where the level has none (or the parent is -1)."""
        out = np.full(len(parent), -1, np.int64)
        rows = np.flatnonzero((parent >= 0) & (child.astype(np.int64) < self.ids))
        if not len(rows) or not self.children.n:
            return out
        p, x = parent[rows], child[rows].astype(U64) + parent[rows].astype(U64) * U64(self.ids)
        lo, hi = self.pointers.access(p).astype(np.int64), self.pointers.access(p + 1).astype(np.int64)
        at = self.children.successors(x, lo, hi)
        found = at < hi
        found[found] = self.children.access(at[found]) == x[found]
        out[rows[found]] = at[found]
        return out


@dataclass
class Trie:
    """Levels of an n-gram trie: first words, words that follow them, and words that follow both."""

    levels: list[Level]

    @staticmethod
    def build(levels: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]) -> bytes:
        return struct.pack("<Q", len(levels)) + b"".join(Level.build(*x) for x in levels)

    @staticmethod
    def read(buffer: memoryview) -> Trie:
        (n,) = struct.unpack_from("<Q", buffer, 0)
        at, levels = 8, []
        for _ in range(n):
            level, at = Level.read(buffer, at)
            levels.append(level)
        return Trie(levels)

    @staticmethod
    def mapped(blob: bytes) -> Trie:
        """Over a file without a name in the task's own temporary folder: it never leaves the task and is gone with the mapping."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            return Trie.read(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
