"""Words of whole texts as 64-bit hashes, a batch of rows at a time.

A word is a run of bytes other than ASCII white space. All arrays are made from slices of about a
megabyte of text (or one longer text), so the memory that a task needs does not depend on how many
rows a batch has. Nothing here keeps state between slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
SLICE_TEXTS = 1 << 16
HASH_BITS, DROPPED = U64(48), U64(16)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to the usual slice size."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE_BYTES + 1), base, U64)
        got[0] = 1
        got = np.cumprod(got, dtype=U64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of some consecutive rows."""

    first: int  # row in the batch of the first text
    n: int  # texts
    data: np.ndarray  # bytes of the texts
    offsets: np.ndarray  # where each text starts in data, and the end
    starts: np.ndarray  # byte where each word starts
    ends: np.ndarray
    doc: np.ndarray  # text of each word, from 0
    hashes: np.ndarray

    @property
    def rows(self) -> slice:
        return slice(self.first, self.first + self.n)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each word over each text."""
        return np.bincount(self.doc, weights=values, minlength=self.n)

    def byte_sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag of each byte over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span: a polynomial in an odd base, read off one running sum."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUES[data] * _power(_P, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_P_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U64))


def rolling_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` values in a row, read off one running sum."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power(_P, len(values)), out=sums[1:])
    n = len(values) - width + 1
    return mix((sums[width:] - sums[:n]) * _power(_P_INVERSE, len(values) + 1)[:n])


def find_words(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    word = ~_SPACES[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | begins[1:-1]
    closes = word.copy()
    if len(data):
        closes[:-1] &= ~word[1:] | begins[1:-1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(first, len(offsets) - 1, data, offsets, starts, ends, doc, span_hashes(data, starts, ends))


def bare_spans(words: Words, times: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends without its outer punctuation, that many marks a side at most: of
    ASCII, of the general punctuation block (curly quotes, dashes) and angle quotes."""
    data, starts, ends = words.data, words.starts.copy(), words.ends.copy()
    at = lambda where, shift: data[np.minimum(where + shift, len(data) - 1)]
    for _ in range(times):
        size = ends - starts
        general = (size > 3) & (at(starts, 0) == 0xE2) & (at(starts, 1) == 0x80) & (at(starts, 2) >= 0x90)
        angle = (size > 2) & (at(starts, 0) == 0xC2) & ((at(starts, 1) == 0xAB) | (at(starts, 1) == 0xBB))
        starts += np.where(general, 3, np.where(angle, 2, _PUNCTUATION[at(starts, 0)] & (size > 1)))
        size = ends - starts
        general = (size > 3) & (at(ends, -3) == 0xE2) & (at(ends, -2) == 0x80) & (at(ends, -1) >= 0x90)
        angle = (size > 2) & (at(ends, -2) == 0xC2) & ((at(ends, -1) == 0xAB) | (at(ends, -1) == 0xBB))
        ends -= np.where(general, 3, np.where(angle, 2, _PUNCTUATION[at(ends, -1)] & (size > 1)))
    return starts, ends


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_slices(column: pa.Array, lower: bool) -> Iterator[Words]:
    """The words of a batch, a slice of rows at a time."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(n, max(j, i + 1), i + SLICE_TEXTS)
        yield find_words(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


_STEP = [U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each window of ``width`` words; a shorter text with words is one window."""
    h, doc = words.hashes, words.doc
    if not len(h):
        return h, doc
    n = len(h)
    joined = np.zeros(n, U64)
    whole = np.ones(n, bool)
    for k in range(width):
        shifted = np.zeros(n, U64)
        shifted[: max(n - k, 0)] = h[k:]
        joined = mix(joined + shifted * _STEP[k % 5] + U64(k + 1))
        if k:
            whole[max(n - k, 0) :] = False
            whole[: max(n - k, 0)] &= doc[k:] == doc[: max(n - k, 0)]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    if not len(short):
        return joined[whole], doc[whole]
    # The words of a short text in their order; windows and short texts never hash alike.
    extra = np.zeros(len(short), U64)
    for k in range(width - 1):
        has = counts[short] > k
        at = firsts[short[has]] + k
        extra[has] = mix(extra[has] + h[at] * _STEP[(k + 2) % 5] + U64(100 + k))
    hashes = np.concatenate([joined[whole], extra])
    docs = np.concatenate([doc[whole], short])
    return hashes, docs


def distinct_sorted(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text in ascending order, text by text, as 48-bit numbers.

    The number of the text stands before the hash, so that one sort does both. A text that is alone
    in its slice is told apart by all 64 bits first.
    """
    if n == 1:
        key = np.unique(hashes)
        return key >> DROPPED, np.zeros(len(key), np.int64)
    key = np.unique((docs.astype(U64) << HASH_BITS) | (hashes >> DROPPED))
    return key & ((U64(1) << HASH_BITS) - U64(1)), (key >> HASH_BITS).astype(np.int64)


def repeated(hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Whether each hash occurs twice or more in its text."""
    key = hashes if n == 1 else (docs.astype(U64) << HASH_BITS) | (hashes >> DROPPED)
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
