"""Counts of the form of whole texts, from the words of a slice."""

from __future__ import annotations

import numpy as np

from tagplane.llm.words import U64, Words, mix, repeated, span_hashes

SYMBOLS = b"#*$%&|<>"
_STEP = [U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93), U64(0xFF51AFD7ED558CCD)]


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_IS_SYMBOL, _IS_DIGIT = _table(SYMBOLS), _table(b"0123456789")
_IS_UPPER, _IS_LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_IS_STOP = _table(b".!?")
_STARTS_CHAR = np.array([b & 0xC0 != 0x80 for b in range(256)])


def line_counts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the text."""
    breaks = np.flatnonzero(words.data == 10)
    starts = np.sort(np.concatenate([words.offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, words.offsets[1:]]))
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(words.offsets, starts, side="right") - 1
    lines = np.bincount(doc, minlength=words.n)
    hashes = span_hashes(words.data, starts, ends)
    order = np.lexsort((hashes, doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return lines, np.bincount(doc[order][1:][same], minlength=words.n)


def repeat_words(words: Words) -> np.ndarray:
    """Words of each text in three-word windows that the text has twice or more."""
    h, doc = words.hashes, words.doc
    if len(h) < 3:
        return np.zeros(words.n, np.int64)
    inside = doc[2:] == doc[:-2]
    window = mix(mix(mix(h[:-2] * _STEP[0]) + h[1:-1] * _STEP[1]) + h[2:] * _STEP[2])
    twice = np.zeros(len(window), bool)
    twice[inside] = repeated(window[inside], doc[:-2][inside], words.n)
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[k : len(h) - 2 + k] |= twice
    return words.per_doc(covered).astype(np.int64)


def form(words: Words) -> dict[str, np.ndarray]:
    """Whole-number counts of each text, by name."""
    data = words.data
    lines, dup_lines = line_counts(words)
    first, last = data[words.starts], data[words.ends - 1]
    before_last = np.where(words.ends - words.starts > 1, data[np.maximum(words.ends - 2, 0)], 0)
    in_words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STARTS_CHAR[data], out=in_words[1:])
    return {
        "n_words": words.counts().astype(np.int64),
        "word_chars": words.per_doc(in_words[words.ends] - in_words[words.starts]).astype(np.int64),
        "n_symbols": words.byte_sums(_IS_SYMBOL[data]),
        "n_lines": lines.astype(np.int64),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": repeat_words(words),
        "n_upper": words.byte_sums(_IS_UPPER[data]),
        "n_letters": words.byte_sums(_IS_LETTER[data]),
        "n_digits": words.byte_sums(_IS_DIGIT[data]),
        "n_capitalised": words.per_doc(_IS_UPPER[first]).astype(np.int64),
        "n_stops": words.per_doc(_IS_STOP[last]).astype(np.int64),
        "n_shouts": words.per_doc((last == 33) & (before_last == 33)).astype(np.int64),
        "n_marked": words.per_doc(_IS_SYMBOL[last]).astype(np.int64),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_capitalised", "n_stops", "n_shouts", "n_marked")
