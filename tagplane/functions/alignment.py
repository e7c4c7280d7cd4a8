"""Scores of read segments against a linker: local alignment with affine gaps, for distinct segments.

A segment that shares no run of ``SEED`` bases with the linker scores zero. Cells of the alignment are
filled for all segments of a batch at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 6
#: Base-4 code of each letter, whatever its case; an unknown base reads as A; others are no bases.
_CODE = np.full(256, -1, np.int64)
for _letters, _value in (("AaNn", 0), ("Cc", 1), ("Gg", 2), ("Tt", 3)):
    _CODE[list(_letters.encode())] = _value
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def _letters_of(segments: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the segments in rows, zero after the end of each, and their lengths; one copy for all."""
    sizes = np.array([len(s) for s in segments], np.int64)
    flat = np.frombuffer("".join(segments).encode("latin-1", "replace"), np.uint8)
    inside = np.arange(max(sizes, default=0)) < sizes[:, None]
    letters = np.zeros(inside.shape, np.uint8)
    letters[inside] = _UPPER[flat]
    return letters, sizes


def _runs(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base-4 code of the ``SEED`` bases from each place of each row, by rolling, and whether they are inside."""
    codes = np.maximum(_CODE[letters], 0)
    n = max(letters.shape[1] - SEED + 1, 0)
    rolled = np.zeros((len(letters), n), np.int64)
    for k in range(SEED):
        rolled = rolled * 4 + codes[:, k : n + k]
    return rolled, np.arange(n) < (sizes - SEED + 1)[:, None]


def _seeded(ref: str, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each row shares a run of bases with the reference, by a table of all runs."""
    held = np.zeros(4**SEED, bool)
    own, _ = _runs(*_letters_of([ref]))
    held[own] = True
    rolled, inside = _runs(letters, sizes)
    return (held[rolled] & inside).any(1)


def scores(ref: str, segments: Sequence[str], match: int = 1, mismatch: int = -1, gap_open: int = -3, gap_extend: int = -1) -> np.ndarray:
    """Best local alignment score of each segment; the first base of a gap costs ``gap_open``."""
    for name in ([ref], segments):
        letters, sizes = _letters_of(name)
        if (sizes < SEED).any():
            raise ValueError(f"sequences need {SEED} bases: {name[int(np.argmin(sizes))]!r}")
        strange = ((np.arange(letters.shape[1]) < sizes[:, None]) & (_CODE[letters] < 0)).any(1)
        if strange.any():
            raise ValueError(f"unknown base in {name[int(np.argmax(strange))]!r}")
    n, width = letters.shape
    out = np.zeros(n, np.int64)
    near = np.flatnonzero(_seeded(ref, letters, sizes))
    # Only segments with a seed are aligned.
    letters, sizes, n = letters[near], sizes[near], len(near)
    low = np.full(n, -(10**6))
    above, above_gap = np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -(10**6), np.int64)
    best = np.zeros(n, np.int64)
    for base in ref.upper().encode():
        left_gap, row, row_gap = low.copy(), np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -(10**6), np.int64)
        for j in range(1, width + 1):
            inside = sizes >= j
            row_gap[j] = np.maximum(above[j] + gap_open, above_gap[j] + gap_extend)
            left_gap = np.maximum(row[j - 1] + gap_open, left_gap + gap_extend)
            met = above[j - 1] + np.where(letters[:, j - 1] == base, match, mismatch)
            row[j] = np.where(inside, np.maximum.reduce([met, row_gap[j], left_gap, np.zeros(n, np.int64)]), 0)
            best = np.maximum(best, row[j])
        above, above_gap = row, row_gap
    out[near] = best
    return out


def score_column(segment: Column, ref: str, **costs: int) -> Column:
    @F.pandas_udf("int")
    def score(batch: pd.Series) -> pd.Series:
        known = batch.dropna()
        out = pd.Series(index=batch.index, dtype="Int32")
        if len(known):
            out[known.index] = scores(ref, list(known), **costs).astype("int32")
        return out

    return score(segment)


def segment_scores(segments: DataFrame, linkers: dict[str, str], **costs: int) -> DataFrame:
    """segment and a score column per linker, for the distinct segments of segments(segment)."""
    once = segments.select("segment").where("segment is not null").distinct()
    return once.select("segment", *[score_column(F.col("segment"), ref, **costs).alias(f"score_{name}") for name, ref in linkers.items()])
