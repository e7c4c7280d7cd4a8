"""Words, shingles and form counts of slices against plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tagplane.llm import textstats
from tagplane.llm import words as w

from .conftest import lower, shingle_set, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB .\n\t!é#|1", max_size=60)), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_words_and_shingles(texts, width):
    names, sizes, sets = {}, [], []
    for part in w.word_slices(pa.array(texts, pa.string()), lower=True):
        raw = part.data.tobytes()
        for s, e, h in zip(part.starts, part.ends, part.hashes, strict=True):
            assert names.setdefault(raw[s:e], h) == h
        sizes += list(part.counts())
        hashes, docs = w.shingles(part, width)
        _, owner = w.distinct_sorted(hashes, docs, part.n)
        sets += list(np.bincount(owner, minlength=part.n))
    assert len(set(names.values())) == len(names)
    assert sizes == [len(words(t)) for t in texts]
    assert sets == [len(shingle_set(t, width)) for t in texts]
    assert {k.decode() for k in names} == {x for t in texts for x in words(lower(t))}


def brute_form(text):
    ws, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_form_counts(texts):
    got = []
    for part in w.word_slices(pa.array(texts, pa.string()), lower=False):
        f = textstats.form(part)
        got += list(zip(*(f[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")), strict=True))
    assert got == [brute_form(t) for t in texts]


def test_slices_do_not_change_hashes(monkeypatch):
    texts = [f"some words {i} and more of them" for i in range(50)]
    whole = np.concatenate([p.hashes for p in w.word_slices(pa.array(texts), lower=True)])
    monkeypatch.setattr(w, "SLICE_BYTES", 40)
    assert (np.concatenate([p.hashes for p in w.word_slices(pa.array(texts), lower=True)]) == whole).all()
