"""License scans by patience alignment.

A notice is found by aligning the words of a template with the words of a text: words that are unique
on both sides are anchors, their longest increasing subsequence is the skeleton, and the gaps between
anchors are aligned the same way until nothing is left. The share of the template's words that the
alignment covers decides.

Only stretches of a text around a template's rarer words can hold it, so each text is first reduced,
in arrays, to such stretches; a stretch is read whole. Words are lower-cased and lose punctuation.

Notices of different licenses have much wording in common, and a share of covered words cannot tell versions
apart. So each license has words that must be aligned (its version, its kind) and words that must not stand
in the stretch (those of its kin). Of matches that overlap in a text the one
with the best coverage stands (ties: the one with more words, then the first name).

Defined cases: null and wordless texts hold nothing; texts are read whole; a text with several notices
of one kind is reported once, with the best coverage and the first place (ties: the first); repeated
rows are repeated in the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.llm.common import table
from tagplane.llm.words import Words, bare_spans, lowered, span_hashes, word_slices

#: Public license notices.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
    ),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.", "Licensed under the Apache Software License, Version 1.1."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-1.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 1, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
}
_GNU_KINDS, _CC_KINDS = "lesser library affero", "nc nd sa noncommercial noderivatives noderivs sharealike"
#: Of each license the words that tell it from others. Where a template has one of the first, it
#: must be aligned; a stretch with one of the second is another license.
TELLING = {
    "MIT": ("mit", ""), "Apache-2.0": ("apache 2.0", ""), "Apache-1.1": ("apache 1.1", ""), "MPL-2.0": ("mozilla 2.0", ""), "BSL-1.0": ("boost 1.0", ""),
    "GPL-3.0": ("gnu general public 3", _GNU_KINDS), "GPL-2.0": ("gnu general public 2", _GNU_KINDS), "GPL-1.0": ("gnu general public 1", _GNU_KINDS),
    "LGPL-3.0": ("lesser general public 3", ""), "LGPL-2.1": ("lesser general public 2.1", ""), "AGPL-3.0": ("affero general public 3", ""),
    "CC-BY-4.0": ("attribution by 4.0", _CC_KINDS), "CC-BY-SA-4.0": ("attribution-sharealike by-sa 4.0", _CC_KINDS), "CC-BY-ND-4.0": ("attribution-noderivatives by-nd 4.0", _CC_KINDS),
    "CC-BY-NC-4.0": ("attribution-noncommercial by-nc 4.0", _CC_KINDS), "CC-BY-NC-SA-4.0": ("attribution-noncommercial-sharealike by-nc-sa 4.0", _CC_KINDS),
    "CC-BY-NC-ND-4.0": ("attribution-noncommercial-noderivatives by-nc-nd 4.0", _CC_KINDS), "CC0-1.0": ("waived copyright", ""), "BSD-3-Clause": ("neither endorse", ""),
}
#: A text with the first of these has the second one in it, which is then not reported by itself.
CONTAINS = {"BSD-3-Clause": "BSD-2-Clause"}
#: Words too common to start a stretch.
COMMON = frozenset("a an and any are as at be by for from in is it its no not of on or that the this to under use with you without".split())
COVERAGE = 0.8
_PUNCT = re.compile(r"^[^\w]+|[^\w]+$")


def plain(word: str) -> str:
    return _PUNCT.sub("", word.lower()) or word


@dataclass(frozen=True)
class Template:
    license: str
    text: str

    @cached_property
    def words(self) -> list[str]:
        return [plain(w) for w in self.text.split()]

    @cached_property
    def needed(self) -> frozenset[int]:
        """Places of the template that must be aligned."""
        own = set(TELLING.get(self.license, ("", ""))[0].split())
        return frozenset(j for j, w in enumerate(self.words) if w in own)

    @cached_property
    def barred(self) -> frozenset[str]:
        """Words that make a stretch another license."""
        return frozenset(TELLING.get(self.license, ("", ""))[1].split())

    def told(self, text: Sequence[str], pairs: list[tuple[int, int]], first: int, last: int) -> bool:
        """Whether an aligned stretch of a text is this license and not one much like it."""
        held = {j for i, j in pairs if first <= i <= last}
        return self.needed <= held and not self.barred.intersection(text[first : last + 1])

    @cached_property
    def seeds(self) -> list[str]:
        return sorted(set(self.words) - COMMON)

    @cached_property
    def least_seeds(self) -> int:
        """Different seed words that any stretch with enough coverage has."""
        return max(1, len(self.seeds) - int((1 - COVERAGE) * len(self.words) + 1e-9))


TEMPLATES = tuple(Template(name, text) for name, texts in NOTICES.items() for text in texts)


def rising(values: Sequence[int]) -> list[int]:
    """Indices of a longest increasing subsequence: piles with back links."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = last[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[p], last[p] = v, i
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of matched words, rising on both sides."""
    found: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        often_a, often_b = Counter(text[a0:a1]), Counter(template[b0:b1])
        where = {w: j for j, w in enumerate(template[b0:b1], b0) if often_b[w] == 1}
        both = [(i, where[w]) for i, w in enumerate(text[a0:a1], a0) if often_a[w] == 1 and w in where]
        anchors = [both[k] for k in rising([j for _, j in both])]
        if not anchors:
            # Words that repeat in a gap: take the template's next word where it comes first.
            places: dict[str, list[int]] = {w: [] for w in often_b}
            for i in range(a0, a1):
                if text[i] in places:
                    places[text[i]].append(i)
            at = a0
            for j in range(b0, b1):
                own = places[template[j]]
                k = bisect_left(own, at)
                if k < len(own):
                    found.append((own[k], j))
                    at = own[k] + 1
            continue
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def best_run(pairs: list[tuple[int, int]], n_template: int) -> tuple[int, int, int]:
    """Most matched words without a wide gap in the text, and the first and last of them."""
    gap = max(4, n_template // 4)
    best, start = (0, 0, 0), 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] - pairs[k - 1][0] > gap:
            if k - start > best[0]:
                best = (k - start, pairs[start][0], pairs[k - 1][0])
            start = k
    return best


def _normal(words: Words) -> np.ndarray:
    """Hash of each word, lower-cased (beyond ASCII: as it is) and without outer punctuation."""
    starts, ends = bare_spans(words, 4)
    return span_hashes(lowered(words.data), starts, ends)


def _hash_words(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    return span_hashes(data, ends - np.array([len(w) for w in raw]), ends)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word for each text and license that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.unique(np.concatenate([_hash_words(t.seeds) for t in templates]))
        seeds = [np.unique(_hash_words(t.seeds)) for t in templates]
        for batch in batches:
            out = []
            for words in word_slices(batch.column(1), lower=False):
                hashes = _normal(words)
                near = vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes
                spots = np.flatnonzero(near)
                firsts = np.concatenate([[0], np.cumsum(words.counts())])
                for t, own in zip(templates, seeds, strict=True):
                    out += _stretches(words, hashes, spots, firsts, t, own)
            best: dict[tuple[int, str], tuple] = {}
            taken: dict[int, list[tuple[str, int, int]]] = {}
            # The best matches first; a later one that overlaps a better one of another license falls away.
            for row, name, share, lo, hi in sorted((x for x in out if x[2] >= coverage), key=lambda x: (x[0], -x[2], x[3] - x[4], x[1], x[3])):
                spans = taken.setdefault(row, [])
                if any(other != name and a <= hi and lo <= b for other, a, b in spans):
                    continue
                spans.append((name, lo, hi))
                if (row, name) not in best or (-share, lo) < (-best[row, name][0], best[row, name][1]):
                    best[row, name] = (share, lo, hi)
            keys = sorted(k for k in best if not any(inner == k[1] and (k[0], outer) in best for outer, inner in CONTAINS.items()))
            if keys:
                ids = batch.column(0).take(pa.array([k[0] for k in keys]))
                cols = list(zip(*(best[k] for k in keys), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([k[1] for k in keys]), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                    ["doc_id", "license", "coverage", "first_word", "last_word"],
                )

    return rows.mapInArrow(find, "doc_id long, license string, coverage double, first_word long, last_word long")


def _stretches(words: Words, hashes: np.ndarray, spots: np.ndarray, firsts: np.ndarray, t: Template, own: np.ndarray) -> list[tuple]:
    """(row, license, coverage, first word, last word) of each stretch that has enough seeds of a template."""
    mine = spots[np.isin(hashes[spots], own)]
    if not len(mine):
        return []
    reach = len(t.words)
    doc = words.doc[mine]
    breaks = np.flatnonzero((np.diff(mine) > reach) | (np.diff(doc) != 0)) + 1
    out = []
    for lo, hi in zip([0, *breaks], [*breaks, len(mine)], strict=True):
        if hi - lo < t.least_seeds or len(np.unique(hashes[mine[lo:hi]])) < t.least_seeds:
            continue
        d = doc[lo]
        a, b = max(firsts[d], mine[lo] - reach), min(firsts[d + 1], mine[hi - 1] + reach + 1)
        text = [plain(bytes(words.data[words.starts[i] : words.ends[i]]).decode("utf-8", "replace")) for i in range(a, b)]
        pairs = align(text, t.words)
        n, first, last = best_run(pairs, len(t.words))
        if n and t.told(text, pairs, first, last):
            start = int(a - firsts[d])
            out.append((words.first + int(d), t.license, n / len(t.words), start + first, start + last))
    return out


def op6_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
