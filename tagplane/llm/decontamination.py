"""Benchmark decontamination by template canonicalisation.

Words are stripped of outer punctuation and lower-cased; numbers, units and names become typed
placeholders and their values slots. Windows of such words are hashed and joined with the windows of
the benchmark items. The windows that a document shares with an item form runs (one alignment, document position
minus item position), and runs form chains: they rise in the document and in the item, with at most ``GAP`` words
between two. The slot values of a chain must map one to one: `Ann has 3 apples` in the benchmark and `Bob has 7
apples` in a document are the same question, `3 and 3` against `7 and 8` are not, wherever in the chain
they stand; of a chain that contradicts itself the windows without slots count. A document leaks an item if a
chain covers ``COVERAGE`` of the item's words.

A capitalised word that opens a text or a sentence may be a name or not, so windows with such a word
are made in both readings. Beside the template windows there is one of plain lower-case words at each
position, which holds whatever the case of its letters and however many slots it has; half of the words
of a template window, and three at least, are plain, since fewer would match anything. A window has a third of the words
of its item, from ``LEAST`` to ``WIDTH`` (an item with fewer is one window), so that one edited word does
not break all windows of a short item. An item of fewer than ``LEAST`` words stands in any text, so it leaks only into
texts of which it is a quarter. Before the join, a bitmap of fixed size (2 MB, whatever the size
of the benchmark) tells which windows can be in the benchmark at all; a window that very many items
share is a skewed key that adaptive execution splits. Equal rows of the join are one before they are dealt by document.

Defined cases: null or wordless texts and items have no windows and leak nothing; texts are read whole;
repeated rows of one id count as one document; items that share an id are compared each by itself and
reported by their best; ids that are null are left out of the pairs (and such documents stay in the
pipeline); empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.llm.common import checkpoint, table
from tagplane.llm.words import U64, Words, bare_spans, lowered, mix, rolling_hashes, span_hashes, word_slices

WIDTH, LEAST = 8, 4
#: Words that a document or an item may have between two runs of a chain.
GAP = 8
#: The part of a text that an item of fewer than LEAST words must be.
SHORT_SHARE = 0.25
#: Least share of an item's words that windows must cover.
COVERAGE = 0.5
BITS = 24
#: Units of measurement and money, lower case.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t gram grams kilogram kilograms ton tons tonne tonnes oz lb lbs ounce ounces pound pounds ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent degrees degree mph kmh watts watt volts volt"
).split()
_DIGIT, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_STOP[[33, 46, 58, 63]] = True
NUMBER, UNIT, NAME = U64(0x11), U64(0x22), U64(0x33)
WINDOW_SCHEMA = "id long, pos long, width int, window long, slots array<long>, n_words long"


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(span_hashes(data, ends - np.array([len(u) for u in UNITS]), ends))


_UNITS = _unit_hashes()


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its hash, the hash with placeholders, whether it is a slot, and whether it is a
    capitalised opener, which may be a name or not."""
    data = words.data
    starts, ends = bare_spans(words)
    value = span_hashes(lowered(data), starts, ends)
    kind = value.copy()
    number = _DIGIT[data[starts]]
    unit = _UNITS[np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)] == value
    inside = np.zeros(len(starts), bool)
    if len(starts):
        inside[1:] = (words.doc[1:] == words.doc[:-1]) & ~_STOP[data[words.ends[:-1] - 1]]
    capital = _UPPER[data[starts]] & ~unit
    name = inside & capital
    kind[name] = NAME
    kind[unit] = UNIT
    kind[number] = NUMBER
    return value, kind, number | unit | name, capital & ~inside


def window_width(n_words: np.ndarray) -> np.ndarray:
    """Words in the windows of an item with so many."""
    return np.minimum(n_words, np.clip(n_words // 3, LEAST, WIDTH))


def windows(words: Words, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First words and hashes of the windows of each reading, with the hash of each word and whether it is a slot."""
    value, kind, slot, opener = canonical(words)
    n = len(value) - width + 1
    if n <= 0:
        return
    inside = words.doc[width - 1 :] == words.doc[:n]
    count = lambda flags: (lambda c: c[width:] - c[:-width])(np.concatenate([[0], np.cumsum(flags)]))
    plain = max(3, width // 2)
    named, both = np.where(opener, NAME, kind), slot | opener
    readings = (
        (value, np.zeros(len(value), bool), inside),
        (kind, slot, inside & (count(slot) > 0) & (count(~slot) >= plain)),
        (named, both, inside & (count(opener) > 0) & (count(~both) >= plain)),
    )
    for hashes, slots, open_ in readings:
        at = np.flatnonzero(open_)
        yield at, mix(rolling_hashes(hashes, width)[at] + U64(width)), value, slots


def _slots(at: np.ndarray, width: int, value: np.ndarray, slot: np.ndarray) -> pa.Array:
    where = at[:, None] + np.arange(width)
    is_slot = slot[where] if len(at) else np.zeros((0, width), bool)
    bounds = np.concatenate([[0], np.cumsum(is_slot.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value[where][is_slot].view(np.int64) if len(at) else [], pa.int64()))


def window_rows(texts: DataFrame, key: str, widths: tuple[int, ...], own_width: bool = False, bitmap: bytes | None = None) -> DataFrame:
    """Windows of each text; with ``own_width`` only those of the width of its number of words, with a bitmap only those whose bit is set."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)  # 2 ** BITS bits
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared.value is None else np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for words in word_slices(batch.column(1), lower=False):
                ids = batch.column(0).slice(words.first, words.n).to_numpy()
                counts = words.counts()
                firsts = np.concatenate([[0], np.cumsum(counts)])
                for width in widths:
                    for at, window, value, slot in windows(words, width):
                        hit = np.ones(len(at), bool)
                        if own_width:
                            hit = window_width(counts[words.doc[at]]) == width
                        if bits is not None:
                            spot = (window >> U64(64 - BITS)).astype(np.int64)
                            hit &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                        at, window = at[hit], window[hit]
                        if len(at):
                            doc = words.doc[at]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids[doc]), pa.array(at - firsts[doc]), pa.array(np.full(len(at), width, np.int32)), pa.array(window.view(np.int64)), _slots(at, width, value, slot), pa.array(counts[doc])],
                                ["id", "pos", "width", "window", "slots", "n_words"],
                            )

    return rows.mapInArrow(cut, WINDOW_SCHEMA)


def _bitmap(item_windows: DataFrame) -> bytes:
    """One bit for the top BITS bits of each window hash; 2 ** BITS / 8 bytes."""
    spot = F.shiftrightunsigned("window", 64 - BITS)
    pages = (
        item_windows.select(spot.alias("spot"))
        .groupBy(F.shiftright("spot", 15).alias("page"))
        .agg(F.bitmap_construct_agg(F.col("spot").bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
        .collect()
    )
    out = bytearray(1 << (BITS - 3))
    for r in pages:
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = bytes(r["bits"])
    return bytes(out)


@dataclass
class Run:
    """Windows of one alignment in a row: where they begin and end in the item, the shift, their slots."""

    shift: int
    first: int
    last: int  # first item words of the first and the last window
    starts: list[int]
    plain: list[int]  # windows without slots
    slots: set[tuple[int, int]]


def runs(pos: Sequence[int], item_pos: Sequence[int], pairs: Sequence[Sequence[tuple[int, int]]], width: int) -> list[Run]:
    """Windows of a document and an item as runs: windows of one shift that overlap or touch."""
    out: list[Run] = []
    for k in sorted(range(len(pos)), key=lambda k: (pos[k] - item_pos[k], item_pos[k])):
        shift = pos[k] - item_pos[k]
        if not out or out[-1].shift != shift or item_pos[k] > out[-1].last + width:
            out.append(Run(shift, item_pos[k], item_pos[k], [], [], set()))
        run = out[-1]
        run.last = item_pos[k]
        (run.starts if pairs[k] else run.plain).append(item_pos[k])
        run.slots.update(pairs[k])
    return sorted(out, key=lambda r: (r.first + r.shift, r.first))


def chain(found: list[Run], width: int, plain: bool) -> tuple[int, list[Run]]:
    """Most item words that runs cover which rise in the document and in the item without a wide gap, and
    these runs. ``plain`` leaves windows with slots out."""
    kept = [r for r in found if r.plain] if plain else found
    ends = [max(r.plain) if plain else r.last for r in kept]
    begins = [min(r.plain) if plain else r.first for r in kept]
    own = [len({w for q in (r.plain if plain else [*r.plain, *r.starts]) for w in range(q, q + width)}) for r in kept]
    best, back = list(own), [-1] * len(kept)
    order = sorted(range(len(kept)), key=lambda k: begins[k] + kept[k].shift)
    at = [begins[k] + kept[k].shift for k in order]
    # A run ends at most so far after it begins.
    longest = max((ends[k] - begins[k] for k in order), default=0) + width + GAP
    for n, k in enumerate(order):
        r = kept[k]
        for i in order[bisect_left(at, at[n] - longest) : n]:
            p = kept[i]
            between = begins[k] - ends[i] - width, begins[k] + r.shift - ends[i] - p.shift - width
            rises = begins[i] < begins[k] and ends[i] < ends[k] and ends[i] + p.shift < ends[k] + r.shift and begins[i] + p.shift < begins[k] + r.shift
            if rises and max(between) <= GAP:
                covered = best[i] + own[k] + min(between[0], 0)  # words under both count once
                if covered > best[k]:
                    best[k], back[k] = covered, i
    if not kept:
        return 0, []
    k = max(order, key=lambda k: best[k])
    covered, out = best[k], []
    while k >= 0:
        out.append(kept[k])
        k = back[k]
    return covered, out[::-1]


def one_to_one(slots: set[tuple[int, int]]) -> bool:
    return len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots})


def best_chain(found: list[Run], width: int) -> tuple[int, list[Run], bool]:
    """Covered words, runs and whether slots count: the chain of all windows if its slots map one to one, else that of plain ones."""
    covered, out = chain(found, width, False)
    if one_to_one({x for r in out for x in r.slots}):
        return covered, out, True
    return *chain(found, width, True), False


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots, exact, first_word for each pair that leaks."""
    known = checkpoint(items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct())
    keyed = known.withColumn("key", F.xxhash64("item_id", "text"))
    item_windows = checkpoint(window_rows(keyed, "key", tuple(range(1, WIDTH + 1)), own_width=True))
    used = sorted(r["width"] for r in item_windows.select("width").distinct().collect())  # WIDTH values at most
    if not used:
        used = [WIDTH]
    found = window_rows(docs, "doc_id", tuple(used), bitmap=_bitmap(item_windows)).drop("width").withColumnRenamed("n_words", "doc_words")
    theirs = item_windows.select(F.col("id").alias("key"), F.col("pos").alias("item_pos"), "width", "window", F.col("slots").alias("item_slots"), "n_words")
    met = found.join(theirs, "window").where(F.size("slots") == F.size("item_slots")).where((F.col("n_words") >= LEAST) | (F.col("n_words") >= SHORT_SHARE * F.col("doc_words")))
    lined = met.select(F.col("id").alias("doc_id"), "key", "pos", "item_pos", "width", "n_words", "slots", "item_slots").distinct()
    dealt = lined.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def judged(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            width, n_words = rows[0]["width"], rows[0]["n_words"]
            pairs = [list(zip(r["slots"], r["item_slots"], strict=True)) for r in rows]
            covered, out, slotted = best_chain(runs([r["pos"] for r in rows], [r["item_pos"] for r in rows], pairs, width), width)
            if covered and covered >= coverage * n_words:
                slots = {x for r in out for x in r.slots} if slotted else set()
                n_windows = len({q for r in out for q in ([*r.plain, *r.starts] if slotted else r.plain)})
                first = min(q + r.shift for r in out for q in ([*r.plain, *r.starts] if slotted else r.plain))
                row = {"doc_id": rows[0]["doc_id"], "key": rows[0]["key"], "n_windows": n_windows, "coverage": covered / n_words, "n_slots": len(slots), "exact": all(a == b for a, b in slots), "first_word": first}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_windows", pa.int64()), ("coverage", pa.float64()), ("n_slots", pa.int32()), ("exact", pa.bool_()), ("first_word", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if waiting and (row["doc_id"], row["key"]) != (waiting[0]["doc_id"], waiting[0]["key"]):
                    yield from judged(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield from judged(waiting)

    good = dealt.mapInArrow(chains, "doc_id long, key long, n_windows long, coverage double, n_slots int, exact boolean, first_word long").join(keyed.select("key", "item_id"), "key")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_windows", "n_slots", "exact", (-F.col("first_word")).alias("before"))).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.coverage", "best.n_slots", "best.exact", (-F.col("best.before")).alias("first_word"))


def op8_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that leak no benchmark item."""
    bad = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak_id")).distinct()
    return docs.join(bad, docs.doc_id == bad._leak_id, "left_anti").select(*docs.columns)
