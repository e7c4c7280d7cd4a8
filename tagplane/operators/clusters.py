"""Single-linkage clusters of two-dimensional boxes.

Boxes are half-open and hold a base at least. Two boxes are linked if they are less than the tolerance apart
in both directions, which is so if they overlap once each is made longer by the tolerance at its upper ends;
such rectangles are meant below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagplane.functions.graph import checkpoint, components, written
from tagplane.functions.packed import packed, unpacked

KEYS = ("anchor_chr", "target_chr")
SIDES = ("a", "t")


def _bits(size: Column) -> Column:
    """The power of two that is the largest within a size."""
    return F.length(F.bin(size)) - 1


def _rectangles(boxes: DataFrame, tol: int) -> DataFrame:
    """box_id, chromosomes, lo and hi in both directions."""
    return boxes.select("box_id", *KEYS, *[c for s in SIDES for c in (F.col(f"start_{s}").cast("long").alias(f"lo_{s}"), (F.col(f"end_{s}") + tol).cast("long").alias(f"hi_{s}"))])


def _in_cells(rows: DataFrame, levels: list[int], lower: bool) -> DataFrame:
    """The rows once for each level at or above (``lower``) or at or below their own, and each cell that they touch.

    Cells are squares as wide as the higher level of both, so that a row touches few of them.
    """
    known = F.array(*[F.lit(x) for x in levels])
    out = rows.withColumn("_other", F.explode(F.filter(known, lambda x: (x >= F.col("level")) if lower else (x <= F.col("level")))))
    low, high = ("level", "_other") if lower else ("_other", "level")
    out = out.withColumns({"_low": F.col(low), "_high": F.col(high)}).drop("_other")
    for s in SIDES:
        out = out.withColumn(f"_cell_{s}", F.explode(F.sequence(F.call_function("shiftright", f"lo_{s}", "_high"), F.call_function("shiftright", F.col(f"hi_{s}") - 1, "_high"))))
    return out


def _meetings(rows: DataFrame, order: str) -> DataFrame:
    """Each two rows that overlap, once: columns of the one of the lower level as they are, of the other with
    ``o_``. Of one level, the one with the lower ``order`` is the first. A level is a power of two of the
    longer side; two rows are met in the cell in which their overlap begins."""
    rows = checkpoint(rows.withColumn("level", _bits(F.greatest(*[F.col(f"hi_{s}") - F.col(f"lo_{s}") for s in SIDES]))))
    levels = sorted(r[0] for r in rows.select("level").distinct().collect()) or [0]  # powers of two
    own = [c for c in rows.columns if c not in KEYS]
    right = _in_cells(rows, levels, False).select(*KEYS, "_low", "_high", "_cell_a", "_cell_t", *[F.col(c).alias(f"o_{c}") for c in own])
    met = _in_cells(rows, levels, True).join(right, [*KEYS, "_low", "_high", "_cell_a", "_cell_t"]).where((F.col("_low") < F.col("_high")) | (F.col(order) < F.col(f"o_{order}")))
    for s in SIDES:
        met = met.where((F.col(f"lo_{s}") < F.col(f"o_hi_{s}")) & (F.col(f"o_lo_{s}") < F.col(f"hi_{s}")))
        met = met.where(F.col(f"_cell_{s}") == F.call_function("shiftright", F.greatest(f"lo_{s}", f"o_lo_{s}"), "_high"))
    return met.select(*KEYS, *own, *[f"o_{c}" for c in own])


#: Tiles of the lowest level are 2 ** 11 bases wide, those of each next one 16 times as wide.
TILE_BITS, TILE_STEP = 11, 4
#: Strips are 2 ** 9 bases wide; those of a tile are read together until they have so many boxes.
STRIP_BITS, READ = 9, 1024
TILE = (*KEYS, "tile_level", "tile_a", "tile_t")
PLACES = ("lo_a", "hi_a", "lo_t", "hi_t")
#: Boxes that are compared at once with those before them, times those.
MOST_CELLS = 4_000_000


def _in_tiles(boxes: DataFrame, tol: int) -> tuple[DataFrame, int]:
    """The rectangles once for each tile that they touch, of their own level and of those above that have boxes,
    and the highest level."""
    rows = _rectangles(boxes, tol).withColumn("level", tile_level(F.greatest(*[F.col(f"hi_{s}") - F.col(f"lo_{s}") for s in SIDES])))
    levels = sorted(r[0] for r in rows.select("level").distinct().collect())  # fourteen at most
    dealt = rows.withColumn("tile_level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("level"))))
    for s in SIDES:
        dealt = dealt.withColumn(f"tile_{s}", F.explode(F.sequence(F.call_function("shiftright", f"lo_{s}", "tile_level"), F.call_function("shiftright", F.col(f"hi_{s}") - 1, "tile_level"))))
    return dealt.select(*TILE, "box_id", *PLACES, "level"), max(levels, default=0)


def box_links(boxes: DataFrame, tol: int) -> DataFrame:
    """(a, b), a < b: boxes of one chromosome pair less than ``tol`` apart in both directions.

    A box is dealt to the tiles that it touches, of its own level and of those above that have boxes: few rows,
    as tiles are wide, and packed by tile and strip of its bases before they are. A task sweeps a tile strip by
    strip from its first base to its last and holds the boxes that go on; the links are its output and are not
    dealt again. Two boxes are linked in the tile in which their overlap begins. A box that is given more than
    once is met in its strip, where it counts once.
    """
    dealt = _in_tiles(boxes, tol)[0].where(" and ".join(f"{c} is not null" for c in KEYS)).withColumn("strip", F.call_function("shiftright", "lo_a", F.lit(STRIP_BITS)))
    values = ("box_id", *PLACES, "level")
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = packed(dealt, (*TILE, "strip"), values).repartition(tasks, *TILE).sortWithinPartitions(*TILE, "strip")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, n, open_ = None, [], 0, None

        def swept() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, n, open_
            new, k = _once(np.concatenate(waiting, axis=1)), 0
            waiting, n = [], 0
            while k < new.shape[1]:
                open_ = open_[:, open_[2] > new[1, k]]
                now = new[:, k : k + min(256, max(1, MOST_CELLS // (open_.shape[1] + 256)))]
                k += now.shape[1]
                open_ = np.concatenate([open_, now], axis=1)
                yield from _links_in(at, now, open_)

        for batch in batches:
            places = list(zip(*[batch.column(c).to_pylist() for c in (*TILE, "strip")], strict=True))
            turns = [0, *[k for k in range(1, len(places)) if places[k] != places[k - 1]], len(places)]
            for i, j in zip(turns[:-1], turns[1:], strict=True):
                if i == j:
                    continue
                if places[i] != at:
                    turned = at is None or places[i][:-1] != at[:-1]
                    if n and (turned or n >= READ):
                        yield from swept()
                    if turned:
                        open_ = np.zeros((6, 0), dtype=np.int64)
                    at = places[i]
                waiting.append(unpacked(batch.slice(i, j - i), len(values)))
                n += waiting[-1].shape[1]
        if n:
            yield from swept()

    return ordered.mapInArrow(sweep, "a long, b long")


def _once(boxes: np.ndarray) -> np.ndarray:
    """Boxes in order of their first base, each once."""
    boxes = boxes[:, np.lexsort((boxes[0], boxes[1]))]
    return boxes[:, np.concatenate([[True], (boxes[:, 1:] != boxes[:, :-1]).any(axis=0)])]


def tile_level(size: Column) -> Column:
    """Bits of the narrowest tiles that are at least half as wide as a box."""
    steps = F.ceil((F.greatest(F.length(F.bin(F.greatest(size, F.lit(1)) - 1)), F.lit(TILE_BITS + 1)) - TILE_BITS - 1) / TILE_STEP)
    return F.least(TILE_BITS + TILE_STEP * steps, F.lit(62)).cast("int")


def _links_in(tile: tuple, now: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of some boxes with those that began before, the last of which they are themselves."""
    bits, cells = int(tile[2]), {1: int(tile[3]), 3: int(tile[4])}
    one, other = now[:, :, None], met[:, None, :]
    linked = np.arange(met.shape[1])[None, :] < np.arange(met.shape[1] - now.shape[1], met.shape[1])[:, None]
    for lo in (1, 3):
        linked &= (one[lo] < other[lo + 1]) & (other[lo] < one[lo + 1])
    i, j = np.nonzero(linked)
    here = np.maximum(now[5, i], met[5, j]) == bits
    for lo, cell in cells.items():
        here &= np.maximum(now[lo, i], met[lo, j]) >> bits == cell
    a, b = now[0, i[here]], met[0, j[here]]
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


#: Rows of tiles that a task holds before it joins them into components.
HELD = 100_000
#: Links of names up to which they are broadcast.
FEW_NAMES = 500_000
#: A rectangle's group in its chromosome pair: size classes and the first point of their grid that it holds.
GROUP = ("level", "bits_a", "bits_t", "point_a", "point_t")
_NAME, _PLACES, _LEVEL, _TILE, _CHR, _FRESH = 0, (1, 2, 3, 4), 5, (6, 7, 8), (9, 10), 11


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of nodes, the least ones of their components, once nodes ``a`` and ``b`` are linked."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further


def _counted_out(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n[k]`` rows of k: k, and the number of the row."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)


def _chunks(n: np.ndarray) -> Iterator[slice]:
    """Runs of k whose ``n[k]`` rows together are some millions, or one k of more."""
    upto, start = np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + MOST_CELLS, "right")))
        yield slice(start, stop)
        start = stop


def _candidates(tile: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of one tile whose extents overlap in the first direction, one of them at least of the tile's level."""
    n = len(lo)
    order = np.lexsort((lo, tile))
    # Starts before an end, in the order of tiles and places: both are put in order together, an end before a start.
    both = np.lexsort((np.repeat([1, 0], n), np.concatenate([lo, hi]), np.concatenate([tile, tile])))
    ends = np.empty(n, dtype=np.int64)
    ends[both[both >= n] - n] = np.cumsum(both < n)[both >= n]
    for first, others in ((own, np.ones(n, dtype=bool)), (~own, own)):
        at, pool = np.nonzero(first[order])[0], np.nonzero(others[order])[0]
        start, stop = np.searchsorted(pool, at, "right"), np.searchsorted(pool, ends[order[at]], "left")
        count = np.maximum(stop - start, 0)
        for s in _chunks(count):
            k, row = _counted_out(count[s])
            yield order[at[s][k]], order[pool[start[s][k] + row]]


def _ahead(rows: np.ndarray, right: int, up: int) -> tuple[np.ndarray, np.ndarray]:
    """How far rectangles go in both directions."""
    lo_a, hi_a, lo_t, hi_t = (rows[k] for k in _PLACES)
    return hi_a if right else -lo_a, hi_t if up else -lo_t


def _reach(mine: np.ndarray, theirs: np.ndarray, way: int) -> bool:
    """Whether a rectangle of one group overlaps one of a second, which lies ``way`` of it: in order of where
    those of the second begin, the least beginning so far in the other direction decides."""
    (x, y), (u, v) = _ahead(mine, way >> 1, way & 1), (-c for c in _ahead(theirs, 1 - (way >> 1), 1 - (way & 1)))
    order = np.argsort(u)
    before = np.searchsorted(u[order], x, "left")
    least = np.minimum.accumulate(v[order])
    return bool((y[before > 0] > least[before[before > 0] - 1]).any())


def _outermost(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rectangles reach furthest in their group in one of the four ways: no other can lie over a
    rectangle that these do not reach. They are no more than twice their size class for each way."""
    found = np.zeros(rows.shape[1], dtype=bool)
    for way in range(4):
        x, y = _ahead(rows, way >> 1, way & 1)
        order = np.lexsort((-y, -x, group))
        # Ranks, so that those of a later group are above all of the groups before it.
        ranks = group[order] * (len(y) + 1) + np.unique(y, return_inverse=True)[1][order]
        most = np.maximum.accumulate(ranks)
        found[order[np.concatenate([[True], (most[1:] > most[:-1])])]] = True
    return found


def _components_in_tiles(rows: np.ndarray, top: int, chromosomes: list[str]) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """Names of boxes and of groups that other tiles or levels know, and the rows of the last tile that later
    ones of it can meet. Rows are in order of tiles.

    Rectangles of one group hold its point, so they are joined at once. Two groups are joined if two of their
    rectangles overlap: if the points are level in one direction, the extents decide; else what is furthest
    ahead mostly does; and where it does not, and nothing else has joined them, the rectangles are compared.
    """
    where = rows[[*_TILE, *_CHR]]
    alone = (where[3:] < 0).any(axis=0)
    turn = (where[:, 1:] != where[:, :-1]).any(axis=0) | alone[1:] | alone[:-1]
    tile = np.concatenate([[0], np.cumsum(turn)])
    bits, points = [], []
    for lo, hi in ((1, 2), (3, 4)):
        size = rows[hi] - rows[lo]
        k = np.frexp(size.astype(float))[1].astype(np.int64) - 1
        bits.append(k - ((np.int64(1) << k) > size))
        points.append(-(-rows[lo] >> bits[-1]) << bits[-1])
    key = np.stack([rows[_LEVEL], *bits, *points])
    order = np.lexsort((*key[::-1], tile))
    rows, key, tile, alone = rows[:, order], key[:, order], tile[order], alone[order]
    new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0) | (tile[1:] != tile[:-1])])
    group, first = np.cumsum(new) - 1, np.nonzero(new)[0]
    count = np.diff(np.concatenate([first, [len(new)]]))
    lo_a, hi_a, lo_t, hi_t = (f.reduceat(rows[k], first) for k, f in zip(_PLACES, (np.minimum, np.maximum) * 2, strict=True))
    own = rows[_LEVEL, first] == rows[_TILE[0], first]
    best = []
    for way in range(4):
        x, y = _ahead(rows, way >> 1, way & 1)
        at = np.lexsort((x + y, group))[first + count - 1]
        best.append((x[at], y[at]))
    best, at_a, at_t = np.array(best), key[3, first], key[4, first]

    root = np.arange(len(first))
    for i, j in _candidates(tile[first], lo_a, hi_a, own):
        met = (root[i] != root[j]) & (lo_t[i] < hi_t[j]) & (lo_t[j] < hi_t[i])
        i, j = i[met], j[met]
        way = 2 * (at_a[j] >= at_a[i]) + (at_t[j] >= at_t[i])
        sure = (at_a[i] == at_a[j]) | (at_t[i] == at_t[j]) | ((best[way, 0, i] > -best[3 - way, 0, j]) & (best[way, 1, i] > -best[3 - way, 1, j]))
        root = _merged(root, i[sure], j[sure])
        open_ = ~sure & (count[i] * count[j] > 1) & (root[i] != root[j])
        i, j, way = i[open_], j[open_], way[open_]
        many = count[i] * count[j] > MOST_CELLS // 1000
        for p, q, w in zip(i[many], j[many], way[many], strict=True):
            if root[p] != root[q] and _reach(rows[:, first[p] : first[p] + count[p]], rows[:, first[q] : first[q] + count[q]], int(w)):
                root = _merged(root, np.array([p]), np.array([q]))
        i, j = i[~many], j[~many]
        for s in _chunks(count[i] * count[j]):
            p, q = i[s], j[s]
            apart = root[p] != root[q]
            p, q = p[apart], q[apart]
            k, row = _counted_out(count[p] * count[q])
            one, other = rows[:, first[p][k] + row // count[q][k]], rows[:, first[q][k] + row % count[q][k]]
            hit = (one[1] < other[2]) & (other[1] < one[2]) & (one[3] < other[4]) & (other[3] < one[4])
            root = _merged(root, p[k[hit]], q[k[hit]])

    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, root, np.minimum.reduceat(rows[_NAME], first))
    name = least[root]
    with_own = np.zeros(len(first), dtype=bool)
    with_own[root[own]] = True
    level, cell_a, cell_t = (rows[k, first] for k in _TILE)
    home = own & (at_a >> level == cell_a) & (at_t >> level == cell_t)
    inside = (lo_a >> level == cell_a) & ((hi_a - 1) >> level == cell_a) & (lo_t >> level == cell_t) & ((hi_t - 1) >> level == cell_t)
    known = np.where(own, ~home | ~inside | (level < top), with_own[root]) & ~alone[first]
    changed = (rows[_FRESH] == 0) & (rows[_NAME] != name[group])
    known[group[changed]] = True
    known = np.nonzero(known)[0]
    mine = (rows[_FRESH] == 1) & home[group]
    out = [_batch(rows[_NAME, mine], name[group[mine]], None, None, chromosomes)]
    out.append(_batch(None, name[known], rows[:, first[known]], key[:, first[known]], chromosomes))
    out.append(_batch(None, rows[_NAME, changed], rows[:, changed], key[:, changed], chromosomes))

    on = np.nonzero((tile == tile[-1]) & own[group])[0]
    kept = rows[:, on]
    kept[_NAME], kept[_FRESH] = name[group[on]], 0
    return kept[:, _outermost(kept, group[on])] if len(on) else kept, [b for b in out if b.num_rows]


_NAMED = "box_id long, name long, anchor_chr string, target_chr string, level long, bits_a long, bits_t long, point_a long, point_t long"


def _batch(box: np.ndarray | None, name: np.ndarray, rows: np.ndarray | None, key: np.ndarray | None, chromosomes: list[str]) -> pa.RecordBatch:
    n = len(name)
    none = lambda kind: pa.nulls(n, kind)
    columns = [none(pa.int64()) if box is None else pa.array(box), pa.array(name)]
    if rows is None:
        columns += [none(pa.string())] * 2 + [none(pa.int64())] * len(GROUP)
    else:
        columns += [pa.array([chromosomes[c] for c in rows[k]], pa.string()) for k in _CHR] + [pa.array(k) for k in key]
    return pa.RecordBatch.from_arrays(columns, ["box_id", "name", *KEYS, *GROUP])


def _named(boxes: DataFrame, tol: int, held: int) -> DataFrame:
    """Components within tiles: for each box the least box of its component in the tile that holds its point, and
    for each group that more than one tile or level sees, its name in each of these."""
    dealt, top = _in_tiles(boxes, tol)
    # The boxes of the tile's own level come first: the others meet those alone, and need not be held.
    ordered = dealt.repartition(*TILE).sortWithinPartitions(*TILE, F.desc("level"), "box_id")

    def knit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}

        def coded(column: pa.Array) -> np.ndarray:
            column = column.dictionary_encode()
            known = np.array([-1 if v is None else codes.setdefault(v, len(codes)) for v in column.dictionary.to_pylist()] + [-1], dtype=np.int64)
            return known[column.indices.fill_null(-1).to_numpy(zero_copy_only=False)]

        kept, waiting, n = np.zeros((12, 0), dtype=np.int64), [], 0
        last = np.full((12, 1), -2, dtype=np.int64)
        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("box_id", *PLACES, "level", *TILE[2:])]
            rows = np.stack([*numbers, *[coded(batch.column(c)) for c in KEYS], np.ones(batch.num_rows, dtype=np.int64)])
            both = np.concatenate([last, rows], axis=1)
            again = (both[:, 1:] == both[:, :-1]).all(axis=0)
            last = both[:, -1:]
            waiting.append(rows[:, ~again])
            n += waiting[-1].shape[1]
            if n >= max(held, kept.shape[1]):
                kept, out = _components_in_tiles(np.concatenate([kept, *waiting], axis=1), top, list(codes))
                yield from out
                waiting, n = [], 0
        if n:
            yield from _components_in_tiles(np.concatenate([kept, *waiting], axis=1), top, list(codes))[1]

    return ordered.mapInArrow(knit, _NAMED)


def cluster_boxes(boxes: DataFrame, tol: int, held: int = HELD) -> DataFrame:
    """box_id, cluster_id: the least box of each cluster names it; a box without links is its own. A box that is
    given more than once is put out once.

    A side of 2 ** k bases, and less than twice as many, holds a multiple of 2 ** k; the first ones in both
    directions are a rectangle's point. Those of one point and size class overlap each other: they are one group
    before any two are compared. Boxes are dealt once, to the tiles that they touch, and joined there; pairs of
    groups live in a task only. What is stored is a name for each box; and as a group is one component wherever
    it is seen, the names that its tiles give it are linked, which are few beside the boxes.
    """
    named = written(_named(boxes, tol, held), "box-names")
    key = (*KEYS, *GROUP)
    seen = named.where("box_id is null").select(*key, "name").distinct()
    links = seen.select(F.col("name").alias("a"), F.min("name").over(Window.partitionBy(*key)).alias("b")).where("a <> b")
    found = components(links)
    if found.count() <= FEW_NAMES:
        found = F.broadcast(found)
    return named.where("box_id is not null").join(found, F.col("name") == F.col("node"), "left").select("box_id", F.coalesce("component", "name").alias("cluster_id"))
