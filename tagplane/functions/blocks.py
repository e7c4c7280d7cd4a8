"""Counts of points by region from tables of running sums, for blocks of neighbouring regions.

A tag that begins at u and is ``ext`` long overlaps a region from start to end if u lies in [start - ext + 1, end].
So regions are intervals of u, and how many points lie in an interval (or in two, by both ends) is a difference
of running sums. Work follows the points and the regions (or their pairs), not the hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tagplane.functions.graph import checkpoint
from tagplane.functions.intervals import bin_level
from tagplane.functions.ordered import cumulated
from tagplane.functions.packed import packed, unpacked

#: A block has so many regions, twice as many at most, or those that begin within twice as many bases. Where regions
#: lie thick, blocks do not get more or smaller with their number, and a point goes to as many as before.
REGIONS_PER_BLOCK = 1024
#: The same for counts of ends, whose tasks hold tables of all libraries.
REGIONS_PER_END_BLOCK = 256
#: Narrower regions than 2 ** 11 bases share blocks.
LEAST_BITS = 11
#: Cells of a task's tables of running sums, of all libraries, but for those of 2304 rows, which always are made at once.
MOST_CELLS, LEAST_ROWS = 1 << 26, 2304
#: Pairs of regions that are counted at once.
PAIRS = 1 << 18
#: Tasks at most; a task takes its blocks, or pairs of blocks, one after the other.
MOST_TASKS = 1024
#: The kind of the row with a block's regions, which comes before those of the libraries.
HEAD = -1


def blocks(regions: DataFrame, ext: int, size: int = REGIONS_PER_BLOCK) -> DataFrame:
    """block, chr, lo, hi and members, an array of the ids, the los and the his of regions that are neighbours and of
    similar width.

    Regions are dealt to cells of ``2 * size`` bases by where they begin, and wide ones by where they end too. A cell with
    more than ``size`` regions is a block; others are put together in order. So a block has ``4 * size`` places at most,
    or those of one or two cells, and of narrow regions few blocks lie over a base, however many regions there are.
    """
    spans = regions.select("region_id", "chr", (F.col("start") - (ext - 1)).cast("long").alias("lo"), F.col("end").cast("long").alias("hi")).where("lo <= hi and hi >= 1 and chr is not null")
    spans = spans.withColumn("level", F.greatest(bin_level(F.col("hi") - F.col("lo") + 1), F.lit(LEAST_BITS)))
    cell = lambda c: F.floor(F.col(c) / (2 * size))
    where = ("chr", "level", "cell", "last")
    cells = spans.withColumns({"cell": cell("lo"), "last": F.when(F.col("level") > LEAST_BITS, cell("hi")).otherwise(cell("lo"))}).groupBy(*where).agg(
        F.min("region_id").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("lo", "hi", "region_id")).alias("m"), F.count("*").alias("n")
    )
    placed = cumulated(cells, where, "n", "upto")
    full = lambda c: F.when(F.col("n") > size, F.col(c))
    grouped = placed.groupBy("chr", "level", F.floor((F.col("upto") - F.col("n")) / size), full("cell"), full("last")).agg(
        F.min("first").alias("block"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.flatten(F.collect_list("m"))).alias("m")
    )
    return checkpoint(grouped.select("block", "chr", "lo", "hi", F.concat(F.col("m.region_id").cast("array<long>"), "m.lo", "m.hi").alias("members")))


def in_order(rows: DataFrame, keys: tuple[str, ...], tasks: int) -> DataFrame:
    """The rows of a key together in a task, by kind. Arrays are empty and not null then, since Spark asks the size of
    an Arrow batch at each row, which passes over all null lists at the end of the batch."""
    dealt = rows.repartition(max(1, min(tasks, MOST_TASKS)), *keys).sortWithinPartitions(*keys, "kind")
    return dealt.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in rows.schema if isinstance(f.dataType, ArrayType)})


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Key, kind and slice of each run of rows that are alike in both; a long run comes in several slices."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "kind")])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield tuple(marks[:-1, i].tolist()), int(marks[-1, i]), batch.slice(i, j - i)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def members(head: pa.RecordBatch, name: str = "members") -> list[np.ndarray]:
    """ids, los, his of the block in a head row."""
    return np.split(np.array(head.column(name)[0].values.to_numpy(zero_copy_only=False), dtype=np.int64), 3)


class Inside:
    """How many pairs of places lie in an interval with both ends, for intervals from known beginnings to known ends."""

    def __init__(self, los: np.ndarray, his: np.ndarray) -> None:
        self.los, self.his = np.unique(los), np.unique(his)
        self.cells = np.zeros((len(self.los) + 1, len(self.his) + 1), dtype=np.int64)

    def add(self, least: np.ndarray, most: np.ndarray) -> None:
        np.add.at(self.cells.reshape(-1), np.searchsorted(self.los, least, "right") * self.cells.shape[1] + np.searchsorted(self.his, most, "left"), 1)

    def counts(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of places of beginnings and ends; an interval that ends before it begins holds none."""
        sums = np.cumsum(np.cumsum(self.cells[::-1], axis=0)[::-1], axis=1)
        return lambda lo, hi: sums[lo + 1, hi]


class Cells:
    """Points by the cells between cuts in which both of their places lie: each cell once, in order, with its number."""

    def __init__(self, cuts: tuple[np.ndarray, np.ndarray]) -> None:
        self.cuts, self.across = cuts, len(cuts[1]) + 1
        self.cell = self.times = np.zeros(0, dtype=np.int64)
        self.waiting, self.n, self.total = [], 0, 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.waiting.append(np.searchsorted(self.cuts[0], u, "right") * self.across + np.searchsorted(self.cuts[1], v, "right"))
        self.n += len(u)
        self.total += len(u)
        if self.n > max(1 << 20, len(self.cell)):
            self.gather()

    def gather(self) -> None:
        cell, times = np.concatenate([self.cell, *self.waiting]), np.concatenate([self.times, np.ones(self.n, dtype=np.int64)])
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, dtype=np.int64)
        self.cell, self.times, self.waiting, self.n = cell[first], np.add.reduceat(times[order], first) if len(cell) else times, [], 0

    def rows(self, r0: int, r1: int) -> slice:
        """Cells of the rows above r0 up to r1."""
        return slice(*np.searchsorted(self.cell, [(r0 + 1) * self.across, (r1 + 1) * self.across]))

    def table(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """Numbers in the rows from r0 (none, to begin with) to r1 and the columns from c0 (none) to c1."""
        at = self.rows(r0, r1)
        row, col = np.divmod(self.cell[at], self.across)
        here = (col > c0) & (col <= c1)
        cells = np.zeros((r1 - r0 + 1, c1 - c0 + 1), dtype=np.int32 if self.total < 1 << 31 else np.int64)
        cells[row[here] - r0, col[here] - c0] = self.times[at][here]
        return cells


class RegionPairs:
    """Numbers of points of each library for all pairs of the regions of two blocks, off running sums of cells.

    Regions of the first block are taken in order of where they begin, as many at a time as a table has rows for.
    """

    def __init__(self, mine: list[np.ndarray], theirs: list[np.ndarray], same: bool, alike: bool) -> None:
        self.mine, self.theirs, self.same, self.alike = mine, theirs, same, alike
        cuts = [np.unique(np.concatenate([los, his + 1])) for _, los, his in (mine, theirs)]
        if same:
            cuts = [np.union1d(*cuts)] * 2
        self.cuts = tuple(cuts)
        (self.a0, self.a1), (self.t0, self.t1) = [(np.searchsorted(c, los), np.searchsorted(c, his + 1)) for c, (_, los, his) in zip(cuts, (mine, theirs), strict=True)]
        self.grids: dict[int, Cells] = {}
        self.both: dict[int, Cells] = {}

    def add(self, kind: int, u: np.ndarray, v: np.ndarray) -> None:
        grid = self.grids.setdefault(kind, Cells(self.cuts))
        grid.add(u, v)
        if self.same:
            grid.add(v, u)
            self.both.setdefault(kind, Cells(self.cuts)).add(np.minimum(u, v), np.maximum(u, v))

    def slices(self) -> Iterator[tuple[int, int, int, int]]:
        """Regions of the first block from i to before j, and the cuts from the first one's beginning to the last end."""
        rows = max(LEAST_ROWS, MOST_CELLS // max(1, len(self.grids) * len(self.cuts[1])))
        i = 0
        while i < len(self.a0):
            reach = np.maximum.accumulate(self.a1[i:])
            j = i + max(1, int(np.searchsorted(reach, self.a0[i] + rows, "right")))
            yield i, j, int(self.a0[i]), int(reach[j - i - 1])
            i = j

    def counts(self, least: int) -> Iterator[tuple[int, np.ndarray, dict[int, np.ndarray]]]:
        """Where a run of the first block's regions begins, which of their pairs have ``least`` points, and numbers by library."""
        for cells in (*self.grids.values(), *self.both.values()):
            cells.gather()
        c0, c1 = int(self.t0.min()), int(self.t1.max())
        t0, t1 = self.t0 - c0, self.t1 - c0
        step = max(1, PAIRS // len(self.t0))
        for i, j, r0, r1 in self.slices():
            if sum(int(g.times[g.rows(r0, r1)].sum()) for g in self.grids.values()) < least:
                continue
            tables = {k: np.cumsum(x := g.table(r0, r1, c0, c1), axis=0, out=x) for k, g in self.grids.items()}
            inside = {}
            if self.same and c0 < r1 and r0 < c1:
                # By row those that begin after it, by column those that end up to it.
                for k, g in self.both.items():
                    x = g.table(r0, r1, r0, r1)
                    np.cumsum(x[::-1], axis=0, out=x[::-1])
                    inside[k] = np.cumsum(x, axis=1, out=x)
            for s in range(i, j, step):
                a0, a1 = self.a0[s : min(s + step, j)], self.a1[s : min(s + step, j)]
                found = {}
                for k, sums in tables.items():
                    ahead = np.cumsum(sums[a1 - r0] - sums[a0 - r0], axis=1, dtype=np.int64)
                    found[k] = ahead[:, t1] - ahead[:, t0]
                if inside:
                    lo, hi = np.maximum.outer(a0, self.t0), np.minimum.outer(a1, self.t1)
                    p, q = np.nonzero(lo < hi)
                    at = lo[p, q] - r0 + 1, hi[p, q] - r0
                    for k, sums in inside.items():
                        found[k][p, q] -= sums[at]
                keep = sum(found.values()) >= least
                if self.alike:
                    keep &= np.arange(s, s + len(a0))[:, None] >= np.arange(len(t0))
                if keep.any():
                    yield s, keep, found


def count_both(points: DataFrame, regions: DataFrame, files: tuple[str, ...], ext: int, least: int, size: int = REGIONS_PER_BLOCK) -> DataFrame:
    """anchor_id, target_id and a count per library of pairs of regions with ``least`` points in total.

    ``points`` has kind (the place of the library in ``files``), chromosomes and places u, v of both ends. A pair of
    blocks is a task's, and with it all pairs of their regions, so that nothing is added up afterwards. On one
    chromosome a point counts once for two regions, whichever end is in which: as points in the two rectangles,
    less those with both ends in what the regions have in common. The points of a pair of blocks are packed
    before they are dealt.
    """
    made = blocks(regions, ext, size)
    spread = lambda p: made.select(F.col("block").alias(f"{p}_block"), F.col("chr").alias(f"{p}_chr"), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"))
    met = points
    for p, place in (("anchor", "u"), ("target", "v")):
        # A row for each 1024 regions.
        met = met.join(F.broadcast(spread(p)), f"{p}_chr").where(F.col(place).between(F.col(f"{p}_lo"), F.col(f"{p}_hi")))
    seen = (F.col("anchor_chr") == F.col("target_chr")) & (F.col("anchor_block") < F.col("target_block")) & F.col("u").between(F.col("target_lo"), F.col("target_hi")) & F.col("v").between(F.col("anchor_lo"), F.col("anchor_hi"))
    turned = F.col("anchor_block") < F.col("target_block")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    dealt = met.where(~seen).select(pick("anchor_block", "target_block", "one"), pick("target_block", "anchor_block", "two"), "kind", pick("u", "v", "u"), pick("v", "u", "v"))
    side = lambda p, key: made.select(F.col("block").alias(key), F.col("chr").alias(f"{p}chr"), F.col("members").alias(f"{p}members"))
    heads = side("a_", "one").join(side("t_", "two"), F.col("one") >= F.col("two")).select("one", "two", F.lit(HEAD).alias("kind"), (F.col("a_chr") == F.col("t_chr")).alias("same"), "a_members", "t_members")
    n = made.count()
    rows = in_order(heads.unionByName(packed(dealt, ("one", "two", "kind"), ("u", "v")), allowMissingColumns=True), ("one", "two"), n * (n + 1) // 2)
    names, most = ["anchor_id", "target_id", *files], max(int(least), 1)

    def pairs(met: RegionPairs) -> Iterator[pa.RecordBatch]:
        ids, others = met.mine[0], met.theirs[0]
        for s, keep, found in met.counts(most):
            i, j = np.nonzero(keep)
            one, two = ids[s + i], others[j]
            values = [found[k][i, j] if k in found else np.zeros(len(i), dtype=np.int64) for k in range(len(files))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.maximum(one, two), np.minimum(one, two), *values)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = None
        for key, kind, rows in runs(batches, ("one", "two")):
            if kind == HEAD:
                if met is not None and met.grids:
                    yield from pairs(met)
                met = RegionPairs(members(rows, "a_members"), members(rows, "t_members"), rows.column("same")[0].as_py(), key[0] == key[1])
            else:
                met.add(kind, *unpacked(rows, 2))
        if met is not None and met.grids:
            yield from pairs(met)

    found = rows.mapInArrow(count, "anchor_id long, target_id long, " + ", ".join(f"`{f}` long" for f in files))
    kind_of_id = regions.schema["region_id"].dataType
    return found.withColumns({c: F.col(c).cast(kind_of_id) for c in ("anchor_id", "target_id")})


def count_ends(ends: DataFrame, both: DataFrame, regions: DataFrame, files: tuple[str, ...], ext: int, size: int = REGIONS_PER_END_BLOCK) -> DataFrame:
    """region_id and a count per library: ``ends`` (kind, chr, u, times) in the region, less ``both`` (kind, chr, u, v,
    u <= v) that are in it with both ends."""
    made = blocks(regions, ext, size)
    known = F.broadcast(made.select("block", "chr", "lo", "hi"))  # a row for each 256 regions
    within = lambda rows, last: rows.join(known, "chr").where((F.col("u") >= F.col("lo")) & (F.col(last) <= F.col("hi")))
    heads = made.select("block", F.lit(HEAD).alias("kind"), "members")
    rows = heads.unionByName(within(ends, "u").select("block", "kind", "u", "times"), allowMissingColumns=True).unionByName(within(both, "v").select("block", "kind", "u", "v"), allowMissingColumns=True)
    rows = in_order(rows, ("block",), made.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, sums, inside = None, {}, {}

        def regions_of() -> pa.RecordBatch:
            ids, los, his = mine
            out = []
            for k in range(len(files)):
                n = np.zeros(len(ids), dtype=np.int64)
                if k in sums:
                    upto = np.cumsum(sums[k])
                    n += upto[np.searchsorted(cuts, his + 1)] - upto[np.searchsorted(cuts, los)]
                if k in inside:
                    n -= inside[k].counts()(np.searchsorted(inside[k].los, los), np.searchsorted(inside[k].his, his))
                out.append(n)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, *out)], ["region_id", *files])

        for _, kind, rows in runs(batches, ("block",)):
            if kind == HEAD:
                if mine is not None:
                    yield regions_of()
                mine, sums, inside = members(rows), {}, {}
                cuts = np.unique(np.concatenate([mine[1], mine[2] + 1]))
                continue
            single = rows.column("v").is_null().to_numpy(zero_copy_only=False)
            u = numbers(rows, "u")
            if single.any():
                at = sums.setdefault(kind, np.zeros(len(cuts) + 1, dtype=np.int64))
                np.add.at(at, np.searchsorted(cuts, u[single], "right"), numbers(rows, "times")[single].astype(np.int64))
            if not single.all():
                inside.setdefault(kind, Inside(mine[1], mine[2])).add(u[~single], numbers(rows, "v")[~single].astype(np.int64))
        if mine is not None:
            yield regions_of()

    return rows.mapInArrow(count, "region_id long, " + ", ".join(f"`{f}` long" for f in files))
