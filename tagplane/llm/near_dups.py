"""Near-duplicates by bottom-k sketches.

One hash function turns a text into the set of its shingle hashes; the k smallest are its sketch.
Inverted lists of retained values generate candidate pairs, the overlap in the bottom k of the union
of two sketches estimates the Jaccard similarity and filters them, and the full sets of both texts
verify what is left.

* Texts with equal sets are one class from the start, however many copies there are.
* A pair that is similar enough shares at least ``OVERLAP`` of its retained values, so each class is
  listed under the rarest of its values only, as many as such a pair cannot all miss. Values that
  many different texts share are therefore hardly ever used.
* Each class first meets the most typical member of its lists (the hub). Classes that this connects
  need no more pairs among them. In a hub's group, and last in each long list whose members have
  different hubs, the members outside the largest component are compared with all, in blocks of
  bounded size: by sketches and, where these leave a link possible, exactly. Only lists of up to
  ``SHORT`` classes are made into pairs, less than that many for each class in them. Groups of near
  copies thus cost a pair per member, and no link between components is lost.
* Texts are fetched only for ids that sketches could not rule out.

Defined cases: null or wordless texts have no shingles, are linked with nothing and stay; a text with
fewer words than a shingle is one shingle; rows that repeat an id are one document; rows without an
id are never smallest and stay unless a document with an id has an equal set; an empty table gives an
empty result; other columns are ignored, clashing names in the pipeline stage are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.functions.graph import components
from tagplane.llm.common import checkpoint, small, table, tasks, written
from tagplane.llm.words import U64, Words, distinct_sorted, mix, shingles, word_slices

#: Values that a sketch retains.
K = 48
#: Share of retained values that similar texts have in common. At a similarity of exactly 0.8, and with
#: one text nested in the other (the worst case), the common ones are binomial (48, 0.8), and fewer
#: than 24 of them have a chance of 7.8e-7; above 0.8 it is less.
OVERLAP = 0.5
#: Least estimate that is still verified: the same bound, as the estimate is a share of 48 or more trials.
ESTIMATE = 0.5
#: Classes of a list that is made into pairs.
SHORT = 32
#: Members of a block that is compared in one task, and shared values that it looks at at a time.
BLOCK, COLUMNS = 1024, 4096
#: Shingles of the texts of one side of a block that is compared by full sets.
BLOCK_SHINGLES = 4_000_000
#: Ids up to which a table of them goes to every task (4 MB); it is counted first.
BROADCAST_IDS = 500_000


def sets_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts of a slice, and where each text starts."""
    hashes, docs = shingles(words, width)
    values, owner = distinct_sorted(hashes, docs, words.n)
    return values, np.searchsorted(owner, np.arange(words.n + 1))


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the sketch in ascending order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(1), lower=True):
                values, at = sets_of(words, width)
                sizes = np.diff(at)
                digests = []
                for salt in (U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values + salt), dtype=U64)])
                    digests.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
                kept = np.arange(len(values)) - np.repeat(at[:-1], sizes) < k
                bounds = np.concatenate([[0], np.cumsum(np.minimum(sizes, k))])
                retained = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values[kept].view(np.int64)))
                ids = batch.column(0).slice(words.first, words.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *digests, retained], ["doc_id", "n_shingles", "set_a", "set_b", "sketch"])

    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>")


def inverted_lists(classes: DataFrame, k: int = K, overlap: float = OVERLAP) -> DataFrame:
    """(value, rep, typical): each class under the rarest of its shared values.

    ``typical`` sums how many classes share each of the values; it is largest for the text that the
    others of a group were made from.
    """
    postings = classes.select("rep", "n_shingles", F.explode("sketch").alias("value"))
    # Stored, so that a value of very many classes is a skewed side of the join, which is split.
    often = checkpoint(postings.groupBy("value").agg(F.count("*").alias("often")).where("often > 1"))
    shared = postings.join(often, "value")
    by_class = shared.groupBy("rep").agg(
        F.max("n_shingles").alias("n_shingles"),
        F.sum("often").alias("typical"),
        F.sort_array(F.collect_list(F.struct("often", "value"))).alias("values"),
    )
    must = F.ceil(F.least(F.col("n_shingles"), F.lit(k)) * F.lit(overlap)).cast("int")
    usable = F.size("values") - must + 1
    return by_class.where(usable > 0).select("rep", "typical", F.explode(F.slice("values", F.lit(1), usable)).alias("v")).select("v.value", "rep", "typical")


def estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the bottom k of the union of two sketches that both retain."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids(doc_id).

    Ids are counted first: up to ``BROADCAST_IDS`` of them go to every task, so that only the texts asked
    for leave the scan; beyond, the join shuffles.
    """
    ids = checkpoint(ids.distinct())
    n = ids.count()
    ids = ids.coalesce(tasks(n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    texts = texts_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                sides = []
                for side in (2, 3):
                    sets = []
                    for words in word_slices(part.column(side), lower=True):
                        values, at = sets_of(words, width)
                        sets += [values[at[i] : at[i + 1]] for i in range(words.n)]
                    sides.append(sets)
                good = []
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(verify, "a long, b long").distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs whose sizes and sketches leave a similarity of 0.8 possible."""
    one = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    fits = F.least("n_a", "n_b") * 10 >= F.greatest("n_a", "n_b") * 7
    return pairs.join(one, "a").join(two, "b").where(fits).where(estimate(F.col("s_a"), F.col("s_b"), k) >= ESTIMATE).select("a", "b")


def dealt_blocks(members: DataFrame) -> DataFrame:
    """(group, i, j, rep, part, home, probe): the groups of members(rep, group, part, home) that have more
    than one part, as blocks i of probes against blocks j of all.

    The members outside the largest part of a group are its probes. Probes and all members are dealt
    into blocks of about ``BLOCK``, so no task holds a group however large it is, and members of the
    largest part are repeated only where there is more than one block of probes. If the members
    have n_shingles, blocks hold no more than about ``BLOCK_SHINGLES`` of them either, so that long
    texts make more blocks and not larger ones.
    """
    weight = F.col("n_shingles") / BLOCK_SHINGLES if "n_shingles" in members.columns else F.lit(0.0)
    by_part = members.groupBy("group", "part").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    sizes = by_part.groupBy("group").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "part", "w")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w)).cast("int")
    sizes = checkpoint(sizes.select("group", F.col("main.part").alias("main"), blocks(F.col("n"), F.col("w")).alias("of_all"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("of_probes")))
    open_members = members.join(sizes, "group")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ("rep", "part", "home")
    all_of_them = open_members.select("group", every("of_probes").alias("i"), deal("of_all").alias("j"), *kept, F.lit(False).alias("probe"))
    probes = open_members.where("part <> main").select("group", deal("of_probes").alias("i"), every("of_all").alias("j"), *kept, F.lit(True).alias("probe"))
    return all_of_them.unionByName(probes)


def _common(values: np.ndarray, sizes: np.ndarray, probe: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many values each set in ``probe`` shares with each set in ``others``; shared values a few thousand at a time."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(probe), len(others)), np.float32)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, n_columns if len(probe) and len(others) else 0, COLUMNS):
        x, y = np.searchsorted(column, (lo, lo + COLUMNS))
        has = np.zeros((len(sizes), min(COLUMNS, n_columns - lo)), np.float32)
        has[owner[x:y], column[x:y] - lo] = 1
        both += has[probe] @ has[others].T
    return both


def _sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the probes, rows of the others, and which pairs of them are open: of different parts and
    homes. Two probes meet twice, so one of both times is left out."""
    rep, part, home = (block.column(c).to_numpy() for c in ("rep", "part", "home"))
    is_probe = block.column("probe").to_numpy(zero_copy_only=False).astype(bool)
    probe, others = np.flatnonzero(is_probe), np.flatnonzero(~is_probe)
    differ = lambda x: x[probe][:, None] != x[others][None, :]
    return probe, others, differ(part) & differ(home) & differ(rep)


def _likely(lists: pa.ListArray, n: np.ndarray, k: int, a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether the union sketch of each pair leaves a similarity of 0.8 possible: up to the lesser of the
    greatest retained values both sketches are complete, so what they share and hold there is known."""
    sizes, top = lists.value_lengths().to_numpy(), np.iinfo(np.int64).max
    table = np.full((len(sizes), k), top)
    table[np.arange(k) < sizes[:, None]] = lists.flatten().to_numpy()
    reach = np.where(n <= k, top - 1, table[np.arange(len(sizes)), np.maximum(sizes, 1) - 1])
    good = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 15):
        x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
        limit = np.minimum(reach[x], reach[y])[:, None]
        shared = both[lo : lo + (1 << 15)]
        union = (table[x] <= limit).sum(axis=1) + (table[y] <= limit).sum(axis=1) - shared
        good[lo : lo + (1 << 15)] = shared >= ESTIMATE * union
    return good


def with_partner(members: DataFrame, classes: DataFrame, k: int, overlap: float = OVERLAP) -> DataFrame:
    """The members(rep, group, part, home) that have a partner in their group, by sketches, with n_shingles.

    Partners are in different parts, have different homes, are of like size and share as many retained
    values as a similar pair does. Only members come back, not pairs.
    """
    sketched = classes.select("rep", "n_shingles", "sketch")
    rows = dealt_blocks(members).join(sketched, "rep").select("group", "i", "j", "rep", "part", "home", "probe", "n_shingles", "sketch")

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        rep, part, home, n = (block.column(c).to_numpy() for c in ("rep", "part", "home", "n_shingles"))
        probe, others, differ = _sides(block)
        lists = block.column("sketch").combine_chunks()
        both = _common(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), probe, others)
        must = np.ceil(np.minimum(n, k) * overlap)
        small_n, large_n = np.minimum(n[probe][:, None], n[others][None, :]), np.maximum(n[probe][:, None], n[others][None, :])
        row, other = np.nonzero(differ & (small_n * 10 >= large_n * 7) & (both >= np.minimum(must[probe][:, None], must[others][None, :])))
        good = _likely(lists, n, k, probe[row], others[other], both[row, other])
        row, other = row[good], other[good]
        _, hit = np.unique(rep[np.concatenate([probe[row], others[other]])], return_index=True)
        hit = np.concatenate([probe[row], others[other]])[hit]
        group = np.full(len(hit), block.column("group")[0].as_py(), np.int64)
        return pa.table({"rep": pa.array(rep[hit]), "group": pa.array(group), "part": pa.array(part[hit]), "home": pa.array(home[hit]), "n_shingles": pa.array(n[hit])})

    return rows.groupBy("group", "i", "j").applyInArrow(compare, "rep long, group long, part long, home long, n_shingles long").distinct()


def block_links(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within each group of members(rep, group, part, home, n_shingles) that has more than one part.

    Each pair of blocks is compared by full sets in a task of its own, and reports one link at most for
    two parts, which is all that components need.
    """
    texts = texts_of(docs, members.select(F.col("rep").alias("doc_id")))
    rows = dealt_blocks(members).join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("group", "i", "j", "rep", "part", "home", "probe", "text")

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        rep, part = block.column("rep").to_numpy(), block.column("part").to_numpy()
        values, sizes = [], []
        for batch in block.select(["text"]).to_batches():
            for words in word_slices(batch.column(0), lower=True):
                v, at = sets_of(words, width)
                values.append(v)
                sizes.append(np.diff(at))
        values, sizes = np.concatenate(values), np.concatenate(sizes)
        probe, others, differ = _sides(block)
        both = _common(values, sizes, probe, others)
        union = sizes[probe][:, None] + sizes[others][None, :] - both
        row, other = np.nonzero(differ & (both > 0) & (100 * both >= percent * union))
        found = {}
        for r, c in zip(probe[row], others[other], strict=True):
            found.setdefault(tuple(sorted((part[r], part[c]))), (min(rep[r], rep[c]), max(rep[r], rep[c])))
        a, b = [x for x, _ in found.values()], [x for _, x in found.values()]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    sketched = written(sketches(docs, width, k), "sketches")
    keys = ["set_a", "set_b", "n_shingles"]
    classes = written(
        sketched.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch")), "classes"
    )
    named = classes.where("rep is not null")
    lists = written(inverted_lists(named, k), "lists")

    # First each class meets one hub: the most typical member of any of its lists. Hubs are a table of
    # their own, so that a value with very many classes is a skewed side of a join, which is split.
    hubs = checkpoint(lists.groupBy("value").agg(F.max(F.struct("typical", -F.col("rep"))).alias("hub")))
    best = small(lists.join(hubs, "value").where("hub.col2 <> -rep").groupBy("rep").agg(F.max("hub").alias("hub")))
    first = best.select(F.least("rep", -F.col("hub.col2")).alias("a"), F.greatest("rep", -F.col("hub.col2")).alias("b")).distinct()
    first = small(_estimated(first, named, k))
    links = small(confirmed(first, docs, width, percent))
    joined = components(links)

    # Then the members of a hub's group that are still in different components, in blocks.
    parted = lambda rows: rows.join(joined, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep")).drop("node", "component")
    grouped = best.select("rep", (-F.col("hub.col2")).alias("group"))
    members = small(parted(grouped.union(grouped.select("group", "group")).distinct()).withColumn("home", F.col("rep")))
    members = small(with_partner(members, named, k))
    links = small(links.union(block_links(members, docs, width, percent)))
    joined = small(components(links))

    # Last the members of a list that have different groups and components, the same way.
    # A class that is the hub of all its lists chose no other; its group is its own.
    owned = lists.select("value", "rep").join(grouped, "rep", "left").select("rep", F.col("value").alias("group"), F.coalesce("group", "rep").alias("home"))
    owned = small(parted(owned))
    mixed = owned.groupBy("group").agg(F.count("*").alias("n"), F.min("part").alias("p0"), F.max("part").alias("p1"), F.min("home").alias("h0"), F.max("home").alias("h1"))
    mixed = checkpoint(mixed.where("p0 < p1 and h0 < h1").select("group", "n"))
    short = owned.join(mixed.where(F.col("n") <= SHORT), "group", "left_semi")
    one = short.select("group", F.col("rep").alias("a"), F.col("part").alias("p"), F.col("home").alias("g"))
    two = short.select("group", F.col("rep").alias("b"), F.col("part").alias("q"), F.col("home").alias("h"))
    pairs = one.join(two, (one.group == two.group) & (F.col("p") != F.col("q")) & (F.col("g") != F.col("h")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    extra = confirmed(small(_estimated(pairs, named, k)), docs, width, percent)
    members = small(with_partner(owned.join(mixed.where(F.col("n") > SHORT), "group", "left_semi"), named, k))
    extra = small(extra.union(block_links(members, docs, width, percent)))
    if extra.limit(1).count():
        joined = components(links.union(extra))

    labelled = classes.join(joined, classes.rep == joined.node, "left").select(*keys, F.coalesce("component", "rep").alias("component_id"))
    found = sketched.select("doc_id", *keys).join(labelled, keys, "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept")
    )


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates, by shingles of five words."""
    gone = near_duplicates(docs, width=5).where("not kept").select(F.col("doc_id").alias("_dup_id")).distinct()
    return docs.join(gone, docs.doc_id == gone._dup_id, "left_anti").select(*docs.columns)
