"""Alignment scores, FASTQ and SAM text, the store, streaming, clusters."""

import random

import pytest
from pyspark.sql import functions as F

from tagplane.functions import graph, ordered
from tagplane.functions.alignment import scores
from tagplane.functions.intervals import Grid, overlap_join, reduce_intervals, resize_center
from tagplane.operators import clusters, qc, stats
from tagplane.operators.counting import count_windows
from tagplane.operators.heatmap import Span, heatmap_bins, write_svg
from tagplane.operators.interactions import InteractionSet
from tagplane.operators.linkers import split_linkers
from tagplane.operators.pairing import pair_alignments, pair_alignments_counted, pair_diagnostics
from tagplane.plans import fixtures as fx
from tagplane.schema import ALIGNMENTS, PETS
from tagplane.sources import text
from tagplane.sources.store import Conflict, TagStore, discard_outward
from tagplane.streaming import incremental
from tagplane.streaming import pairing as pair_stream

SF = "/root/testdata/sf0.001"
PET_COLUMNS = ["file", "anchor_chr", "target_chr", "anchor_pos", "target_pos"]
#: Default costs, then mismatch -3, match 2, gap open -2, gap extend -2.
GOLDEN = {
    "GTTGGAATGTATATCG": (16, 16, 32, 16, 16),
    "GTTGGAATGTAaATCG": (14, 12, 29, 14, 14),
    "GTcGGAATGTATATCG": (14, 13, 29, 14, 14),
    "GTTGGATAAGATATCG": (8, 6, 21, 9, 8),
    "GTTGAATGTATATCG": (12, 12, 27, 13, 12),
    "GTTGGAAATATCG": (8, 8, 21, 9, 7),
    "GTTGGAATGTATATG": (14, 14, 28, 14, 14),
    "GTTGcGAATGTATATCG": (13, 13, 29, 14, 13),
    "GTTGGAATGagTATATCG": (12, 12, 28, 13, 11),
    "GTTGGAATGTATATcCG": (15, 15, 30, 15, 15),
}


@pytest.mark.parametrize("k,costs", list(enumerate(({}, {"mismatch": -3}, {"match": 2}, {"gap_open": -2}, {"gap_extend": -2}))))
def test_golden_scores(k, costs):
    assert list(scores("GTTGGAATGTATATCG", list(GOLDEN), **costs)) == [v[k] for v in GOLDEN.values()]


def test_no_seed_scores_zero_and_bad_bases_fail():
    assert list(scores("GTTGGAATGTATATCG", ["GTTCGAATCTATACCG", "CAGGGACTAGCATGTCAT"])) == [0, 0]
    for bad in ("ACG", "ACGTXACGT"):
        with pytest.raises(ValueError):
            scores("GTTGGAATGTATATCG", [bad])


def _fastq(path, reads):
    path.write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))


def test_split_fastq(spark, tmp_path):
    a, b = fx.LINKER_A, fx.LINKER_B
    junk = "GACTGTTATGCTATAC"
    one = [("r1", "T" * 17 + a), ("r2", "C" * 17 + b), ("r3", "G" * 17 + a), ("r4", "@" * 17 + junk)]
    two = [("r1", "A" * 17 + a), ("r2", "A" * 17 + b), ("r3", "A" * 17 + b), ("r4", "A" * 17 + a)]
    _fastq(tmp_path / "1.fq", one)
    _fastq(tmp_path / "2.fq", two)
    pairs = text.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"))
    split = split_linkers(pairs, a, b, read_prefix="p").orderBy("pair_id")
    got = [(r["linker"], r["header1"], r["seq1"], r["qual2"]) for r in split.collect()]
    assert got == [("AA", "@p.1", "T" * 17, "I" * 17), ("BB", "@p.2", "C" * 17, "I" * 17), ("AB", "@p.3", "G" * 17, "I" * 17), ("other", "@p.4", "@" * 17, "I" * 17)]
    text.write_split_fastq(split, str(tmp_path / "out"))
    written = spark.read.text(str(tmp_path / "out"))
    assert written.where("linker = 'AB' and mate = 1").count() == 4
    _fastq(tmp_path / "3.fq", two[:2])
    with pytest.raises(ValueError, match="unbalanced"):
        text.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "3.fq"))
    with pytest.raises(ValueError):
        split_linkers(pairs, "ACGX", "ACGT")


def test_lines_of_many_splits_are_numbered_in_place(spark, tmp_path):
    """Small splits, several files, and a record that is cut by a split; no line is shuffled for its number."""
    rng = random.Random(1)
    rows = [f"line {i} " + "x" * rng.randint(0, 90) for i in range(3000)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/part-{k}.txt").write_text("".join(r + "\n" for r in rows[1000 * k : 1000 * k + 1000]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    lines, n = text.counted_lines(spark, str(tmp_path / "in"))
    got = lines.orderBy("line").collect()
    plan = lines._jdf.queryExecution().executedPlan().toString()
    records = [(f"n{i}", "ACGT" * rng.randint(1, 30)) for i in range(200)]
    for m in (1, 2):
        _fastq(tmp_path / f"{m}.fq", records if m == 1 else [(i, s[::-1]) for i, s in records])
    pairs = text.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).orderBy("pair_id").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert n == 3000 and [(r["line"], r["value"]) for r in got] == list(enumerate(rows))
    assert "Window" not in plan and "BroadcastHashJoin" in plan
    assert [(r["pair_id"], r["header1"], r["seq1"], r["seq2"]) for r in pairs] == [(i, f"@{h}", s, s[::-1]) for i, (h, s) in enumerate(records)]
    (tmp_path / "cut.fq").write_text((tmp_path / "2.fq").read_text().rsplit("\n", 2)[0] + "\n")
    with pytest.raises(ValueError, match="truncated"):
        text.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "cut.fq"))


def test_sam_and_pairing(spark, tmp_path):
    lines = ["@HD\tVN:1.0", "@SQ\tSN:chrB\tLN:1000", "@SQ\tSN:chrA\tLN:500"]
    lines += ["a\t0\tchrA\t100\t30\t10M\t*\t0\t0\t*\t*", "a\t16\tchrB\t50\t30\t4M2I4M\t*\t0\t0\t*\t*", "b\t0\tchrA\t1\t30\t10M\t*\t0\t0\t*\t*", "c\t1024\tchrB\t7\t30\t10M\t*\t0\t0\t*\t*", "c\t0\tchrB\t7\t9\t10M\t*\t0\t0\t*\t*"]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    header, rows = text.sam_header(spark, str(tmp_path / "x.sam")), text.read_sam(spark, str(tmp_path / "x.sam"))
    assert [tuple(r) for r in header.orderBy("header_ord").collect()] == [("chrB", 1000, 1), ("chrA", 500, 2)]
    assert [tuple(r)[1:] for r in pair_alignments(rows, header, "f").collect()] == [("chrA", "chrB", 109, -50)]
    assert tuple(pair_diagnostics(rows, header, min_mapq=10).first()) == (1, 0, 2, 1, 1, 1)
    empty = spark.createDataFrame([], ALIGNMENTS)
    assert pair_alignments(empty, header, "f").count() == 0


def test_store_versions_and_rewrite(spark, tmp_path):
    pets = fx.pets(spark, SF)
    lengths = fx.lengths(spark).crossJoin(pets.select("file").distinct()).select("file", "chr", "length")
    store = TagStore(spark, str(tmp_path / "tags"))
    assert store.last() == 0
    with pytest.raises(ValueError):
        store.pets()
    assert store.write(pets, lengths) == 1
    assert store.pets().exceptAll(pets).count() == 0 and store.pets().count() == 6000
    version, gone = store.strip_outward()
    assert (version, gone, store.pets().count()) == (2, 164, 6000 - 164)
    before = set((tmp_path / "tags/pets").iterdir())
    store.merge(("libF_AA", "libF_BB"), "hom")
    assert store.pets().where("file = 'hom'").count() == store.pets().where("file in ('libF_AA', 'libF_BB')").count()
    # Only the new library was written.
    (new,) = set((tmp_path / "tags/pets").iterdir()) - before
    assert [p.name for p in new.iterdir() if p.name.startswith("file=")] == ["file=hom"]
    assert {r["file"] for r in store.lengths().collect()} == {*fx.FILES, "hom"}
    plan = store.pairs("libF_AA", "chrB", "chrA")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(file" in plan
    # Counts come from the manifest and equal those of the pairs; earlier versions stay.
    assert {tuple(r) for r in store.catalog().collect()} == {tuple(r) for r in qc.catalog(store.pets()).collect()}
    assert "anchor_pos" not in store.catalog()._jdf.queryExecution().toString()
    assert {tuple(r) for r in store.cross_counts().collect()} == {tuple(r) for r in qc.cross_counts(store.pets(), fx.lengths(spark)).collect()}
    assert store.pets(1).count() == 6000 and store.versions() == [1, 2, 3]
    _, gone = store.strip_outward(20_000, ["hom"])
    assert gone == store.pets(3).where("file = 'hom'").count() - store.pets().where("file = 'hom'").count() > 0
    assert store.pets().where("file <> 'hom'").count() == 6000 - 164


def test_of_two_writers_one_fails(spark, tmp_path):
    store = TagStore(spark, str(tmp_path / "tags"))
    pets, lengths = spark.createDataFrame([("x", "c", "c", 5, 3)], PETS), spark.createDataFrame([("x", "c", 9)], "file string, chr string, length int")
    store.write(pets, lengths)
    store.add(pets.withColumn("file", F.lit("y")), lengths.withColumn("file", F.lit("y")), after=1)
    with pytest.raises(Conflict):
        store.add(pets.withColumn("file", F.lit("z")), lengths.withColumn("file", F.lit("z")), after=1)
    assert {r["file"] for r in store.pets().collect()} == {"x", "y"}
    assert store.write(pets.limit(0), lengths) == 3 and store.pets().count() == 0 and store.catalog().count() == 0


def test_one_pass_writes_and_counts(spark, tmp_path):
    kept, counted = discard_outward(fx.pets(spark, SF), str(tmp_path / "apart"))
    assert counted == {"discarded": 164, "kept": 6000 - 164} and kept.count() == 6000 - 164
    gone = spark.read.csv(str(tmp_path / "apart/discarded"), sep="\t", schema="chr string, start int, end int")
    assert {tuple(r) for r in gone.collect()} == {tuple(r) for r in qc.stripped(fx.pets(spark, SF)).collect()}
    pairs, found = pair_alignments_counted(fx.alignments(spark, SF), fx.lengths(spark), "lib", min_mapq=10)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    pairs.write.parquet(str(tmp_path / "pairs"))
    assert found.get == pair_diagnostics(fx.alignments(spark, SF), fx.lengths(spark), min_mapq=10).first().asDict()
    assert found.get["valid"] == spark.read.parquet(str(tmp_path / "pairs")).count() == 609


def test_pairs_of_a_stream_equal_those_of_one_run(spark, tmp_path):
    """Parts that cut between mates, a third alignment that comes late, and a stop in between."""
    al = fx.alignments(spark, SF).where("ord < 3 or qname <> 'q.23'")
    late = spark.createDataFrame([("q.7", 9, 0, "chrA", 5, 20, 40), ("only", 1, 0, "chrB", 7, 20, 40)], ALIGNMENTS)
    parts = [al.where("ord = 1"), al.where("ord = 2"), al.where("ord = 3").unionByName(late)]
    whole = al.unionByName(late)
    header, folder, out, ck = fx.lengths(spark), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        if k:  # the first run has two parts to read, the second one finds its mates in the state
            stream = pair_stream.read_alignments(spark, folder, files_per_batch=1)
            pair_stream.write_pairs(stream, header, out, ck, min_mapq=10, buckets=3).awaitTermination(300)
            seen = parts[0].unionByName(parts[1]) if k == 1 else whole
            points = {tuple(r)[1:] for r in pair_alignments(seen, header, "lib", min_mapq=10).groupBy(*PET_COLUMNS).count().collect()}
            assert {tuple(r)[1:] for r in pair_stream.paired(spark, out, "lib").collect()} == points
            assert pair_stream.diagnostics(spark, out).first().asDict() == pair_diagnostics(seen, header, min_mapq=10).first().asDict()
    want = count_windows(pair_alignments(whole, header, "lib", min_mapq=10), header, ["lib"], Grid(5000), 1, 2)
    assert {tuple(r) for r in pair_stream.window_counts(spark, out, header, "lib", Grid(5000), 1, 2).collect()} == {tuple(r) for r in want.collect()}


def test_stream_equals_batch(spark, tmp_path):
    pets = fx.pets(spark, SF)
    pets.repartition(3).write.parquet(str(tmp_path / "in"))
    lengths = fx.lengths(spark)
    stream = incremental.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    incremental.write_window_counts(stream, lengths, fx.FILES, str(tmp_path / "out"), str(tmp_path / "ck"), Grid(5000)).awaitTermination(120)
    got = incremental.total_counts(spark, str(tmp_path / "out"), fx.FILES, 20)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in count_windows(pets, lengths, fx.FILES, Grid(5000), 1, 20).collect()}


@pytest.mark.parametrize(("n", "tol", "span", "wide"), [(120, 60, 4000, 300), (250, 7, 20000, 2000)])
def test_clusters_are_single_linkage(spark, n, tol, span, wide):
    """Boxes of very unequal widths, and a crowd around one place."""
    rng = random.Random(n)
    size = lambda: rng.choice((rng.randint(1, wide), rng.randint(1, wide // 10)))
    boxes = []
    for i in range(n):
        at = (lambda: rng.randint(0, span)) if i % 3 else (lambda: span // 2 + rng.randint(0, 3 * wide // 2))
        a, t = at(), at()
        boxes.append((i * 3 + 5, "c1", rng.choice(("c1", "c2")), a, a + size(), t, t + size()))
    group = {x[0]: x[0] for x in boxes}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    links = set()
    for x in boxes:
        for y in boxes:
            near = x[1:3] == y[1:3] and x[3] < y[4] + tol and y[3] < x[4] + tol and x[5] < y[6] + tol and y[5] < x[6] + tol
            if near and x[0] < y[0]:
                links.add((x[0], y[0]))
                p, q = find(x[0]), find(y[0])
                group[max(p, q)] = min(p, q)
    table = spark.createDataFrame(boxes, "box_id long, anchor_chr string, target_chr string, start_a int, end_a int, start_t int, end_t int")
    assert sorted(tuple(r) for r in clusters.box_links(table, tol).collect()) == sorted(links)
    got = {r["box_id"]: r["cluster_id"] for r in clusters.cluster_boxes(table, tol).collect()}
    assert got == {i: find(i) for i in group}


def test_a_crowd_of_boxes_makes_few_rows(spark):
    """A thousand boxes within one tolerance are one node: no two of them are joined."""
    rng = random.Random(2)
    crowd = [(i, "c", "c", a, a + 5, t, t + 5) for i, a, t in ((i, rng.randint(0, 60), rng.randint(0, 60)) for i in range(1000))]
    rows = clusters._rectangles(spark.createDataFrame(crowd, "box_id long, anchor_chr string, target_chr string, start_a int, end_a int, start_t int, end_t int"), 200)
    met = clusters._meetings(rows.groupBy("anchor_chr", "target_chr", *[F.ceil(F.col(f"lo_{s}") / 128).alias(f"point_{s}") for s in "at"]).agg(F.min("box_id").alias("node"), *[f(f"{e}_{s}").alias(f"{e}_{s}") for s in "at" for e, f in (("lo", F.min), ("hi", F.max))]), "node")
    assert met.count() <= 6
    assert {r["cluster_id"] for r in clusters.cluster_boxes(spark.createDataFrame(crowd, "box_id long, anchor_chr string, target_chr string, start_a int, end_a int, start_t int, end_t int"), 200).collect()} == {0}


def test_values_carried_over_parts(spark):
    """One key in many parts, ties and nulls."""
    rng = random.Random(9)
    rows = [(rng.choice("aaaaaab"), rng.randint(0, 300), rng.choice((None, rng.randint(0, 99)))) for _ in range(600)]
    rows = sorted({(k, n): v for k, n, v in rows}.items())
    df = spark.createDataFrame([(k, n, v) for (k, n), v in rows], "k string, n int, v int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = ordered.dealt(df, ("k", "n"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r["k"], r["n"]): r["m"] for r in ordered.greatest_before(parts, ("k",), ("n",), "v", "m").collect()}
    assert parts.select("_part").distinct().count() > 1
    for (k, n), _ in rows:
        before = [v for (k2, n2), v in rows if k2 == k and n2 < n and v is not None]
        assert got[k, n] == max(before, default=None)


def test_intervals_of_mixed_widths(spark):
    """A region is one row whatever its width; unions and overlaps as by hand."""
    rng = random.Random(6)
    spans = [(c, s, s + rng.choice((0, 5, 63, 64, 65, 2000, 5000, 2_000_000)) - rng.randint(0, 1)) for c in ("c1", "c2") for s in (rng.randint(1, 3_000_000) for _ in range(80))]
    regions = [(i, c, s, max(s, e)) for i, (c, s, e) in enumerate([*spans, ("c1", 1, 250_000_000)])]
    tags = [(i, rng.choice(("c1", "c2", "c3")), s, s + rng.choice((0, 1, 200, 100_000)) - rng.choice((0, 0, 1))) for i, s in enumerate(rng.randint(1, 3_000_000) for _ in range(150))]
    table = spark.createDataFrame(regions, "region_id long, chr string, start int, end int")
    df = spark.createDataFrame(tags, "id long, c string, s int, e int")
    joined = overlap_join(df, table, "c", "s", "e", "r_")
    got = sorted((r["id"], r["r_id"]) for r in joined.collect())
    assert got == sorted((t[0], r[0]) for t in tags for r in regions if t[1] == r[1] and t[2] <= t[3] and t[2] <= r[3] and r[2] <= t[3])
    assert overlap_join(df, table.limit(0), "c", "s", "e", "r_").count() == 0
    for gap in (1, 5000):
        merged = []
        for _, c, s, e in sorted(regions[:-1], key=lambda r: r[1:]):
            if merged and merged[-1][0] == c and s <= merged[-1][2] + gap:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([c, s, e])
        assert sorted(map(list, reduce_intervals(table.where("end < 250000000"), gap).collect())) == merged
    wide = {r["region_id"]: (r["start"], r["end"]) for r in resize_center(table, F.greatest(F.lit(2000), F.col("end") - F.col("start") + 1)).collect()}
    for i, _, s, e in regions:
        n = max(2000, e - s + 1)
        assert wide[i][1] - wide[i][0] + 1 == n and abs(wide[i][0] + wide[i][1] - s - e) <= 1
    assert reduce_intervals(table.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["chain", "grid", "hub", "none"])
def test_components_of_long_and_wide_graphs(spark, kind):
    """Chains and grids with numbers in any order, and a node with very many links."""
    rng = random.Random(8)
    name = list(range(900))
    rng.shuffle(name)
    links = {
        "chain": [(name[i], name[i + 1]) for i in range(400)] + [(name[i], name[i + 1]) for i in range(500, 600)],
        "grid": [(name[30 * i + j], name[30 * i + j + d]) for i in range(29) for j in range(29) for d in (1, 30)],
        "hub": [(500, i) for i in range(400)] + [(3, 3), (7, 500), (700, 701)],
        "none": [],
    }[kind]
    up = {x: x for link in links for x in link if link[0] != link[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(up) and all(r["component"] == find(r["node"]) for r in got)


def test_sorted_quantiles_and_adjusted_values(spark):
    """Ties, nulls and single values against sorting by hand."""
    rng = random.Random(4)
    rows = [(k, rng.choice((0.1, 0.25, rng.random()))) for k in ("x", "y") for _ in range(301)] + [("z", 5.0), ("z", None)]
    shares = (0.0, 0.3, 0.5, 0.95, 1.0)
    df = spark.createDataFrame(rows, "k string, v double")
    for r in ordered.quantiles(df, "k", "v", shares).collect():
        own = sorted(v for k, v in rows if k == r["k"] and v is not None)
        for p, q in zip(shares, r["quantiles"], strict=True):
            at = p * (len(own) - 1)
            lo = int(at)
            hi = min(lo + 1, len(own) - 1)
            assert q == pytest.approx(own[lo] + (at - lo) * (own[hi] - own[lo]))
    adjusted = {(r["k"], r["v"]): r["fdr"] for r in stats.bh_adjust(df.where("k <> 'z'").unionByName(df.where("v is null")), "v").collect()}
    ps = sorted(v for k, v in rows if k != "z")
    for (k, v), fdr in adjusted.items():
        want = None if v is None else min(1.0, min(p * len(ps) / sum(x <= p for x in ps) for p in set(ps) if p >= v))
        assert fdr == (None if want is None else pytest.approx(want))
    assert stats.bh_adjust(df.limit(0), "v").count() == 0


def test_heatmap_picture_and_sets(spark, tmp_path):
    pets = fx.pets(spark, SF)
    bins = heatmap_bins(pets, Span("chrA", 1, 18000), width=2000)
    write_svg(bins, str(tmp_path / "x.svg"), Span("chrA", 1, 18000), width=2000)
    assert (tmp_path / "x.svg").read_text().count("<rect") == bins.count() > 0
    with pytest.raises(ValueError):
        write_svg(bins, str(tmp_path / "y.svg"), Span("chrA", 1, 18000), width=2000, most=3)
    counts = spark.createDataFrame([(2, 1, 3, 4), (1, 2, -1, 0)], "anchor_id long, target_id long, x_AA int, x_AB int")
    regions = spark.createDataFrame([(1, "chrA", 1, 5, 0)], "region_id long, chr string, start int, end int, original long")
    data = InteractionSet.make(counts, regions, ("x_AA", "x_AB"))
    assert {tuple(r) for r in data.problems().collect()} == {("order", 1), ("negative", 1), ("unknown_anchor", 1), ("unknown_target", 1)}
    odd = spark.createDataFrame([(None, 1, 3, 4), (0, -1, 1, 1), (1, 1, None, 0)], "anchor_id long, target_id long, x_AA int, x_AB int")
    info = spark.createDataFrame([("x_AA", "many"), ("x_AB", "7")], "file string, totals string")
    found = {tuple(r) for r in InteractionSet(odd, info, regions, ("x_AA", "x_AB")).problems().collect()}
    assert found == {("missing_id", 1), ("anchor_not_positive", 1), ("target_not_positive", 1), ("negative", 1), ("unknown_anchor", 1), ("unknown_target", 1), ("totals", 1)}
    assert data.dimnames() == (None, ("x_AA", "x_AB")) and data.anchors(ids=True).columns == ["anchor_id", "target_id"]
    assert data.dim() == (2, 2)
    rolled = data.compress()
    assert rolled.files == ("xhom", "xhet")
    data.show()
    with pytest.raises(ValueError):
        data.compress(library={"x_AA": "x"})
    assert spark.createDataFrame([], PETS).select(F.count("*")).first()[0] == 0
