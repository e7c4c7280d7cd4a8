"""Every query of the paired-tag engine by name, with its DuckDB oracle.

Where a query is arithmetic in Spark, its oracle is a plain overlap join with a distinct, so that the two
do not share their reasoning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.functions import alignment
from tagplane.functions.intervals import Grid, make_windows, overlap_join, reduce_intervals, resize_center
from tagplane.functions.tags import extended
from tagplane.operators import clusters, counting, heatmap, linkers, models, pairing, qc, stats
from tagplane.operators.interactions import InteractionSet
from tagplane.plans import fixtures as fx
from tagplane.sources import text
from tagplane.sources.store import TagStore, discard_outward
from tagplane.streaming import pairing as pair_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FILES = fx.FILES


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# --- window pairs -------------------------------------------------------------------------------

_COUNTS = ", ".join(f"count(*) filter (file = '{f}') as \"{f}\"" for f in FILES)


def _windows_cte(grid: Grid) -> str:
    s, left, right = grid.step, grid.left, grid.right
    return f"""lengths as ({fx.LENGTHS}),
win as (select chr, length, 1 + m * {s} as c, cast(row_number() over (order by chr, m) as bigint) as id from lengths, unnest(generate_series(0, length // {s} + 1)) as u(m)
  where 1 + m * {s} + {right} >= 1 and 1 + m * {s} - {left} <= length)"""


def _window_oracle(grid: Grid, ext: int, least: int, restrict: tuple[str, ...] | None = None) -> str:
    where = "" if restrict is None else "where " + " and ".join(f"{c} in ({', '.join(repr(x) for x in restrict)})" for c in ("anchor_chr", "target_chr"))
    return f"""with pets as ({fx.PETS_SQL}), {_windows_cte(grid)},
p as (select row_number() over () as id, *, case when anchor_pos > 0 then anchor_pos - {ext} + 1 else -anchor_pos end as s1,
  case when target_pos > 0 then target_pos - {ext} + 1 else -target_pos end as s2 from pets {where}),
a as (select p.id, win.id as k from p join win on chr = anchor_chr and s1 <= c + {grid.right} and s1 + {ext} - 1 >= c - {grid.left}),
t as (select p.id, win.id as k from p join win on chr = target_chr and s2 <= c + {grid.right} and s2 + {ext} - 1 >= c - {grid.left}),
cells as (select distinct p.id, file, greatest(a.k, t.k) as anchor_id, least(a.k, t.k) as target_id from p join a on a.id = p.id join t on t.id = p.id)
select anchor_id, target_id, {_COUNTS} from cells group by 1, 2 having count(*) >= {least}"""


def _window_query(name: str, grid: Grid, ext: int, least: int, restrict: tuple[str, ...] | None = None) -> None:
    query(name, _window_oracle(grid, ext, least, restrict))(
        lambda spark, sf: counting.count_windows(fx.pets(spark, sf), fx.lengths(spark), FILES, grid, ext, least, restrict)
    )


_window_query("count_bins", Grid(5000), 1, 20)
_window_query("count_windows_sliding", Grid(2000, 1000), 1, 5)
_window_query("count_windows_ext", Grid(1500, 1100, 400), 700, 10)
_window_query("count_windows_shift", Grid(5000, 5000, 4999), 1, 20)
_window_query("count_windows_point", Grid(5000), 0, 20)
_window_query("count_windows_gapped", Grid(7, 300, 100), 40, 1)
_window_query("count_windows_restrict", Grid(5000), 1, 20, ("chrA", "chrC"))


@query("make_windows", f"with {_windows_cte(Grid(3000, 2000, 500))} select id as window_id, chr, cast(greatest(1, c - 500) as int) as start, cast(least(length, c + 2499) as int) as \"end\" from win")
def make_windows_query(spark: SparkSession, sf: str) -> DataFrame:
    return make_windows(fx.lengths(spark), Grid(3000, 2000, 500))


@query("library_totals", f"select file, count(*) as totals from ({fx.PETS_SQL}) where anchor_chr in ('chrA', 'chrB') and target_chr in ('chrA', 'chrB') group by 1")
def library_totals(spark: SparkSession, sf: str) -> DataFrame:
    return counting.library_totals(fx.pets(spark, sf), ("chrA", "chrB"))


# --- regions ------------------------------------------------------------------------------------


def _tag_cte(ext: int) -> str:
    return f"""pets as ({fx.PETS_SQL}), r as ({fx.REGIONS_SQL}),
p as (select row_number() over () as id, *, greatest(1, case when anchor_pos > 0 then anchor_pos - {ext} + 1 else -anchor_pos end) as s1,
  (case when anchor_pos > 0 then anchor_pos else -anchor_pos + {ext} - 1 end) as e1,
  greatest(1, case when target_pos > 0 then target_pos - {ext} + 1 else -target_pos end) as s2,
  (case when target_pos > 0 then target_pos else -target_pos + {ext} - 1 end) as e2 from pets)"""


def _region_oracle(ext: int, least: int) -> str:
    return f"""with {_tag_cte(ext)},
hit as (select distinct p.id, file, greatest(ra.region_id, rt.region_id) as anchor_id, least(ra.region_id, rt.region_id) as target_id
  from p join r ra on ra.chr = anchor_chr and s1 <= ra."end" and ra.start <= e1 join r rt on rt.chr = target_chr and s2 <= rt."end" and rt.start <= e2)
select anchor_id, target_id, {_COUNTS} from hit group by 1, 2 having count(*) >= {least}"""


@query("count_regions", _region_oracle(1, 5))
def count_regions(spark: SparkSession, sf: str) -> DataFrame:
    return counting.count_regions(fx.pets(spark, sf), fx.regions(spark, sf), FILES, 1, 5)


@query("count_regions_ext", _region_oracle(200, 20))
def count_regions_ext(spark: SparkSession, sf: str) -> DataFrame:
    return counting.count_regions(fx.pets(spark, sf), fx.regions(spark, sf), FILES, 200, 20)


_MARGIN_ORACLE = f"""with {_tag_cte(100)},
q as (select * from p where anchor_chr in (select chr from r) and target_chr in (select chr from r)),
hit as (select id, file, region_id from q join r on chr = anchor_chr and s1 <= "end" and start <= e1
  union select id, file, region_id from q join r on chr = target_chr and s2 <= "end" and start <= e2)
select r.region_id, {", ".join(f"count(hit.id) filter (file = '{f}') as " + chr(34) + f + chr(34) for f in FILES)} from r left join hit on hit.region_id = r.region_id group by 1"""


@query("count_margins", _MARGIN_ORACLE)
def count_margins(spark: SparkSession, sf: str) -> DataFrame:
    return counting.count_margins(fx.pets(spark, sf), fx.regions(spark, sf), FILES, 100)


@query("overlap_join", f"with {_tag_cte(50)} select file, region_id, count(*) as hits from p join r on chr = anchor_chr and s1 <= \"end\" and start <= e1 group by 1, 2")
def overlap_join_query(spark: SparkSession, sf: str) -> DataFrame:
    """Tags that lie alike are one with their number before they are joined: there are as many as places at most."""
    lo, hi = extended(F.col("anchor_pos"), 50)
    tags = fx.pets(spark, sf).groupBy("file", "anchor_chr", lo.alias("s"), hi.alias("e")).agg(F.count("*").alias("times"))
    hits = overlap_join(tags, fx.regions(spark, sf), "anchor_chr", "s", "e", "r_")
    return hits.groupBy("file", F.col("r_id").alias("region_id")).agg(F.sum("times").alias("hits"))


@query(
    "reduce_regions",
    f"""with r as ({fx.REGIONS_SQL}), o as (select *, max("end") over (partition by chr order by start, "end", region_id rows between unbounded preceding and 1 preceding) as m from r),
g as (select *, sum(case when m is null or start > m + 1 then 1 else 0 end) over (partition by chr order by start, "end", region_id) as g from o)
select chr, min(start) as start, max("end") as "end" from g group by chr, g""",
)
def reduce_regions(spark: SparkSession, sf: str) -> DataFrame:
    return reduce_intervals(fx.regions(spark, sf))


_OWN_WIDTH = 'greatest(2000, "end" - start + 1)'


@query("resize_own_widths", f'''select region_id, chr, cast(start + floor(("end" - start + 1 - {_OWN_WIDTH}) / 2.0) as int) as start, cast(start + floor(("end" - start + 1 - {_OWN_WIDTH}) / 2.0) + {_OWN_WIDTH} - 1 as int) as "end" from ({fx.REGIONS_SQL})''')
def resize_own_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Regions under a least width grow to it around their centres; wider ones stay as they are."""
    return resize_center(fx.regions(spark, sf), F.greatest(F.lit(2000), F.col("end") - F.col("start") + 1)).select("region_id", "chr", "start", "end")


@query("resize_regions", f'select region_id, chr, cast(start + floor(("end" - start + 1 - 1000) / 2.0) as int) as start, cast(start + floor(("end" - start + 1 - 1000) / 2.0) + 999 as int) as "end" from ({fx.REGIONS_SQL})')
def resize_regions(spark: SparkSession, sf: str) -> DataFrame:
    return resize_center(fx.regions(spark, sf), 1000).select("region_id", "chr", "start", "end")


# --- quality control ----------------------------------------------------------------------------

_FLAGS = f"""select *, (case when anchor_pos > 0 then 0 else 1 end) + (case when target_pos > 0 then 0 else 2 end) as flag, abs(anchor_pos) - abs(target_pos) as gap from ({fx.PETS_SQL})"""


@query("diagnose_intra", f"select file, flag, gap from ({_FLAGS}) where anchor_chr = target_chr")
def diagnose_intra(spark: SparkSession, sf: str) -> DataFrame:
    return qc.diagnose_intra(fx.pets(spark, sf))


@query("diagnose_inter", f"select cast(k as int) as flag, count(anchor_pos) as count from generate_series(0, 3) as s(k) left join (select * from ({_FLAGS}) where anchor_chr <> target_chr) on flag = k group by 1")
def diagnose_inter(spark: SparkSession, sf: str) -> DataFrame:
    return qc.diagnose_inter(fx.pets(spark, sf))


@query("gap_histogram", f"select flag, cast(floor(log2(gap) + 1e-9) as int) as log2_gap, count(*) as count from ({_FLAGS}) where anchor_chr = target_chr and gap > 0 group by 1, 2")
def gap_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return qc.gap_histogram(fx.pets(spark, sf))


@query("strip_outward_kept", f"select file, anchor_chr, target_chr, anchor_pos, target_pos from ({_FLAGS}) where not (anchor_chr = target_chr and flag = 2 and gap < 10000)")
def strip_outward_kept(spark: SparkSession, sf: str) -> DataFrame:
    return qc.strip_outward(fx.pets(spark, sf))


@query("strip_outward_discarded", f"select anchor_chr as chr, -target_pos as start, anchor_pos as \"end\" from ({_FLAGS}) where anchor_chr = target_chr and flag = 2 and gap < 10000")
def strip_outward_discarded(spark: SparkSession, sf: str) -> DataFrame:
    return qc.stripped(fx.pets(spark, sf))


def _cross_oracle(own: bool) -> str:
    return f"""select l.chr, coalesce(n, 0) as count from ({fx.LENGTHS}) l left join (
  select case when anchor_chr = 'chrM' then target_chr else anchor_chr end as chr, count(*) as n from ({fx.PETS_SQL})
  where (anchor_chr = 'chrM' or target_chr = 'chrM') and ({own} or anchor_chr <> target_chr) group by 1) c on c.chr = l.chr"""


@query("cross_chrom_counts", _cross_oracle(False))
def cross_chrom_counts(spark: SparkSession, sf: str) -> DataFrame:
    return qc.cross_counts(fx.pets(spark, sf), fx.lengths(spark))


@query("cross_chrom_counts_self", _cross_oracle(True))
def cross_chrom_counts_self(spark: SparkSession, sf: str) -> DataFrame:
    return qc.cross_counts(fx.pets(spark, sf), fx.lengths(spark), include_self=True)


@query("merge_libraries", f"select 'libF_hom' as file, anchor_chr, target_chr, anchor_pos, target_pos from ({fx.PETS_SQL}) where file in ('libF_AA', 'libF_BB')")
def merge_libraries(spark: SparkSession, sf: str) -> DataFrame:
    return qc.merge_libraries(fx.pets(spark, sf), ("libF_AA", "libF_BB"), "libF_hom")


@query("catalog", f"select file, anchor_chr, target_chr, count(*) as n_pets from ({fx.PETS_SQL}) group by 1, 2, 3")
def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return qc.catalog(fx.pets(spark, sf))


#: The lengths of each library, as stored, and one library whose chrD is too short.
_GENOMES = f"select f.file, l.chr, l.length from (select distinct file from ({fx.PETS_SQL})) f cross join ({fx.LENGTHS}) l"
_BROKEN = "case when file = 'libO_BB' and chr = 'chrD' then length - 1 else length end"


def _genomes(spark: SparkSession, sf: str) -> DataFrame:
    stored = fx.store(spark, sf).lengths()
    return stored.unionByName(fx.lengths(spark).select(F.lit("copy").alias("file"), "chr", "length"))


@query("genome_check", f"with g as ({_GENOMES}), l as (select file, chr, {_BROKEN} as length from g union all select 'copy', chr, length from ({fx.LENGTHS})) "
    "select chr, length, count(distinct file) as n_files from l group by 1, 2 having count(distinct file) < (select count(distinct file) from l)")
def genome_check(spark: SparkSession, sf: str) -> DataFrame:
    short = F.when((F.col("file") == "libO_BB") & (F.col("chr") == "chrD"), F.col("length") - 1).otherwise(F.col("length"))
    return qc.genome_conflicts(_genomes(spark, sf).withColumn("length", short))


@query("genome_agrees", "select true as agrees")
def genome_agrees(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.lit(qc.same_genome(_genomes(spark, sf))).alias("agrees"))


@query("pooled_ends", f"""with d as (select anchor_chr as chr, -target_pos as s, anchor_pos as e from ({_FLAGS}) where anchor_chr = target_chr and flag = 2 and gap < 10000),
h as (select *, substring(md5(concat_ws(':', chr, s, e, 1)), 1, 1) < '8' as heads from d)
select chr, abs(case when heads then s else e end) as pos, case when heads then '+' else '-' end as strand from h""")
def pooled_ends(spark: SparkSession, sf: str) -> DataFrame:
    return qc.pooled_ends(qc.stripped(fx.pets(spark, sf)))


# --- interaction sets ---------------------------------------------------------------------------


def interactions(spark: SparkSession, sf: str) -> InteractionSet:
    """Counts of region pairs as an interaction set, which the queries on sets start from.

    They are not stored: in dense data they are as many as pairs of regions, many times the input, and a query
    that asks for the libraries alone needs none of them.
    """
    pets, regions = fx.pets(spark, sf), fx.regions(spark, sf)
    counts = counting.count_regions(pets, regions, FILES, 1, 5)
    return InteractionSet.make(counts, regions, FILES, counting.library_totals(pets))


_RC = f"rc as ({_region_oracle(1, 5)})"
_ROLLED = ", ".join(f"cast({' + '.join(cols)} as bigint) as \"{name}\"" for name, cols in (("libFhom", ('"libF_AA"', '"libF_BB"')), ("libFhet", ('"libF_AB"',)), ("libOhom", ('"libO_AA"', '"libO_BB"')), ("libOhet", ('"libO_AB"',))))


@query("compress_matrix", f"with {_RC} select anchor_id, target_id, {_ROLLED} from rc")
def compress_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).compress().counts


@query(
    "compress_totals",
    f"""with t as (select regexp_replace(file, '_(AA|AB|BB|other)([.][^.]+)?$', '') as libname, contains(file, 'AB') as hetero from ({fx.PETS_SQL})),
n as (select libname, count(*) as totals from t group by 1)
select libname || case when hetero then 'het' else 'hom' end as file, totals, hetero, libname from (select distinct libname, hetero from t) join n using (libname)""",
)
def compress_totals(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).compress().info


_DISTANCE = f"""{_RC}, regs as ({fx.REGIONS_SQL}), d as (select rc.*, case when a.chr <> t.chr then null else greatest(a.start, t.start) - least(a."end", t."end") - 1 end as distance
 from rc join regs a on a.region_id = anchor_id join regs t on t.region_id = target_id)"""


@query("pair_distance", f"with {_DISTANCE} select * from d")
def pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).distances()


@query("distance_filter", f"with {_DISTANCE} select * from d where distance > 1 or distance is null")
def distance_filter(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).distances().where("distance > 1 or distance is null")


@query("interchrom_filter", f"with {_DISTANCE} select * from d where distance is null")
def interchrom_filter(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).distances().where("distance is null")


@query("subset", f'with {_RC} select anchor_id, target_id, "libF_AA", "libO_AB" from rc where "libF_AA" + "libO_AB" >= 2')
def subset(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).subset(F.col("libF_AA") + F.col("libO_AB") >= 2, ("libF_AA", "libO_AB")).counts


@query("anchors", f'with {_RC}, regs as ({fx.REGIONS_SQL}) select anchor_id, target_id, chr, start, "end" from rc join regs on region_id = anchor_id')
def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).anchors()


@query("targets", f'with {_RC}, regs as ({fx.REGIONS_SQL}) select anchor_id, target_id, chr, start, "end" from rc join regs on region_id = target_id')
def targets(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).targets()


@query("default_totals", "with " + _RC + " " + " union all ".join(f"select '{f}' as file, cast(coalesce(sum(\"{f}\"), 0) as bigint) as totals from rc" for f in FILES))
def default_totals(spark: SparkSession, sf: str) -> DataFrame:
    data = interactions(spark, sf)
    return InteractionSet.make(data.counts, data.regions, FILES).info


@query("validity", "with " + _RC + f""", r as ({fx.REGIONS_SQL})
select problem, n from (
  select 'order' as problem, count(*) as n from rc where anchor_id > target_id
  union all select 'unknown_anchor', count(*) from rc where target_id not in (select region_id from r where region_id % 7 <> 0)
  union all select 'unknown_target', count(*) from rc where anchor_id not in (select region_id from r where region_id % 7 <> 0)
  union all select 'negative', count(*) from rc where "libF_AA" = 0
  union all select 'libraries', 1 union all select 'totals', 1) where n > 0""")
def validity(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule that can be broken is: ids change sides, regions go, zeros turn negative, a library and a total are lost."""
    data = interactions(spark, sf)
    turned = data.counts.select(F.col("target_id").alias("anchor_id"), F.col("anchor_id").alias("target_id"), F.when(F.col("libF_AA") == 0, -1).otherwise(F.col("libF_AA")).alias("libF_AA"), *FILES[1:])
    info = data.info.where("file <> 'libF_AA'").withColumn("totals", F.when(F.col("file") != "libF_AB", F.col("totals")))
    return InteractionSet(turned, info, data.regions.where("region_id % 7 <> 0"), FILES).problems()


@query("valid_set", "select 'order' as problem, cast(0 as bigint) as n where false")
def valid_set(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).problems()


@query("paired_design", "select file, 1 as intercept, cast(libname = 'libO' as int) as \"libO\", cast(hetero as int) as hetero from (values ('libFhom', 'libF', false), ('libFhet', 'libF', true), ('libOhom', 'libO', false), ('libOhet', 'libO', true)) as t(file, libname, hetero)")
def paired_design(spark: SparkSession, sf: str) -> DataFrame:
    return stats.design(interactions(spark, sf).compress().info, ("libF", "libO"))


@query("count_list", f"select file, count(*) as lib_size, cast(1.0 as double) as norm_factor from ({fx.PETS_SQL}) group by 1")
def count_list(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).count_list()


# --- sources and sinks --------------------------------------------------------------------------


def _pairing_cte(dedup: bool, minq: int | None) -> str:
    bad = "flag & 4 <> 0" + ("" if minq is None else f" or mapq < {minq}")
    return f"""al as (select al.*, header_ord, ({bad}) as bad, flag & 1024 <> 0 as marked, case when flag & 16 <> 0 then pos else pos + qwidth - 1 end as e
  from ({fx.ALIGNMENTS_SQL}) al join ({fx.LENGTHS}) h on h.chr = rname),
sized as (select *, count(*) over (partition by qname) as n, row_number() over (partition by qname order by ord) as k from al),
pr as (select o.rname as c1, t.rname as c2, o.header_ord as h1, t.header_ord as h2, o.e as e1, t.e as e2, case when o.flag & 16 <> 0 then -o.e else o.e end as s1,
  case when t.flag & 16 <> 0 then -t.e else t.e end as s2, o.bad or t.bad as bad, o.marked or t.marked as marked
  from sized o join sized t on o.qname = t.qname and o.k = 1 and t.k = 2 and o.n = 2),
v as (select *, h1 > h2 or (h1 = h2 and e1 > e2) as f from pr where not bad {"and not marked" if dedup else ""})"""


def _pairs_oracle(dedup: bool, minq: int | None) -> str:
    return f"""with {_pairing_cte(dedup, minq)} select 'lib' as file, case when f then c1 else c2 end as anchor_chr, case when f then c2 else c1 end as target_chr,
  cast(case when f then s1 else s2 end as int) as anchor_pos, cast(case when f then s2 else s1 end as int) as target_pos from v"""


_SAM_PAIRS = _pairs_oracle(True, None)


@query("fastq_pairs", f"select row_number() over (order by pair_id) - 1 as pair_id, header1, seq1, plus1, qual1, header2, seq2, plus2, qual2 from ({fx.READS_SQL})")
def fastq_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Reads as two FASTQ files, read again."""
    return text.read_fastq_pairs(spark, *fx.fastq(spark, sf))


@query("sam_header", f"select chr, length, header_ord from ({fx.LENGTHS})")
def sam_header(spark: SparkSession, sf: str) -> DataFrame:
    return text.sam_header(spark, fx.sam(spark, sf))


@query("sam_alignments", f"select qname, row_number() over (order by qname, ord) + 4 as ord, flag, rname, pos, qwidth, mapq from ({fx.ALIGNMENTS_SQL})")
def sam_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments as SAM text with its header of five lines, read again."""
    return text.read_sam(spark, fx.sam(spark, sf))


@query("sam_pairs", _SAM_PAIRS)
def sam_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Tag pairs from SAM text."""
    path = fx.sam(spark, sf)
    return pairing.pair_alignments(text.read_sam(spark, path), text.sam_header(spark, path), "lib")


@query("read_regions", f'select region_id, chr, start, "end" from ({fx.REGIONS_SQL})')
def read_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as a tab-separated file without order, read and numbered."""
    path = fx.folder(spark)
    text.write_table(fx.regions(spark, sf).select("chr", "start", "end").repartition(3), path)
    return text.read_regions(spark, path).select("region_id", "chr", "start", "end")


@query("discard_file", f"select anchor_chr as chr, -target_pos as start, anchor_pos as \"end\" from ({_FLAGS}) where anchor_chr = target_chr and flag = 2 and gap < 10000")
def discard_file(spark: SparkSession, sf: str) -> DataFrame:
    path = fx.folder(spark)
    text.write_table(qc.stripped(fx.pets(spark, sf)), path)
    return spark.read.csv(path, sep="\t", schema="chr string, start int, end int")


@query("store_catalog", f"select file, anchor_chr, target_chr, count(*) as n_pets from (select file, anchor_chr, target_chr from ({fx.PETS_SQL}) union all select 'libF_hom', anchor_chr, target_chr from ({fx.PETS_SQL}) where file in ('libF_AA', 'libF_BB')) group by 1, 2, 3")
def store_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Two libraries merged into the stored table as one more."""
    store = TagStore(spark, fx.folder(spark))
    store.write(fx.pets(spark, sf), fx.store(spark, sf).lengths())
    store.merge(("libF_AA", "libF_BB"), "libF_hom")
    return store.catalog()


@query("store_cross_counts", _cross_oracle(False))
def store_cross_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The cross-chromosome counts of the stored table, from its manifest."""
    return fx.store(spark, sf).cross_counts()


@query("strip_counted", f"select count(*) filter (bad) as discarded, count(*) filter (not bad) as kept from (select anchor_chr = target_chr and flag = 2 and gap < 10000 as bad from ({_FLAGS}))")
def strip_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Kept and discarded pairs written apart in one pass, which counts them."""
    _, counted = discard_outward(fx.pets(spark, sf), fx.folder(spark))
    return spark.createDataFrame([(counted["discarded"], counted["kept"])], "discarded long, kept long")


# --- ingest -------------------------------------------------------------------------------------


@query("pair_alignments", _pairs_oracle(True, None))
def pair_alignments(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.pair_alignments(fx.alignments(spark, sf), fx.lengths(spark), "lib")


@query("pair_dedup_minq", _pairs_oracle(False, 10))
def pair_dedup_minq(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.pair_alignments(fx.alignments(spark, sf), fx.lengths(spark), "lib", dedup=False, min_mapq=10)


_DIAGNOSTICS = f"""with {_pairing_cte(True, 10)} select (select count(*) from sized where n = 1) as singles, (select count(*) from sized where n > 2 and k = 1) as multi,
  (select count(*) from pr) as total, (select count(*) from pr where marked) as marked, (select count(*) from pr where bad) as filtered, (select count(*) from v) as valid"""


@query("pair_diagnostics", _DIAGNOSTICS)
def pair_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.pair_diagnostics(fx.alignments(spark, sf), fx.lengths(spark), min_mapq=10)


@query("prepare_counted", _DIAGNOSTICS)
def prepare_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Tag pairs written to a folder, with the diagnostics from the pass that writes."""
    pairs, counted = pairing.pair_alignments_counted(fx.alignments(spark, sf), fx.lengths(spark), "lib", min_mapq=10)
    pairs.write.parquet(fx.folder(spark))
    return spark.createDataFrame([counted.get], "singles long, multi long, total long, marked long, filtered long, valid long")


#: Alignments of a bucket of the stream.
_PER_BUCKET = 50_000


def _streamed(spark: SparkSession, sf: str) -> str:
    """The alignments as a stream of parts that are cut between mates, paired; where the changes are written."""
    parts, out = fx.folder(spark), fx.folder(spark)
    fx.alignments(spark, sf).repartition(3, "ord").write.parquet(parts)
    buckets = max(8, -(-spark.read.parquet(parts).count() // _PER_BUCKET))
    stream = pair_stream.read_alignments(spark, parts, files_per_batch=1)
    pair_stream.write_pairs(stream, fx.lengths(spark), out, fx.folder(spark), min_mapq=10, buckets=buckets).awaitTermination()
    return out


@query("stream_diagnostics", _DIAGNOSTICS)
def stream_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return pair_stream.diagnostics(spark, _streamed(spark, sf))


@query("unknown_chromosomes", f"select distinct rname as chr from ({fx.ALIGNMENTS_SQL}) where rname not in ('chrA', 'chrB', 'chrC')")
def unknown_chromosomes(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.unknown_chromosomes(fx.alignments(spark, sf), fx.lengths(spark).where("chr <= 'chrC'"))


# --- linkers ------------------------------------------------------------------------------------

_KNOWN = "(values " + ", ".join(f"('{s}', {a}, {b})" for s, a, b in fx.SEGMENTS) + ") as k(segment, score_a, score_b)"


@query("linker_scores", f"select segment, cast(score_a as int) as score_a, cast(score_b as int) as score_b from {_KNOWN} where segment in (select substring(seq1, 18) from ({fx.READS_SQL}) union select substring(seq2, 18) from ({fx.READS_SQL}))")
def linker_scores(spark: SparkSession, sf: str) -> DataFrame:
    reads = fx.reads(spark, sf).select(F.explode(F.array(F.substring("seq1", 18, 16), F.substring("seq2", 18, 16))).alias("segment"))
    return alignment.segment_scores(reads, {"a": fx.LINKER_A, "b": fx.LINKER_B})


_CLASS = "case when score_a > score_b and score_a >= 10 then 'A' when score_b > score_a and score_b >= 10 then 'B' end"
_CLASSED = f"""with reads as ({fx.READS_SQL}), k as (select segment, {_CLASS} as kind from {_KNOWN}),
c as (select reads.*, k1.kind || k2.kind as kinds from reads join k k1 on k1.segment = substring(seq1, 18) join k k2 on k2.segment = substring(seq2, 18)),
d as (select *, case when kinds is null then 'other' when kinds = 'BA' then 'AB' else kinds end as linker from c)"""


@query("linker_classify", f"{_CLASSED} select linker, count(*) as pairs from d group by 1")
def linker_classify(spark: SparkSession, sf: str) -> DataFrame:
    return linkers.split_linkers(fx.reads(spark, sf), fx.LINKER_A, fx.LINKER_B).groupBy("linker").agg(F.count("*").alias("pairs"))


@query(
    "linker_trim",
    f"""{_CLASSED} select pair_id, linker, '@x.' || (pair_id + 1) as header1, substring(seq1, 1, 17) as seq1, plus1, substring(qual1, 1, 17) as qual1,
  '@x.' || (pair_id + 1) as header2, substring(seq2, 1, 17) as seq2, plus2, substring(qual2, 1, 17) as qual2 from d""",
)
def linker_trim(spark: SparkSession, sf: str) -> DataFrame:
    return linkers.split_linkers(fx.reads(spark, sf), fx.LINKER_A, fx.LINKER_B, read_prefix="x")


# --- heat-map and clusters ----------------------------------------------------------------------


def _heat_oracle(anchor: heatmap.Span, target: heatmap.Span, width: int, cap: int, mirror: bool) -> str:
    (a0, a1), (t0, t1) = anchor.limits, target.limits
    parts = [f"select abs(anchor_pos) as x, abs(target_pos) as y, false as mirrored from pets where anchor_chr = '{anchor.chr}' and target_chr = '{target.chr}'"]
    if anchor.chr != target.chr:
        parts.append(f"select abs(target_pos), abs(anchor_pos), false from pets where anchor_chr = '{target.chr}' and target_chr = '{anchor.chr}'")
    elif mirror:
        parts.append(f"select abs(target_pos), abs(anchor_pos), true from pets where anchor_chr = '{anchor.chr}' and target_chr = '{anchor.chr}'")
    return f"""with pets as ({fx.PETS_SQL}), pts as ({" union all ".join(parts)})
select mirrored, cast(x // {width} as bigint) as anchor_bin, cast(y // {width} as bigint) as target_bin, count(*) as count, least(1.0, count(*) / cast({cap} as double)) as alpha
from pts where x between {a0} and {a1} and y between {t0} and {t1} group by 1, 2, 3 having not (mirrored and anchor_bin = target_bin)"""


_ONE, _TWO = heatmap.Span("chrC", 2000, 25000), heatmap.Span("chrA", 1, 18000)


@query("heatmap_bins", _heat_oracle(_TWO, _ONE, 1000, 50, True))
def heatmap_bins(spark: SparkSession, sf: str) -> DataFrame:
    return heatmap.heatmap_bins(fx.pets(spark, sf), _TWO, _ONE)


@query("heatmap_mirrored", _heat_oracle(_ONE, _ONE, 500, 20, True))
def heatmap_mirrored(spark: SparkSession, sf: str) -> DataFrame:
    return heatmap.heatmap_bins(fx.pets(spark, sf), _ONE, width=500, cap=20)


#: A box at every point that a pair has, of widths that follow from the point; some are much wider than others.
_BOX_ID = "((strpos('ABCDM', right(anchor_chr, 1)) * 8 + strpos('ABCDM', right(target_chr, 1))) * 1000000 + x) * 1000000 + y"
_WIDTH_A, _WIDTH_T = "20 + (x * 7 + y) % 180 + case when (x + y) % 97 = 0 then 1500 else 0 end", "20 + (x + y * 3) % 180"
_TOLERANCE = 150
_BOXES_SQL = f"""select cast({_BOX_ID} as bigint) as box_id, anchor_chr, target_chr, x as start_a, x + {_WIDTH_A} as end_a, y as start_t, y + {_WIDTH_T} as end_t
  from (select distinct anchor_chr, target_chr, cast(abs(anchor_pos) as bigint) as x, cast(abs(target_pos) as bigint) as y from ({fx.PETS_SQL}))"""
#: Links by an equi-join on cells of 1000 bases: all that the oracles share with the engine is that they are met in cells.
_LINKS_SQL = f"""b as materialized ({_BOXES_SQL}),
e as (select *, end_a + {_TOLERANCE} as more_a, end_t + {_TOLERANCE} as more_t, unnest(generate_series(start_a // 1000, (end_a + {_TOLERANCE} - 1) // 1000)) as ca from b),
c as materialized (select *, unnest(generate_series(start_t // 1000, (more_t - 1) // 1000)) as ct from e),
l as materialized (select distinct x.box_id as a, y.box_id as b from c x join c y on x.anchor_chr = y.anchor_chr and x.target_chr = y.target_chr and x.ca = y.ca and x.ct = y.ct
  and x.box_id <> y.box_id and x.start_a < y.more_a and y.start_a < x.more_a and x.start_t < y.more_t and y.start_t < x.more_t)"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes for each pair: pairs at one point give the same box again."""
    keys = ["anchor_chr", "target_chr"]
    place = lambda c: F.instr(F.lit("ABCDM"), F.substring(c, -1, 1)).cast("long")
    points = fx.pets(spark, sf).select(*keys, F.abs("anchor_pos").cast("long").alias("x"), F.abs("target_pos").cast("long").alias("y"))
    box_id = ((place("anchor_chr") * 8 + place("target_chr")) * 1_000_000 + F.col("x")) * 1_000_000 + F.col("y")
    ends = (F.col("x") + F.expr(_WIDTH_A)).alias("end_a"), F.col("y").alias("start_t"), (F.col("y") + F.expr(_WIDTH_T)).alias("end_t")
    return points.select(box_id.alias("box_id"), *keys, F.col("x").alias("start_a"), *ends)


@query(
    "cluster_boxes",
    f"""with recursive {_LINKS_SQL}, r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b)
select box_id, least(box_id, coalesce(min(r.b), box_id)) as cluster_id from b left join r on r.a = box_id group by 1""",
)
def cluster_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster_boxes(_boxes(spark, sf), _TOLERANCE)


@query("cluster_links", f"with {_LINKS_SQL} select a, b from l where a < b")
def cluster_links(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.box_links(_boxes(spark, sf), _TOLERANCE)


# --- statistics ---------------------------------------------------------------------------------

#: Totals stand in for library sizes, fixed so that both engines use the same numbers.
TOTALS = {f: 10_000 + 500 * k for k, f in enumerate(FILES)}
_MEAN = sum(TOTALS.values()) / len(TOTALS)


def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of window pairs as a stored table, which the statistics start from."""
    return fx.stored(spark, sf, "window_counts", lambda: counting.count_windows(fx.pets(spark, sf), fx.lengths(spark), FILES, Grid(5000), 1, 20))


_CB = f"cb as ({_window_oracle(Grid(5000), 1, 20)})"
_SCALED = "(" + " + ".join(f'"{f}" / {t}.0 * {_MEAN}' for f, t in TOTALS.items()) + f") / {len(FILES)}"


@query("log_cpm", f"with {_CB} select anchor_id, target_id, " + ", ".join(f'round(log2(("{f}" + {2.0 * t / _MEAN}) / {t + 4.0 * t / _MEAN} * 1e6), 6) as "{f}"' for f, t in TOTALS.items()) + " from cb")
def log_cpm(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.log_cpm(window_counts(spark, sf), TOTALS)
    return out.select("anchor_id", "target_id", *[F.round(f, 6).alias(f) for f in FILES])


@query("abundance_filter", f"with {_CB} select anchor_id, target_id, round(log2(({_SCALED} + 2) / {_MEAN + 4} * 1e6), 6) as ave_log_cpm from cb where log2(({_SCALED} + 2) / {_MEAN + 4} * 1e6) > 9.0")
def abundance_filter(spark: SparkSession, sf: str) -> DataFrame:
    return stats.average_log_cpm(window_counts(spark, sf), TOTALS).where("ave_log_cpm > 9.0").select("anchor_id", "target_id", F.round("ave_log_cpm", 6).alias("ave_log_cpm"))


@query("scaled_threshold", f"with {_CB} select round(median(log2(({_SCALED} / 4.0 + 2) / {_MEAN + 4} * 1e6)) + log2(5), 6) as threshold from cb")
def scaled_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return stats.scaled_threshold(window_counts(spark, sf), TOTALS, 4.0).select(F.round("threshold", 6).alias("threshold"))


@query("ma_values", f'with {_CB} select anchor_id, target_id, round(log2("libF_AA" + 0.5) - log2("libF_AB" + 0.5), 6) as m, round((log2("libF_AA" + 0.5) + log2("libF_AB" + 0.5)) / 2, 6) as a from cb')
def ma_values(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.ma_values(window_counts(spark, sf), "libF_AA", "libF_AB")
    return out.select("anchor_id", "target_id", F.round("m", 6).alias("m"), F.round("a", 6).alias("a"))


_HWE = f"""{_CB}, h as (select anchor_id, target_id, cast("libO_AA" as double) as aa, cast("libO_AB" as double) as ab, cast("libO_BB" as double) as bb from cb where "libO_AA" + "libO_AB" > 0 and "libO_AB" + "libO_BB" > 0),
f as (select *, aa + ab + bb as n, (2 * aa + ab) / (aa + ab + bb) / 2 as p from h),
t as (select *, power(aa - n*p*p, 2) / (n*p*p) + power(ab - n*2*p*(1-p), 2) / (n*2*p*(1-p)) + power(bb - n*(1-p)*(1-p), 2) / (n*(1-p)*(1-p)) as x from f)"""


def _hwe(spark: SparkSession, sf: str) -> DataFrame:
    stat, p = stats.hwe_chisq(*[F.col(f).cast("double") for f in ("libO_AA", "libO_AB", "libO_BB")])
    rows = window_counts(spark, sf).where("libO_AA + libO_AB > 0 and libO_AB + libO_BB > 0")
    return rows.select("anchor_id", "target_id", F.round(stat, 6).alias("chisq"), F.round(p, 8).alias("pvalue"))


@query("hwe_chisq", f"with {_HWE} select anchor_id, target_id, round(x, 6) as chisq, round(exp(-x / 2), 8) as pvalue from t")
def hwe_chisq(spark: SparkSession, sf: str) -> DataFrame:
    return _hwe(spark, sf)


@query(
    "bh_adjust",
    f"""with {_HWE}, q as (select anchor_id, target_id, round(exp(-x / 2), 8) as pvalue from t), r as (select *, count(*) over () as n, count(*) over (order by pvalue) as rk from q)
select anchor_id, target_id, pvalue, round(least(1.0, min(pvalue * n / rk) over (order by rk desc)), 6) as fdr from r""",
)
def bh_adjust(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.bh_adjust(_hwe(spark, sf).select("anchor_id", "target_id", "pvalue"))
    return out.select("anchor_id", "target_id", "pvalue", F.round("fdr", 6).alias("fdr"))


@query("top_pairs", f"with {_HWE}, q as (select anchor_id, target_id, round(exp(-x / 2), 8) as pvalue from t) select * from q order by pvalue, anchor_id, target_id limit 20")
def top_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _hwe(spark, sf).select("anchor_id", "target_id", "pvalue").orderBy("pvalue", "anchor_id", "target_id").limit(20)


_TMM_PARTS = " union all ".join(
    f"""select '{f}' as file, "{f}" / {float(t)} as x, "libF_AA" / {float(TOTALS["libF_AA"])} as r, "{f}" as o, "libF_AA" as q from cb where "{f}" > 0 and "libF_AA" > 0"""
    for f, t in TOTALS.items()
)


def _tmm_oracle(weight: str) -> str:
    return f"""with {_CB}, parts as ({_TMM_PARTS}), l as (select file, log2(x / r) as m, log2(x * r) / 2 as a, {weight} as w from parts),
q as (select file, quantile_cont(m, 0.3) - 1e-9 as m0, quantile_cont(m, 0.7) + 1e-9 as m1, quantile_cont(a, 0.05) - 1e-9 as a0, quantile_cont(a, 0.95) + 1e-9 as a1 from l group by 1),
g as (select file, sum(m * w) / sum(w) as lf from l join q using (file) where m between m0 and m1 and a between a0 and a1 group by 1)
select file, round(power(2, lf - (select avg(lf) from g)), 6) as factor from g"""


@query("tmm_factors", _tmm_oracle("1.0"))
def tmm_factors(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tmm_factors(window_counts(spark, sf), TOTALS, "libF_AA").select("file", F.round("factor", 6).alias("factor"))


@query("normalize", _tmm_oracle("1 / ((1 - x) / o + (1 - r) / q)"))
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    data = InteractionSet.make(window_counts(spark, sf), make_windows(fx.lengths(spark), Grid(5000)).withColumnRenamed("window_id", "region_id"), FILES)
    return data.normalize(TOTALS, "libF_AA").select("file", F.round("factor", 6).alias("factor"))


# --- count models -------------------------------------------------------------------------------

_DISPERSION = 0.05
_PRIORS = {f: 2.0 * t / _MEAN for f, t in TOTALS.items()}
#: The abundance at which the slope of the likelihood is zero, by bisection.
_SLOPE = " + ".join(f'("{f}" + {_PRIORS[f]} - {t + 2 * _PRIORS[f]} * exp(m)) / (1 + {_DISPERSION} * {t + 2 * _PRIORS[f]} * exp(m))' for f, t in TOTALS.items())


@query(
    "fitted_log_cpm",
    f"""with recursive {_CB.replace("cb as", "cb as materialized")}, s(i, anchor_id, target_id, lo, hi) as (select 0, anchor_id, target_id, -40.0::double, 5.0::double from cb
  union all select i + 1, anchor_id, target_id, case when slope > 0 then m else lo end, case when slope > 0 then hi else m end
  from (select s.i, s.lo, s.hi, s.m, cb.anchor_id, cb.target_id, {_SLOPE} as slope from (select *, (lo + hi) / 2 as m from s where i < 60) s join cb on cb.anchor_id = s.anchor_id and cb.target_id = s.target_id))
select anchor_id, target_id, round(((lo + hi) / 2 + ln(1e6)) / ln(2), 6) as ave_log_cpm from s where i = 60""",
)
def fitted_log_cpm(spark: SparkSession, sf: str) -> DataFrame:
    out = models.fitted_log_cpm(window_counts(spark, sf), TOTALS, _DISPERSION)
    return out.select("anchor_id", "target_id", F.round("ave_log_cpm", 6).alias("ave_log_cpm"))


_LEVEL = f"round(log2(({_SCALED} + 2) / {_MEAN + 4} * 1e6), 9)"
_WSUMS = ", ".join(f'sum(w * ln("{f}" + 0.5)) as s{k}, sum(w * d * ln("{f}" + 0.5)) as d{k}' for k, f in enumerate(FILES))
_FITS = ", ".join(f"(wdd * s{k} - wd * d{k}) / (w * wdd - wd * wd) as v{k}" for k in range(len(FILES)))
_NEXT = ", ".join(f"lead(v{k}) over (order by kx) as n{k}" for k in range(len(FILES)))
_AT = [f"(v{k} + coalesce((x - kx) / (nx - kx) * (n{k} - v{k}), 0))" for k in range(len(FILES))]


@query(
    "loess_offsets",
    f"""with {_CB}, r as (select *, {_LEVEL} as x from cb), o as (select x, row_number() over (order by x) - 1 as place, count(*) over () as n from r),
k as (select j, x as kx from range(0, {models.KNOTS}) as t(j) join o on place = j * (n - 1) // {models.KNOTS - 1}),
h as (select k.j, k.kx, greatest(k.kx - lo.kx, hi.kx - k.kx) as h from k join k lo on lo.j = least(greatest(k.j - {models.WINDOW // 2}, 0), {models.KNOTS - 1 - models.WINDOW}) join k hi on hi.j = lo.j + {models.WINDOW}
  where k.j in (select min(j) from k group by kx)),
e as (select kx, x - kx as d, power(1 - power(abs(x - kx) / h, 3), 3) as w, r.* from h join r on abs(x - kx) <= h),
s as (select kx, sum(w) as w, sum(w * d) as wd, sum(w * d * d) as wdd, {_WSUMS} from e group by 1),
f as (select kx, {_FITS} from s), g as (select *, lead(kx) over (order by kx) as nx, {_NEXT} from f),
p as (select anchor_id, target_id, {", ".join(f"{at} as o{k}" for k, at in enumerate(_AT))} from r asof join g on r.x >= g.kx)
select anchor_id, target_id, {", ".join(f'round(o{k} - ({" + ".join(f"o{i}" for i in range(len(FILES)))}) / {len(FILES)}, 6) as "{f}"' for k, f in enumerate(FILES))} from p""",
)
def loess_offsets(spark: SparkSession, sf: str) -> DataFrame:
    data = InteractionSet.make(window_counts(spark, sf), make_windows(fx.lengths(spark), Grid(5000)).withColumnRenamed("window_id", "region_id"), FILES)
    return data.loess_offsets(TOTALS, F.round(stats.log_mean(TOTALS), 9)).select("anchor_id", "target_id", *[F.round(f, 6).alias(f) for f in FILES])


#: A fit of two groups, mixed linkers against equal ones, is a fit of each by itself; each by bisection.
_MIXED, _EQUAL = [f for f in FILES if f.endswith("AB")], [f for f in FILES if not f.endswith("AB")]


def _fits_sql(rows: str, grid: tuple[float, ...]) -> str:
    group = lambda name, files: f"select anchor_id, target_id, '{name}' as g, [{', '.join(chr(34) + f + chr(34) for f in files)}]::double[] as y, [{', '.join(str(float(TOTALS[f])) for f in files)}]::double[] as l from {rows}"
    mu = "list_transform(l, lambda v: v * exp(b))"
    return f"""u as materialized (select *, list_sum(y) as sum_y from ({group("mixed", _MIXED)} union all {group("equal", _EQUAL)} union all {group("all", list(FILES))}) cross join (select unnest({list(grid)}::double[]) as phi)),
s(i, anchor_id, target_id, g, phi, y, l, lo, hi) as (select 0, anchor_id, target_id, g, phi, y, l, ln(sum_y / list_sum(l)) - 8.0, ln(sum_y / list_sum(l)) + 8.0 from u
  union all select i + 1, anchor_id, target_id, g, phi, y, l, case when slope > 0 then m else lo end, case when slope > 0 then hi else m end
  from (select *, list_sum(list_transform(range(1, len(y) + 1), lambda k: (y[k] - l[k] * exp(m)) / (1 + phi * l[k] * exp(m)))) as slope from (select *, (lo + hi) / 2 as m from s where i < 56))),
b as (select *, (lo + hi) / 2 as b from s where i = 56), z as (select *, {mu} as mu from b),
fit as (select anchor_id, target_id, g, phi, b,
  list_sum(list_transform(range(1, len(y) + 1), lambda k: lgamma(y[k] + 1 / phi) - lgamma(1 / phi) - lgamma(y[k] + 1) - ln(1 + mu[k] * phi) / phi + case when y[k] > 0 then y[k] * ln(mu[k] * phi / (1 + mu[k] * phi)) else 0 end)) as ll,
  list_sum(list_transform(mu, lambda v: v / (1 + phi * v))) as info from z)"""


_BOTH_SEEN = " and ".join(f"({' + '.join(chr(34) + f + chr(34) for f in files)}) > 0" for files in (_MIXED, _EQUAL))


def _model(spark: SparkSession, sf: str) -> models.Model:
    info = interactions(spark, sf).info.select("file", F.contains("file", F.lit("AB")).alias("hetero"))
    return models.Model.of(info.select("file", F.lit(1).alias("intercept"), F.col("hetero").cast("int").alias("hetero")), TOTALS)


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return window_counts(spark, sf).where(_BOTH_SEEN.replace(chr(34), "`"))


@query(
    "coefficient_tests",
    f"""with recursive {_CB}, seen as materialized (select * from cb where {_BOTH_SEEN}), {_fits_sql("seen", (_DISPERSION,))}
select m.anchor_id, m.target_id, round((m.b - e.b) / ln(2), 5) as log_fold, round(greatest(2 * (m.ll + e.ll - a.ll), 0), 5) as ratio from fit m join fit e using (anchor_id, target_id) join fit a using (anchor_id, target_id)
where m.g = 'mixed' and e.g = 'equal' and a.g = 'all'""",
)
def coefficient_tests(spark: SparkSession, sf: str) -> DataFrame:
    out = models.coefficient_test(_seen(spark, sf), _model(spark, sf), 1, _DISPERSION)
    return out.select("anchor_id", "target_id", F.round("log_fold", 5).alias("log_fold"), F.round("ratio", 5).alias("ratio"))


_GRID = (0.02, 0.1, 0.5)


@query(
    "dispersion_grid",
    f"""with recursive {_CB}, seen as materialized (select * from cb where {_BOTH_SEEN}), {_fits_sql("seen", _GRID)}
select phi as dispersion, round(sum(ll - 0.5 * ln(info)), 2) as likelihood from fit where g <> 'all' group by 1""",
)
def dispersion_grid(spark: SparkSession, sf: str) -> DataFrame:
    found = models.grid_likelihoods(_seen(spark, sf), _model(spark, sf), _GRID)
    return spark.createDataFrame([(d, round(v, 2)) for d, v in found.items()], "dispersion double, likelihood double")


@query("one_way_design", "select file, cast(contains(file, 'AB') as int) as mixed, cast(not contains(file, 'AB') as int) as equal from (values " + ", ".join(f"('{f}')" for f in FILES) + ") as t(file)")
def one_way_design(spark: SparkSession, sf: str) -> DataFrame:
    kinds = interactions(spark, sf).info.withColumn("kind", F.when(F.contains("file", F.lit("AB")), "mixed").otherwise("equal"))
    return stats.one_way_design(kinds, "kind", ("mixed", "equal"))


@query("model_tests")
def model_tests(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: common dispersion, a test of mixed linkers in each pair, false discovery rates."""
    counts, model = window_counts(spark, sf), _model(spark, sf)
    tests = models.coefficient_test(counts, model, 1, models.common_dispersion(counts, model))
    return stats.bh_adjust(tests)


@query(
    "result_table",
    f"""with {_HWE}, {_windows_cte(Grid(5000))}, w as (select id, chr, greatest(1, c) as s, least(length, c + 4999) as e from win),
q as (select anchor_id, target_id, round(exp(-x / 2), 8) as pvalue from t), r as (select *, count(*) over () as n, count(*) over (order by pvalue) as rk from q)
select a.chr as anchor_chr, cast(a.s as int) as anchor_start, cast(a.e as int) as anchor_end, t.chr as target_chr, cast(t.s as int) as target_start, cast(t.e as int) as target_end, pvalue,
  round(least(1.0, min(pvalue * n / rk) over (order by rk desc)), 6) as fdr from r join w a on a.id = anchor_id join w t on t.id = target_id""",
)
def result_table(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered table of results as a tab-separated file with a header, read again."""
    windows = make_windows(fx.lengths(spark), Grid(5000)).withColumnRenamed("window_id", "region_id")
    data = InteractionSet.make(window_counts(spark, sf), windows, FILES)
    rows = data.result_table(_hwe(spark, sf).select("anchor_id", "target_id", "pvalue"))
    path = fx.folder(spark)
    text.write_table(rows.withColumn("fdr", F.round("fdr", 6)), path, header=True)
    sides = ", ".join(f"{x}_chr string, {x}_start int, {x}_end int" for x in ("anchor", "target"))
    return spark.read.csv(path, sep="\t", header=True, schema=f"{sides}, pvalue double, fdr double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window-pair counts of the smallest tables, with a filter that leaves rows."""
    return counting.count_windows(fx.pets(spark, sf_dir), fx.lengths(spark), FILES, Grid(5000), 1, 5)
