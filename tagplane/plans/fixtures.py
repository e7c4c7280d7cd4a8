"""Tables of the engine derived from the star-schema tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.sources import text
from tagplane.sources.store import TagStore

FILES = ("libF_AA", "libF_AB", "libF_BB", "libO_AA", "libO_AB", "libO_BB")

PETS = """
with raw as (
  select concat('lib', l_linestatus, '_', case l_returnflag when 'A' then 'AA' when 'N' then 'AB' else 'BB' end) as file,
    cast(l_suppkey % 5 as int) as ch1, cast(l_partkey % 5 as int) as ch2,
    cast((l_orderkey*31 + l_linenumber*17) % (20000 + 7001*(l_suppkey % 5)) + 1 as int) as p1,
    cast((l_orderkey*13 + l_partkey*7)     % (20000 + 7001*(l_partkey % 5)) + 1 as int) as p2,
    case when l_linenumber % 2 = 0 then 1 else -1 end as s1,
    case when cast(l_quantity as int) % 2 = 0 then 1 else -1 end as s2
  from {lineitem}),
o as (select *, (ch1 > ch2 or (ch1 = ch2 and p1 > p2)) as f from raw)
select file,
  concat('chr', substring('ABCDM', case when f then ch1 else ch2 end + 1, 1)) as anchor_chr,
  concat('chr', substring('ABCDM', case when f then ch2 else ch1 end + 1, 1)) as target_chr,
  case when f then p1*s1 else p2*s2 end as anchor_pos,
  case when f then p2*s2 else p1*s1 end as target_pos
from o
"""
LENGTHS = "select * from (values ('chrA',20000,1),('chrB',27001,2),('chrC',34002,3),('chrD',41003,4),('chrM',48004,5)) as t(chr,length,header_ord)"
REGIONS = """
select row_number() over (order by chr, start, {q}end{q}, s_suppkey) as region_id, chr, start, {q}end{q}, s_suppkey as original from (
  select s_suppkey, concat('chr', substring('ABCDM', cast(s_suppkey % 5 as int) + 1, 1)) as chr,
    cast((s_suppkey*373) % 18000 + 1 as int) as start,
    cast((s_suppkey*373) % 18000 + 21 + (s_suppkey*97) % 1480 as int) as {q}end{q}
  from {supplier}) r
"""
ALIGNMENTS = """
select concat('q.', o_orderkey) as qname, i as ord,
  cast((case when (o_orderkey + i) % 7 = 0 then 16 else 0 end)
     + (case when (o_orderkey + i*3) % 19 = 0 then 1024 else 0 end)
     + (case when (o_orderkey*5 + i) % 29 = 0 then 4 else 0 end) as int) as flag,
  concat('chr', substring('ABCDM', cast((o_custkey*i + o_orderkey) % 5 as int) + 1, 1)) as rname,
  cast((o_orderkey*31 + o_custkey*i*13) % 19000 + 1 as int) as pos,
  cast(20 + (o_orderkey % 3) as int) as qwidth, cast((o_orderkey*7 + i*11) % 43 as int) as mapq
from {orders} cross join (select * from (values (1),(2),(3)) as v(i)) vv
where i <= case when o_orderkey % 17 = 0 then 1 when o_orderkey % 23 = 0 then 3 else 2 end
"""
LINKER_A, LINKER_B = "GTTGGAATGTATATCG", "GTTGGATAAGATATCG"
#: Segments with their scores against both linkers.
SEGMENTS = (
    ("GTTGGAATGTATATCG", 16, 8),
    ("GTTGGATAAGATATCG", 8, 16),
    ("GTTGGAACCCATATCG", 10, 8),
    ("GTTGGATCCCATATCG", 8, 10),
    ("GTTGGACCCCATATCG", 8, 8),
    ("GTTGGAACCCCTATCG", 8, 6),
    ("GACTGTTATGCTATAC", 0, 0),
    ("GTCACGATGGAGCGGG", 0, 0),
)
_PICK = "case {key} " + " ".join(f"when {k} then '{s[0]}'" for k, s in enumerate(SEGMENTS)) + " end"
READS = f"""
select cast(o_orderkey as bigint) as pair_id, concat('@r', o_orderkey) as header1, concat(substring(md5(cast(o_orderkey as varchar({{n}}))), 1, 17), {_PICK.format(key="o_orderkey % 8")}) as seq1,
  '+' as plus1, repeat('I', 33) as qual1, concat('@r', o_orderkey) as header2,
  concat(substring(md5(cast(o_orderkey + 1 as varchar({{n}}))), 1, 17), {_PICK.format(key="cast(floor(o_orderkey / 8) as bigint) % 8")}) as seq2, '+' as plus2, repeat('J', 33) as qual2
from {{orders}}
"""


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


_stored: dict[tuple[str, str, str], str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/shared"
    return f"{shared.rstrip('/')}/fixtures/{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once in a session and read from the shared folder from then on.

    It is dealt into as many files as there are cores, since the driver's tables are one file each.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = folder(spark)
        make().repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def pets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag pairs, stored as a tag table would be, so that queries read positions and do not derive them."""
    return stored(spark, sf_dir, "pets", lambda: _sql(spark, sf_dir, PETS, "lineitem"))


def lengths(spark: SparkSession) -> DataFrame:
    return spark.sql(LENGTHS)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, REGIONS.replace("{q}", "`"), "supplier")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ALIGNMENTS, "orders")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, READS.replace("varchar({n})", "string"), "orders")


def store(spark: SparkSession, sf_dir: str) -> TagStore:
    """The pairs as a stored tag table with the lengths of each library; written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "store")
    if key not in _stored:
        path = folder(spark)
        each = lengths(spark).withColumn("file", F.explode(F.array(*[F.lit(f) for f in FILES]))).select("file", "chr", "length")
        TagStore(spark, path).write(pets(spark, sf_dir), each)
        _stored[key] = path
    return TagStore(spark, _stored[key])


def fastq(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of both mates' FASTQ text."""
    record = lambda m: F.concat_ws("\n", *[F.col(f"{c}{m}") for c in ("header", "seq", "plus", "qual")])
    paths = folder(spark), folder(spark)
    for mate, path in enumerate(paths, 1):
        text.write_lines(reads(spark, sf_dir), path, ("pair_id",), record(mate))
    return paths


def sam(spark: SparkSession, sf_dir: str) -> str:
    """Path of the alignments as SAM text: header lines first, then records by name."""
    head = lengths(spark).select(F.lit("").alias("qname"), F.col("header_ord").alias("ord"), F.concat(F.lit("@SQ\tSN:"), "chr", F.lit("\tLN:"), "length").alias("line"))
    fields = ("qname", "flag", "rname", "pos", "mapq", F.concat("qwidth", F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    body = alignments(spark, sf_dir).select("qname", "ord", F.concat_ws("\t", *fields).alias("line"))
    path = folder(spark)
    text.write_lines(head.unionByName(body), path, ("qname", "ord"), F.col("line"))
    return path


PETS_SQL = PETS.format(lineitem="lineitem")
REGIONS_SQL = REGIONS.format(q='"', supplier="supplier")
ALIGNMENTS_SQL = ALIGNMENTS.format(orders="orders")
READS_SQL = READS.replace("varchar({n})", "varchar").format(orders="orders")
