"""Quality control, merging and roll-up of tag pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagplane.functions.tags import flag, gap
from tagplane.operators.counting import restricted


def with_orientation(pets: DataFrame) -> DataFrame:
    return pets.withColumn("flag", flag(F.col("anchor_pos"), F.col("target_pos"))).withColumn("gap", gap(F.col("anchor_pos"), F.col("target_pos")))


def diagnose_intra(pets: DataFrame, restrict: Sequence[str] | None = None) -> DataFrame:
    """flag and gap of each pair within a chromosome."""
    return with_orientation(restricted(pets, restrict)).where("anchor_chr = target_chr").select("file", "flag", "gap")


def diagnose_inter(pets: DataFrame, restrict: Sequence[str] | None = None) -> DataFrame:
    """flag, count of pairs between chromosomes; all four flags are there."""
    counted = with_orientation(restricted(pets, restrict)).where("anchor_chr <> target_chr").groupBy("flag").agg(F.count("*").alias("count"))
    flags = pets.sparkSession.range(4).select(F.col("id").cast("int").alias("flag"))
    return flags.join(counted, "flag", "left").fillna(0, ["count"])


def gap_histogram(pets: DataFrame) -> DataFrame:
    """Pairs within a chromosome by flag and whole log2 of the gap."""
    wide = with_orientation(pets).where("anchor_chr = target_chr and gap > 0")
    return wide.groupBy("flag", F.floor(F.log2("gap") + 1e-9).cast("int").alias("log2_gap")).agg(F.count("*").alias("count"))


def _outward(pets: DataFrame, min_gap: int) -> tuple[DataFrame, object]:
    marked = with_orientation(pets)
    return marked, (F.col("anchor_chr") == F.col("target_chr")) & (F.col("flag") == 2) & (F.col("gap") < min_gap)


def strip_outward(pets: DataFrame, min_gap: int = 10_000) -> DataFrame:
    """The pairs without outward ones on one chromosome under the gap (self-ligation)."""
    marked, bad = _outward(pets, min_gap)
    return marked.where(~bad).select(*pets.columns)


def stripped(pets: DataFrame, min_gap: int = 10_000) -> DataFrame:
    """The discarded pairs as chr, start, end."""
    marked, bad = _outward(pets, min_gap)
    return marked.where(bad).select(F.col("anchor_chr").alias("chr"), (-F.col("target_pos")).alias("start"), F.col("anchor_pos").alias("end"))


def cross_counts(pets: DataFrame, lengths: DataFrame, name: str = "chrM", include_self: bool = False, restrict: Sequence[str] | None = None, times: str | None = None) -> DataFrame:
    """chr, count of pairs between each chromosome and ``name``, in either order; zeros are kept. Rows are
    ``times`` pairs each, if that column is named."""
    ends = restricted(pets, restrict).where((F.col("anchor_chr") == name) | (F.col("target_chr") == name))
    if not include_self:
        ends = ends.where("anchor_chr <> target_chr")
    other = F.when(F.col("anchor_chr") == name, F.col("target_chr")).otherwise(F.col("anchor_chr"))
    counted = ends.groupBy(other.alias("chr")).agg((F.count("*") if times is None else F.sum(times)).alias("count"))
    chroms = lengths.select("chr")
    if restrict is not None:
        chroms = chroms.where(F.col("chr").isin(*restrict))
    return chroms.join(counted, "chr", "left").fillna(0, ["count"])


def catalog(pets: DataFrame) -> DataFrame:
    """Pairs of each library and chromosome pair."""
    return pets.groupBy("file", "anchor_chr", "target_chr").agg(F.count("*").alias("n_pets"))


def genome_conflicts(lengths: DataFrame) -> DataFrame:
    """chr, length, n_files: entries of lengths(file, chr, length) that not all files have."""
    n_files = lengths.agg(F.countDistinct("file")).first()[0]
    return lengths.groupBy("chr", "length").agg(F.countDistinct("file").alias("n_files")).where(F.col("n_files") < n_files)


def same_genome(lengths: DataFrame) -> bool:
    """Whether lengths(file, chr, length) has the same chromosomes and lengths for each file."""
    return genome_conflicts(lengths).limit(1).count() == 0


def merge_libraries(pets: DataFrame, files: Sequence[str], name: str, lengths: DataFrame | None = None) -> DataFrame:
    """The pairs of several libraries under one name."""
    if not files:
        raise ValueError("at least one library is required")
    if lengths is not None and not same_genome(lengths.where(F.col("file").isin(*files))):
        raise ValueError("chromosome lengths differ between libraries")
    return pets.where(F.col("file").isin(*files)).withColumn("file", F.lit(name))


def pooled_ends(discarded: DataFrame, seed: int = 1) -> DataFrame:
    """One end of each discarded pair, with flipped strand, chosen by a hash so that reruns agree."""
    heads = F.substring(F.md5(F.concat_ws(":", "chr", "start", "end", F.lit(seed))), 1, 1) < "8"
    pos = F.when(heads, F.col("start")).otherwise(F.col("end"))
    return discarded.select("chr", F.abs(pos).alias("pos"), F.when(heads, "+").otherwise("-").alias("strand"))
