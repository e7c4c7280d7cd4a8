"""Pairing of alignments by read name into tag pairs, with diagnostics from the same aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

UNMAPPED, REVERSE, DUPLICATE = 0x4, 0x10, 0x400


def _has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def mate(min_mapq: int | None = None) -> Column:
    """What pairing needs of an alignment that has its chromosome's place in the header."""
    bad = _has(F.col("flag"), UNMAPPED)
    if min_mapq is not None:
        bad = bad | (F.col("mapq") < min_mapq)
    end = F.when(_has(F.col("flag"), REVERSE), F.col("pos")).otherwise(F.col("pos") + F.col("qwidth") - 1)
    return F.struct(
        "ord",
        F.col("rname").alias("chr"),
        end.alias("end"),
        F.when(_has(F.col("flag"), REVERSE), -end).otherwise(end).alias("signed"),
        "header_ord",
        bad.alias("bad"),
        _has(F.col("flag"), DUPLICATE).alias("marked"),
    )


def read_groups(alignments: DataFrame, header: DataFrame, min_mapq: int | None = None) -> DataFrame:
    """One row per read name: how many alignments, and first and second by their order in the file.

    Names are grouped wherever they are, so the input need not be sorted.
    """
    placed = alignments.join(header.select(F.col("chr").alias("rname"), "header_ord"), "rname", "left")
    return placed.groupBy("qname").agg(F.count("*").alias("n"), F.min(mate(min_mapq)).alias("one"), F.max(mate(min_mapq)).alias("two"))


def _outcome(groups: DataFrame, dedup: bool) -> DataFrame:
    pair = F.col("n") == 2
    marked = pair & (F.col("one.marked") | F.col("two.marked"))
    filtered = pair & (F.col("one.bad") | F.col("two.bad"))
    valid = pair & ~filtered & (~marked if dedup else F.lit(True))
    return groups.withColumns({"_pair": pair, "_marked": marked, "_filtered": filtered, "_valid": valid})


def _pairs(kept: DataFrame, file: str) -> DataFrame:
    one, two = "one", "two"
    # Ties go to the second read.
    first = (F.col("one.header_ord") > F.col("two.header_ord")) | ((F.col("one.header_ord") == F.col("two.header_ord")) & (F.col("one.end") > F.col("two.end")))
    pick = lambda a, b, f: F.when(first, F.col(f"{a}.{f}")).otherwise(F.col(f"{b}.{f}"))
    return kept.select(
        F.lit(file).alias("file"),
        pick(one, two, "chr").alias("anchor_chr"),
        pick(two, one, "chr").alias("target_chr"),
        pick(one, two, "signed").cast("int").alias("anchor_pos"),
        pick(two, one, "signed").cast("int").alias("target_pos"),
    )


def pair_alignments(alignments: DataFrame, header: DataFrame, file: str, dedup: bool = True, min_mapq: int | None = None) -> DataFrame:
    """Tag pairs: the end on the later chromosome of the header, or further along it, is the anchor."""
    return _pairs(_outcome(read_groups(alignments, header, min_mapq), dedup).where("_valid"), file)


def _counters() -> list[Column]:
    return [
        F.count_if(F.col("n") == 1).alias("singles"),
        F.count_if(F.col("n") > 2).alias("multi"),
        F.count_if("_pair").alias("total"),
        F.count_if("_marked").alias("marked"),
        F.count_if("_filtered").alias("filtered"),
        F.count_if("_valid").alias("valid"),
    ]


def pair_alignments_counted(alignments: DataFrame, header: DataFrame, file: str, dedup: bool = True, min_mapq: int | None = None) -> tuple[DataFrame, Observation]:
    """Tag pairs, and the counters of `pair_diagnostics` that the first pass over them (a write) fills."""
    counted = Observation()
    found = _outcome(read_groups(alignments, header, min_mapq), dedup).observe(counted, *_counters())
    return _pairs(found.where("_valid"), file), counted


def pair_diagnostics(alignments: DataFrame, header: DataFrame, dedup: bool = True, min_mapq: int | None = None) -> DataFrame:
    """singles, multi, total, marked, filtered, valid in one row."""
    return _outcome(read_groups(alignments, header, min_mapq), dedup).agg(*_counters())


def unknown_chromosomes(alignments: DataFrame, header: DataFrame) -> DataFrame:
    """Chromosome names of records that the header lacks; must be empty."""
    return alignments.select(F.col("rname").alias("chr")).distinct().join(header, "chr", "left_anti")
