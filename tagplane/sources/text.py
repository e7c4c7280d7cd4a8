"""Readers and writers of sequencing text: FASTQ pairs, SAM, region tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagplane.functions.graph import checkpoint


#: Up to so many blocks of text the table of their first lines goes to every task, at about a hundred bytes each.
BROADCAST_BLOCKS = 100_000


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, block (file and place of the split that a line is read in) and id, ascending within a block."""
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return spark.read.text(path).select("value", block.alias("block"), F.monotonically_increasing_id().alias("id"))


def counted_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """line, value of a text file or of the part files of a folder in order of name, whatever splits they are
    read in; and how many lines there are.

    A first pass counts the lines of each split and notes the id of its first one. The second pass looks up
    where its split starts and numbers each line by its distance from the first one: lines are not moved. A
    compressed file has one split: large ones should be compressed in blocks or stored as parts.
    """
    raw = _raw_lines(spark, path)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over a row per split
    sizes = raw.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    starts = checkpoint(sizes.select("block", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")))
    found = starts.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    shifts = starts.select("block", "shift")
    if found["blocks"] <= BROADCAST_BLOCKS:
        shifts = F.broadcast(shifts)
    return raw.join(shifts, "block").select((F.col("id") + F.col("shift")).alias("line"), "value"), found["n"] or 0


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return counted_lines(spark, path)[0]


_FIELDS = ("header", "seq", "plus", "qual")


def read_fastq_pairs(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """Read pairs by ordinal: the lines of both files meet in one shuffle. Unequal or truncated files are an
    error, which the counts of lines tell before anything is read in full."""
    files = [counted_lines(spark, path) for path in (path1, path2)]
    n1, n2 = (-(-n // 4) for _, n in files)
    if n1 != n2:
        raise ValueError(f"unbalanced numbers of reads: {n1} and {n2}")
    if any(n % 4 for _, n in files):
        raise ValueError("a file is truncated before the end of a record")
    lines = files[0][0].withColumn("mate", F.lit(1)).unionByName(files[1][0].withColumn("mate", F.lit(2)))
    own = lambda m, k: F.max(F.when((F.col("mate") == m) & (F.col("line") % 4 == k), F.col("value")))
    return lines.groupBy(F.floor(F.col("line") / 4).alias("pair_id")).agg(*[own(m, k).alias(f"{c}{m}") for m in (1, 2) for k, c in enumerate(_FIELDS)])


def write_split_fastq(split: DataFrame, path: str) -> None:
    """Text files in folders by linker and mate, records in the order of the pairs within a file."""
    record = lambda m: F.concat_ws("\n", *[F.col(f"{c}{m}") for c in ("header", "seq", "plus", "qual")])
    both = split.select("pair_id", "linker", F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), record(m).alias("value")) for m in (1, 2)])).alias("r"))
    rows = both.select("pair_id", "linker", "r.mate", "r.value").repartitionByRange("linker", "mate", "pair_id").sortWithinPartitions("linker", "mate", "pair_id")
    rows.select("linker", "mate", "value").write.mode("overwrite").partitionBy("linker", "mate").text(path)


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """chr, length, header_ord from the reference lines of a SAM file's header, which alone are put in order."""
    lines = _raw_lines(spark, path).where(F.col("value").startswith("@SQ"))
    order = F.row_number().over(Window.orderBy("block", "id"))
    return lines.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chr"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("length"), order.alias("header_ord"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments; the query width is the sum of the operations that use up the read."""
    fields = F.split("value", "\t")
    used = F.regexp_extract_all(fields[5], F.lit(r"(\d+)[MIS=X]"), 1)
    width = F.aggregate(used, F.lit(0), lambda s, x: s + x.cast("int"))
    return (
        numbered_lines(spark, path)
        .where(~F.col("value").startswith("@") & (F.col("value") != ""))
        .select(
            fields[0].alias("qname"), F.col("line").alias("ord"), fields[1].cast("int").alias("flag"), fields[2].alias("rname"),
            fields[3].cast("int").alias("pos"), width.alias("qwidth"), fields[4].cast("int").alias("mapq"),
        )
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Sorted and numbered regions of a tab-separated table chr, start, end (closed, from 1)."""
    raw = spark.read.csv(path, sep="\t", schema="chr string, start int, end int")
    return number_regions(raw.withColumn("original", F.monotonically_increasing_id()))


def number_regions(regions: DataFrame) -> DataFrame:
    """region_id by chromosome, start, end; the window is over the regions of a query, not over data."""
    order = Window.orderBy("chr", "start", "end", "original")
    return regions.select(F.row_number().over(order).cast("long").alias("region_id"), "chr", "start", "end", "original")


def write_table(rows: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated part files; ordered rows stay in order over the names of the parts."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=header)


def write_lines(rows: DataFrame, path: str, order: tuple[str, ...], value: Column) -> None:
    """Text of each row, in order over the names of the parts."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(value.alias("value")).write.mode("overwrite").text(path)
