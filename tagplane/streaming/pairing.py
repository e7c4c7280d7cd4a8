"""Pairing of alignments that arrive in batches: reads wait in the state of the stream for their mates.

Each batch gives what it changes, as rows with a weight of plus or minus one. A read name whose second alignment arrives
makes a pair; should a third one arrive later, the pair is taken back and the name counts as one with many. So the
sums over all batches are what one run over all alignments gives, wherever batches cut, and after a restart too.
Names are dealt into buckets, and the state of a bucket is one compressed table, so that a batch costs a call per
bucket and not per name. Buckets are as many as keep each small: a call holds one in memory, some times over.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagplane.functions.intervals import Grid
from tagplane.operators.counting import count_windows
from tagplane.operators.pairing import mate
from tagplane.schema import ALIGNMENTS

BUCKETS = 200
COUNTERS = ("singles", "multi", "total", "marked", "filtered", "valid")
DELTAS = "kind string, anchor_chr string, target_chr string, anchor_pos int, target_pos int, weight long"
#: Alignments of one name that the state keeps: with three, a name has many, whatever else arrives.
KEPT = 3


def packed(reads: pd.DataFrame) -> bytes:
    """Alignments of a bucket as compressed columns, by name: the state is held in the memory of executors."""
    table = pa.Table.from_pandas(reads.sort_values(["qname", "ord"], kind="stable"), preserve_index=False)
    table = table.set_column(table.schema.get_field_index("qname"), "qname", table["qname"].cast(pa.string()))
    out = io.BytesIO()
    pq.write_table(table, out, compression="zstd", column_encoding={"qname": "DELTA_BYTE_ARRAY"}, use_dictionary=["chr", "header_ord"])
    return out.getvalue()


def unpacked(state: bytes) -> pd.DataFrame:
    return pq.read_table(io.BytesIO(state)).to_pandas()


def outcomes(reads: pd.DataFrame, dedup: bool) -> tuple[pd.DataFrame, dict[str, int]]:
    """The pairs that some alignments of whole names make, and the counters."""
    reads = reads.sort_values(["qname", "ord"], kind="stable")
    n = reads.groupby("qname", sort=False)["ord"].transform("size")
    two = reads[n == 2]
    one, other = two.iloc[0::2].reset_index(drop=True), two.iloc[1::2].reset_index(drop=True)
    marked, bad = one["marked"] | other["marked"], one["bad"] | other["bad"]
    valid = ~bad & ~marked if dedup else ~bad
    # Ties go to the second read.
    first = (one["header_ord"] > other["header_ord"]) | ((one["header_ord"] == other["header_ord"]) & (one["end"] > other["end"]))
    pick = lambda c, mine: one[c].where(first == mine, other[c])[valid]
    pairs = pd.DataFrame({"anchor_chr": pick("chr", True), "target_chr": pick("chr", False), "anchor_pos": pick("signed", True), "target_pos": pick("signed", False)})
    names = reads["qname"][n > 2].nunique()
    found = (int((n == 1).sum()), int(names), len(one), int(marked.sum()), int(bad.sum()), int(valid.sum()))
    return pairs, dict(zip(COUNTERS, found, strict=True))


def pair_deltas(alignments: DataFrame, header: DataFrame, dedup: bool = True, min_mapq: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """What each batch of a stream of alignments changes: rows of kind ``pair`` and of the counters, with weights."""
    placed = alignments.join(F.broadcast(header.select(F.col("chr").alias("rname"), "header_ord")), "rname", "left")
    reads = placed.select(F.pmod(F.xxhash64("qname"), F.lit(buckets)).cast("int").alias("bucket"), "qname", mate(min_mapq).alias("m")).select("bucket", "qname", "m.*")

    def change(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches), ignore_index=True).drop(columns="bucket")
        held = unpacked(state.get[0]) if state.exists else new.iloc[:0]
        touched = held["qname"].isin(new["qname"])
        before, now = held[touched], pd.concat([held[touched], new], ignore_index=True)
        rows = []
        for reads, sign in ((before, -1), (now, 1)):
            pairs, counters = outcomes(reads, dedup)
            rows.append(pairs.assign(kind="pair", weight=sign))
            rows.append(pd.DataFrame([{"kind": k, "weight": sign * v} for k, v in counters.items() if v], columns=["kind", "weight"]))
        kept = pd.concat([held[~touched], now[now.groupby("qname").cumcount() < KEPT]], ignore_index=True)
        state.update((packed(kept),))
        out = pd.concat(rows, ignore_index=True).reindex(columns=["kind", "anchor_chr", "target_chr", "anchor_pos", "target_pos", "weight"])
        yield out.astype({"anchor_pos": "Int32", "target_pos": "Int32", "weight": "int64"})

    return reads.groupBy("bucket").applyInPandasWithState(change, DELTAS, "held binary", "append", "NoTimeout")


def write_pairs(stream: DataFrame, header: DataFrame, out: str, checkpoint: str, dedup: bool = True, min_mapq: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Append what each batch changes under its number; a batch that is run again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("kind", "anchor_chr", "target_chr", "anchor_pos", "target_pos").agg(F.sum("weight").alias("weight")).where("weight <> 0").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pair_deltas(stream, header, dedup, min_mapq, buckets).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(DELTAS).parquet(f"{out}/batch=*")


def paired(spark: SparkSession, out: str, file: str) -> DataFrame:
    """Points that all batches so far have made, as a library, with their weights."""
    rows = _written(spark, out).where("kind = 'pair'").groupBy("anchor_chr", "target_chr", "anchor_pos", "target_pos").agg(F.sum("weight").alias("weight"))
    return rows.where("weight > 0").select(F.lit(file).alias("file"), "anchor_chr", "target_chr", "anchor_pos", "target_pos", "weight")


def diagnostics(spark: SparkSession, out: str) -> DataFrame:
    """singles, multi, total, marked, filtered, valid of all batches so far, in one row."""
    value = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0)).alias(k)
    return _written(spark, out).agg(*[value(k) for k in COUNTERS])


def window_counts(spark: SparkSession, out: str, lengths: DataFrame, file: str, grid: Grid = Grid(), ext: int = 1, least: int = 20) -> DataFrame:
    """Window-pair counts of what has been paired so far."""
    return count_windows(paired(spark, out, file), lengths, [file], grid, ext, least, weight="weight")


def read_alignments(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(ALIGNMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)

