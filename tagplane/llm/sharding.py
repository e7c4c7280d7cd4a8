"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; bytes are summed per slot; a versioned map says which
shard owns which slot. Rebalancing edits the last stored version of the map, moves whole slots, never
single records, and stores the next version; records are placed by the stored table.

Everything that touches rows is DataFrame functions. Only the map itself, whose size is the number
of slots and does not depend on the data, passes through the driver.

Defined cases: a null text counts as empty; a null key hashes by its text, so that such rows spread;
repeated rows share a slot and get positions of their own; an empty table gives an empty result
(and a map that deals the slots in turn); other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagplane.llm.common import checkpoint, shared_dir, table

N_SLOTS = 8192
N_SHARDS = 24
RECORD_OVERHEAD = 8
#: Rows that one positioning window holds at most, on average.
ROWS_PER_WINDOW = 50_000


@dataclass(frozen=True)
class SlotMap:
    """One version of the map; ``owner[slot]`` is the shard that holds the slot."""

    version: int
    n_shards: int
    owner: tuple[int, ...]

    @staticmethod
    def empty(n_slots: int, n_shards: int) -> SlotMap:
        return SlotMap(0, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """Columns version, n_shards, vslot, shard: one row per slot."""
        owners = F.from_json(F.lit(json.dumps(self.owner)), "array<int>")
        return spark.range(1).select(
            F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), F.posexplode(owners).alias("vslot", "shard")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.partitionBy("version").mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the last one if none is named; a row per slot comes to the driver."""
        rows = spark.read.parquet(path)
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == version).orderBy("vslot").collect()
        return SlotMap(int(version), found[0]["n_shards"], tuple(r["shard"] for r in found))

    @staticmethod
    def stored(spark: SparkSession, path: str, version: int) -> DataFrame:
        """vslot, shard of a stored version."""
        return spark.read.parquet(path).where(F.col("version") == version).select("vslot", "shard")


def rebalance(current: SlotMap, load: dict[int, int], n_shards: int, slack: float = 0.0) -> SlotMap:
    """The next version: move slots until no move of a slot lowers the fullest shard.

    ``load`` has the bytes of each slot that holds any. Slots of shards that no longer exist move
    first; then the largest slot that fits goes from the fullest shard to the emptiest.
    """
    owner = list(current.owner)
    filled = [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(owner):
        size = int(load.get(slot, 0))
        if shard < n_shards:
            filled[shard] += size
            held[shard].append((size, slot))
        else:
            homeless.append((size, slot))
    emptiest = [(filled[s], s) for s in range(n_shards)]
    heapq.heapify(emptiest)
    for size, slot in sorted(homeless, reverse=True):
        _, s = heapq.heappop(emptiest)
        owner[slot] = s
        filled[s] += size
        held[s].append((size, slot))
        heapq.heappush(emptiest, (filled[s], s))
    mean = sum(filled) / n_shards
    for h in held:
        h.sort()
    for _ in range(4 * len(owner)):
        high, low = max(range(n_shards), key=filled.__getitem__), min(range(n_shards), key=filled.__getitem__)
        gap = filled[high] - filled[low]
        if gap <= slack * mean or gap <= 1:
            break
        # A slot under the gap narrows it; the one nearest to half the gap narrows it most.
        best = min((x for x in held[high] if 0 < x[0] < gap), key=lambda x: (abs(2 * x[0] - gap), x[1]), default=None)
        if best is None:
            break
        held[high].remove(best)
        held[low].append(best)
        owner[best[1]] = low
        filled[high] -= best[0]
        filled[low] += best[0]
    return SlotMap(current.version + 1, n_shards, tuple(owner))


def with_slot(records: DataFrame, key: str, text: str, n_slots: int) -> DataFrame:
    """Narrow rows: key, size, text_crc32, hash and virtual slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))), F.xxhash64(body))
    return records.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + F.lit(RECORD_OVERHEAD)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        hashed.alias("hashed"),
        F.pmod(hashed, F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_loads(narrow: DataFrame) -> list:
    """Bytes and rows per slot; as many rows as there are slots at most."""
    return narrow.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()


def assign(
    records: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n_shards: int = N_SHARDS,
    n_slots: int = N_SLOTS,
    store: str | None = None,
) -> tuple[DataFrame, SlotMap]:
    """Shard and position of each record, and the map version that decided it.

    ``store`` is the folder of the map's versions; the last one in it is edited and the next one added.
    Without a folder a new one is made in the shared folder, whose first version deals slots in turn.
    """
    spark = records.sparkSession
    narrow = checkpoint(with_slot(records, key, text, n_slots))
    loads = slot_loads(narrow)
    if store is None:
        store = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
        SlotMap.empty(n_slots, n_shards).save(spark, store)
    owned = rebalance(SlotMap.load(spark, store), {r["vslot"]: r["bytes"] for r in loads}, n_shards)
    owned.save(spark, store)
    placed = narrow.join(F.broadcast(SlotMap.stored(spark, store, owned.version)), "vslot")  # a row per slot
    return positioned(placed, sum(r["n"] for r in loads), n_slots), owned


def positioned(placed: DataFrame, n_rows: int, n_slots: int) -> DataFrame:
    """Gapless positions from 0 within each shard.

    Rows are ranked within small pieces of a slot; a piece starts where the rows of the shard's
    earlier pieces end. No window holds more than a piece, and the table of pieces has a row per
    ``ROWS_PER_WINDOW`` records or per slot.
    """
    fan = max(1, -(-n_rows // (n_slots * ROWS_PER_WINDOW)))
    piece = F.pmod(F.shiftright("hashed", 20), F.lit(fan)).cast("int")
    pieces = placed.withColumn("piece", piece)
    sizes = pieces.groupBy("shard", "vslot", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "vslot", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = Window.partitionBy("vslot", "piece").orderBy("key", "text_crc32", "size")
    ranked = pieces.withColumn("rank", F.row_number().over(rank) - 1)
    return ranked.join(starts.drop("shard"), ["vslot", "piece"]).withColumn("slot", (F.col("start") + F.col("rank")).cast("long"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is `bytes`: shard sizes are near equal."""
    rows, _ = assign(table(spark, sf_dir, "documents"))
    return contract(rows)


def contract(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: shard and position of every document that is left."""
    rows, _ = assign(docs)
    return contract(rows)
