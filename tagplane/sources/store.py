"""Stored tag pairs: Parquet by library and chromosome pair, with the chromosome lengths and a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tagplane.functions.tags import flag, gap
from tagplane.operators import qc
from tagplane.schema import PETS

KEYS = ["file", "anchor_chr", "target_chr"]
MANIFEST = "folder string, file string, anchor_chr string, target_chr string, n_pets long"


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


@dataclass(frozen=True)
class TagStore:
    """A folder of versions. A version is a manifest: which folders of pairs it has, and how many pairs of
    each library and chromosome pair. Writing makes new folders and then, by a file that only one writer can
    make, the next version; what earlier versions read stays, so a table can be rewritten from itself while it
    is read lazily. Adding a library writes that library and nothing else, and counts come from the manifest."""

    spark: SparkSession
    path: str
    rows_per_file: int = 5_000_000

    # The names of versions, made and listed through the file system that Spark reads.

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def last(self) -> int:
        """The last version; zero for an empty store. Names end in the number, so this is one listing."""
        fs, at = self._fs(f"{self.path}/versions")
        if not fs.exists(at):
            return 0
        return max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)

    def versions(self) -> list[int]:
        return list(range(1, self.last() + 1))

    def _commit(self, version: int, folder: str) -> int:
        """Name a version; fails if it is there, as the file system makes a file once."""
        fs, at = self._fs(f"{self.path}/versions/{version}")
        try:
            out = fs.create(at, False)
        except Exception as error:
            raise Conflict(f"version {version} is there already") from error
        out.write(bytearray(folder.encode()))
        out.close()
        return version

    def _manifest_of(self, version: int | None) -> str:
        version = self.last() if version is None else version
        if not version:
            raise ValueError(f"nothing is stored in {self.path}")
        fs, at = self._fs(f"{self.path}/versions/{version}")
        read = fs.open(at)
        try:
            return bytes(read.readAllBytes()).decode()
        finally:
            read.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """folder, file, anchor_chr, target_chr, n_pets: a row per stored partition."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._manifest_of(version)}")

    # Reading.

    def pets(self, version: int | None = None, files: Sequence[str] | None = None) -> DataFrame:
        """The pairs of a version; with ``files`` only folders that have these libraries are opened."""
        held = self.manifest(version)
        if files is not None:
            held = held.where(F.col("file").isin(*files))
        folders = [(r["folder"], r["files"]) for r in held.groupBy("folder").agg(F.collect_set("file").alias("files")).collect()]  # a row per write
        columns = [*KEYS, "anchor_pos", "target_pos"]
        read = lambda folder, own: self.spark.read.schema(PETS).parquet(f"{self.path}/pets/{folder}").where(F.col("file").isin(*own)).select(*columns)
        if not folders:
            return self.spark.createDataFrame([], PETS).select(*columns)
        return reduce(DataFrame.unionByName, [read(*f) for f in sorted(folders)])

    def lengths(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema("file string, chr string, length int").parquet(f"{self.path}/lengths/{self._manifest_of(version)}")

    def pairs(self, file: str, anchor: str, target: str) -> DataFrame:
        """One chromosome pair of one library; only its partition is read."""
        return self.pets(files=[file]).where((F.col("file") == file) & (F.col("anchor_chr") == anchor) & (F.col("target_chr") == target))

    def catalog(self, version: int | None = None) -> DataFrame:
        """Pairs of each library and chromosome pair, from the manifest."""
        return self.manifest(version).groupBy(*KEYS).agg(F.sum("n_pets").alias("n_pets"))

    def cross_counts(self, name: str = "chrM", include_self: bool = False, restrict: Sequence[str] | None = None) -> DataFrame:
        """chr, count of pairs with a chromosome, of all libraries; from the manifest, as `qc.cross_counts` from pairs."""
        return qc.cross_counts(self.catalog(), self.lengths().select("chr").distinct(), name, include_self, restrict, "n_pets")

    # Writing.

    def _store(self, pets: DataFrame) -> DataFrame:
        """Write pairs into a folder of their own; its rows of a manifest."""
        folder = uuid.uuid4().hex
        # A row per library and chromosome pair: its pairs, and how many files they are dealt into.
        sizes = f"{self.path}/sizes/{folder}"
        pets.groupBy(*KEYS).agg(F.count("*").alias("n_pets")).write.parquet(sizes)
        own = self.spark.read.parquet(sizes)
        pieces = own.select(*KEYS, F.ceil(F.col("n_pets") / self.rows_per_file).cast("int").alias("_pieces"))
        dealt = pets.join(F.broadcast(pieces), KEYS).withColumn("_piece", F.pmod(F.hash("anchor_pos", "target_pos"), F.col("_pieces")))
        dealt.repartition(*KEYS, "_piece").drop("_piece", "_pieces").write.partitionBy(*KEYS).parquet(f"{self.path}/pets/{folder}")
        return own.select(F.lit(folder).alias("folder"), *KEYS, "n_pets")

    def _publish(self, version: int, manifest: DataFrame, lengths: DataFrame) -> int:
        name = uuid.uuid4().hex
        manifest.select("folder", *KEYS, "n_pets").coalesce(1).write.parquet(f"{self.path}/manifests/{name}")  # a row per partition
        lengths.select("file", "chr", "length").coalesce(1).write.parquet(f"{self.path}/lengths/{name}")
        return self._commit(version, name)

    def write(self, pets: DataFrame, lengths: DataFrame, after: int | None = None) -> int:
        """Store pairs(file, anchor_chr, ...) and lengths(file, chr, length) as the whole of the version after
        ``after`` (the last one, if not given); returns the version, or fails if another writer has made it."""
        version = (self.last() if after is None else after) + 1
        return self._publish(version, self._store(pets), lengths)

    def add(self, pets: DataFrame, lengths: DataFrame, after: int | None = None) -> int:
        """Store more libraries beside those of the last version, which are not touched; libraries of a name are replaced."""
        old = self.last() if after is None else after
        if not old:
            return self.write(pets, lengths, 0)
        new = self._store(pets)
        names = lengths.select("file").distinct()
        return self._publish(old + 1, self.manifest(old).join(names, "file", "left_anti").unionByName(new), self.lengths(old).join(names, "file", "left_anti").unionByName(lengths))

    def merge(self, files: Sequence[str], name: str) -> int:
        """Add the union of some libraries as a library of its own."""
        old = self.last()
        merged = qc.merge_libraries(self.pets(old, files), files, name, self.lengths(old))
        return self.add(merged, self.lengths(old).where(F.col("file") == files[0]).withColumn("file", F.lit(name)), old)

    def strip_outward(self, min_gap: int = 10_000, files: Sequence[str] | None = None) -> tuple[int, int]:
        """Rewrite some libraries (all, if none are named) without outward pairs under the gap; returns the
        version and how many went. The count comes from the manifests, not from a pass of its own."""
        old = self.last()
        lengths = self.lengths(old)
        if files is not None:
            lengths = lengths.where(F.col("file").isin(*files))
        version = self.add(qc.strip_outward(self.pets(old, files), min_gap), lengths, old)
        total = lambda v: self.manifest(v).agg(F.coalesce(F.sum("n_pets"), F.lit(0))).first()[0]
        return version, int(total(old) - total(version))


def discard_outward(pets: DataFrame, path: str, min_gap: int = 10_000) -> tuple[DataFrame, dict[str, int]]:
    """Kept pairs, read from where one pass has written kept and discarded ones apart, and how many there are
    of each, counted in that pass. Discarded ones are tab-separated chr, start, end under ``discarded``."""
    counted = Observation()
    bad = (F.col("anchor_chr") == F.col("target_chr")) & (flag(F.col("anchor_pos"), F.col("target_pos")) == 2) & (gap(F.col("anchor_pos"), F.col("target_pos")) < min_gap)
    marked = pets.select(*KEYS, "anchor_pos", "target_pos", bad.alias("bad")).observe(counted, F.count_if("bad").alias("discarded"), F.count_if(~F.col("bad")).alias("kept"))
    marked.write.partitionBy("bad").parquet(f"{path}/apart")
    apart = pets.sparkSession.read.schema(f"{PETS}, bad boolean").parquet(f"{path}/apart")
    gone = apart.where("bad").select(F.col("anchor_chr").alias("chr"), (-F.col("target_pos")).alias("start"), F.col("anchor_pos").alias("end"))
    gone.write.csv(f"{path}/discarded", sep="\t")
    return apart.where("not bad").drop("bad"), {k: int(v) for k, v in counted.get.items()}
