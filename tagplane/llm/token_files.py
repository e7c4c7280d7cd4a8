"""Token ids of whole documents as Parquet files that can be read selectively.

A token table has a row per document in ascending order of id, over the names of its files and within
each: part (the file), offset (ids of the earlier documents of the part), doc_id, n_tokens and the ids
as a list column. Ids are dictionary-encoded (a vocabulary fits one dictionary page, so an id takes
little more than its entropy), the other columns, which ascend or vary little, are delta-encoded; row groups and
pages are of set sizes, and every page has its least and greatest value in the page index. So lengths are
read without touching ids, and a document or a stretch of the token stream reads the pages that hold it.
A second, small table has a row per part: the ids of all parts before it, its own, and its documents.

Text is cut before each space that a visible character follows, and between a letter or digit and a mark of
ASCII. The tokenizer's pattern always starts a new piece there, so the cuts change no id, and a cutting that
a worker has met lately is not encoded again.

Defined cases: a null or empty text is the end id alone; rows of one id are ordered by their texts, equal
rows are all kept; rows without an id come first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagplane.llm.common import shared_dir, table
from tagplane.llm.words import text_buffers

#: Appended to each document.
END = 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of a row group and of a page before compression, and rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 64 << 10, 1000
#: Bytes of text that are cut and encoded at once, or one longer text; encoded cuttings after which a worker's memory is renewed.
SLICE_BYTES, REMEMBERED = 3 << 20, 300_000
_SCHEMA = "part int, doc_id long, offset long, n_tokens long, ids array<int>"
#: Bytes that, after a space, may begin white space: with these there is no cut.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Letters and digits of ASCII, and its marks: between the two is always a cut.
_IN_WORD, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_encoders: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer with a bounded memory of what it encoded; one per worker and file.

    The memory has two generations: a full new one replaces the old one, and what is met again moves up.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The names of special tokens are ordinary text where a text has them.
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes that each id stands for: a byte-level vocabulary writes one character for each.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def at(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _encode(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Pieces with the bytes of their ids. Those that begin with a space are encoded as one text, as
        a cut before them changes nothing, and told apart by the bytes that their tokens stand for."""
        spaced = [x for x in pieces if x[0] == 32]
        if spaced:
            joined = self.tokenizer.encode_batch_fast([b"".join(spaced).decode()], add_special_tokens=False)[0]
            ids = np.array(joined.ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(x) for x in spaced])) + 1
            raw = ids.tobytes()
            yield from zip(spaced, (raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True)
        rest = [x for x in pieces if x[0] != 32]
        found = self.tokenizer.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)
        yield from ((x, np.array(e.ids, np.int32).tobytes()) for x, e in zip(rest, found, strict=True))

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct pieces, as bytes."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        self.new.update((x, self.old[x]) for x in pieces if x not in self.new and x in self.old)
        self.new.update(self._encode([x for x in pieces if x not in self.new]))
        return [self.new[x] for x in pieces]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with its end, one after the other, and how many each has."""
        n = len(offsets) - 1
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[: len(data) - 1] = (data[:-1] == 32) & ~_MAY_BE_SPACE[data[1:]]
            cut[offsets[1:] - 1] = False  # a space that ends a text stands before another text
            cut[1:-1] |= _IN_WORD[data[:-1]] & _MARK[data[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = whole.dictionary_encode()
        which = coded.indices.to_numpy()
        ids = self.pieces(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        begins = np.cumsum(sizes) - sizes
        each = sizes[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        tokens = flat[np.repeat(begins[which] - upto[:-1], each) + np.arange(upto[-1])]
        ends = upto[np.searchsorted(starts, offsets)]  # tokens before each text
        counts = np.diff(ends) + 1
        out = np.full(len(tokens) + n, END, np.int32)
        real = np.ones(len(out), bool)
        real[np.cumsum(counts) - 1] = False
        out[real] = tokens
        return out, counts


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1, i + 1))
        yield i, j
        i = j


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """part, doc_id, offset, n_tokens, ids of docs(doc_id, text), in order of id over and within the parts.

    The order is by ranges of id and text, so that a repeated id is not one task's.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset, encoder = TaskContext.get().partitionId(), 0, Encoder.at(tokenizer)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in _slices(offsets):
                ids, counts = encoder.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                upto = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids))
                columns = [pa.array(np.full(j - i, part, np.int32)), batch.column(0).slice(i, j - i), pa.array(offset + upto[:-1]), pa.array(counts), lists]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "offset", "n_tokens", "ids"])
                offset += int(upto[-1])

    return rows.mapInArrow(encode, _SCHEMA)


@dataclass(frozen=True)
class TokenFiles:
    """Token table in a folder that driver and executors share."""

    spark: SparkSession
    path: str

    @staticmethod
    def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> TokenFiles:
        """Encode docs(doc_id, text) into a new folder."""
        spark = docs.sparkSession
        (
            encoded(docs, tokenizer)
            .write.option("compression", "zstd")
            .option("parquet.writer.version", "v2")
            .option("parquet.block.size", row_group)
            .option("parquet.page.size", page)
            .option("parquet.page.row.count.limit", page_rows)
            .option("parquet.enable.dictionary", "false")
            .option("parquet.enable.dictionary#ids.list.element", "true")
            .parquet(f"{path}/tokens")
        )
        out = TokenFiles(spark, path)
        own = out._table().groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        # A row per file: the one running sum is over files, not documents.
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        own.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")
        return out

    def _table(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/tokens")

    def parts(self) -> DataFrame:
        """part, n_tokens, n_docs, first_id, last_id, before: a row per file."""
        return self.spark.read.schema("part int, n_tokens long, n_docs long, first_id long, last_id long, before long").parquet(f"{self.path}/parts")

    def _started(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.parts().select("part", "before"), "part").withColumn("start", F.col("before") + F.col("offset")).drop("before", "offset", "part")

    def lengths(self) -> DataFrame:
        """doc_id, n_tokens, start of each document; ids are not read."""
        return self._started(self._table().select("part", "doc_id", "offset", "n_tokens"))

    def documents(self, first: int, last: int) -> DataFrame:
        """doc_id, n_tokens, ids, start of the documents with ids in a range; pages of others are skipped."""
        return self._started(self._table().where(F.col("doc_id").between(first, last)))

    def stretch(self, start: int, stop: int) -> DataFrame:
        """doc_id, at, ids: the ids that stand at places start to stop - 1 of the whole stream; ``at`` is the place of the first.

        The stretch lies in parts that follow each other: other parts are skipped by their page index, and
        within the first and the last one the pages before and behind it.
        """
        held = self.parts().where((F.col("before") < stop) & (F.col("before") + F.col("n_tokens") > start))
        ends = held.agg(F.min(F.struct("part", "before")).alias("first"), F.max(F.struct("part", "before")).alias("last")).first()
        first, last = ends["first"], ends["last"]
        rows = self._table()
        if first is None:
            rows = rows.where("false")
        else:
            rows = rows.where(F.col("part").between(first["part"], last["part"]))
            rows = rows.where((F.col("part") < last["part"]) | (F.col("offset") < stop - last["before"]))
        rows = rows.join(self.parts().select("part", "before"), "part").withColumn("at", F.col("before") + F.col("offset"))
        rows = rows.where((F.col("at") < stop) & (F.col("at") + F.col("n_tokens") > start))
        skipped = F.greatest(F.lit(start) - F.col("at"), F.lit(0))
        taken = F.least(F.lit(stop) - F.col("at"), F.col("n_tokens")) - skipped
        return rows.select("doc_id", (F.col("at") + skipped).alias("at"), F.slice("ids", skipped.cast("int") + 1, taken.cast("int")).alias("ids"))

    def checksums(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of each document: what the ids read back amount to as little-endian 32-bit numbers."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("ids")
                at = lists.offsets.to_numpy().astype(np.int64) * 4
                raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B") if at[-1] else memoryview(b"")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                found = pa.array((at[1:] - at[:-1]) // 4)
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("offset"), found, pa.array(crc, pa.int64())], ["part", "doc_id", "offset", "n_tokens", "ids_crc32"])

        read = self._table().mapInArrow(sums, "part int, doc_id long, offset long, n_tokens long, ids_crc32 long")
        return self._started(read).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenFiles.write(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tokens-{uuid4().hex}").checksums()
