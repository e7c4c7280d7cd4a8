"""Trigram scoring of texts with sharded Elias-Fano tries.

The model is interpolated with Dirichlet priors. P1 is the add-one unigram of the base score,
P2(w | v) = (n(v w) + A2 P1(w)) / (n(v) + A2) and P3(w | u v) = (n(u v w) + A3 P2(w | v)) / (n(u v) + A3);
each sums to one over all words. A text is preceded by two starts and followed by an end. Since the
weight of the shorter context needs no more than the count of the longer one, contexts can be dealt
over shards in any way without a change of a score, and nothing of the model is ever in one place.

1. Texts become bundles of a few megabytes: their distinct words and the texts as numbers of those.
2. Word shards add up the training counts of all bundles and answer each bundle with id and count of
   its words. The base score follows from these.
3. Each bundle sends its distinct trigrams, with their training counts, to the shards of their first
   words; a first word with more than its share of tokens is dealt by its second one. A shard adds up
   and builds its part of the trie: first words, pairs and trigrams, with the quantised shares
   n(u v) / (n(u) + A2) and n(u v w) / (n(u v) + A3). It finds each n-gram that it was sent by successor
   search among the children of its context, and answers with the codes.
4. Each bundle puts the codes together and adds up its texts.

Rows between steps hold packed arrays, so a step costs a row per bundle and shard that it has words of,
not per token. Bundles are a table in buckets by bundle, so that they meet their answers without being
shuffled. Codes are in fixed steps of log10, so scores do not depend on how many shards there are.

Defined cases: a null or empty text is the end token alone; a null id trains and is scored; repeated
rows train as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.llm.common import table, written
from tagplane.llm.elias_fano import Trie, dequantise, quantise
from tagplane.llm.words import U64, mix, word_slices

#: Weights of the shorter context, in counts.
A2, A3 = 50.0, 5.0
BUNDLE_WORDS = 600_000
#: Entries that a word shard or a trigram shard handles, about.
SHARD_ENTRIES = 1_300_000
#: Ids of the end and the start; words follow. What comes after an end is never scored.
AFTER, END, START, FIRST = 0, 1, 2, 3
_ZSTD = pa.Codec("zstd", 1)
_BUNDLES = "bundle long, doc_ids array<long>, held array<boolean>, lens array<int>, n_words long, n_tokens long, train_tokens long, words binary, counts binary, tokens binary"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, lowest first, compressed together: high planes are mostly zero."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8).T[:width].tobytes()
    return struct.pack("<BQ", width, len(values)) + _ZSTD.compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    planes = np.frombuffer(_ZSTD.decompress(data[9:], width * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view("<u8").ravel()


def _ints(data: bytes) -> np.ndarray:
    return unpack(data).astype(np.int64)


def _bundle(ids: list, held: list, lens: list, hashes: list) -> dict:
    ids, held, lens, hashes = (np.concatenate(x) for x in (ids, held, lens, hashes))
    distinct, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
    # Frequent words first: their numbers are small.
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    trained = np.repeat(~held, lens)
    counts = np.bincount(inverse[trained], minlength=len(distinct))[order]
    return {
        "bundle": uuid.uuid4().int >> 65, "doc_ids": ids, "held": held, "lens": lens.astype(np.int32), "n_words": len(distinct), "n_tokens": len(hashes) + len(lens),
        "train_tokens": int(trained.sum() + (~held).sum()), "words": pack(distinct[order]), "counts": pack(counts), "tokens": pack(place[inverse]),
    }


def bundles(docs: DataFrame, held_out: Column) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())), *[(c, pa.int64()) for c in ("n_words", "n_tokens", "train_tokens")], *[(c, pa.binary()) for c in ("words", "counts", "tokens")]])
        waiting: tuple[list, ...] = ([], [], [], [])
        size = 0

        def flush() -> pa.RecordBatch:
            made = _bundle(*waiting)
            made["doc_ids"] = [None if m else int(x) for x, m in zip(made["doc_ids"], np.concatenate(missing), strict=True)]
            return pa.RecordBatch.from_pylist([made], schema)

        missing: list = []
        for batch in batches:
            empty = np.array(batch.column(0).is_null())
            ids, held = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for words in word_slices(batch.column(2), lower=True):
                for part, new in zip(waiting, (ids[words.rows], held[words.rows], words.counts(), words.hashes), strict=True):
                    part.append(new)
                missing.append(empty[words.rows])
                size += len(words.hashes) + words.n
                if size >= BUNDLE_WORDS:
                    yield flush()
                    waiting, missing, size = ([], [], [], []), [], 0
        if size:
            yield flush()

    return rows.mapInArrow(make, _BUNDLES)


def bucketed(made: DataFrame) -> DataFrame:
    """The bundles as a table of the session's catalog, in as many buckets as shuffles have partitions."""
    spark = made.sparkSession
    name = f"bundles_{uuid.uuid4().hex}"
    made.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "bundle").saveAsTable(name)
    return spark.table(name)


def word_shard(words: np.ndarray, n_shards: int) -> np.ndarray:
    return ((words >> U64(20)) % U64(n_shards)).astype(np.int64)


def _word_requests(made: DataFrame, n_shards: int) -> DataFrame:
    """(shard, bundle, words, counts): the distinct words of a bundle, by shard."""
    rows = made.select("bundle", "words", "counts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counts = unpack(words), unpack(counts)
                shard = word_shard(words, n_shards)
                order = np.argsort(shard, kind="stable")
                present, starts = np.unique(shard[order], return_index=True)
                parts = np.split(order, starts[1:]) if len(present) else []
                columns = [pa.array(present, pa.int32()), pa.array([bundle] * len(parts), pa.int64()), *(pa.array([pack(x[own]) for own in parts], pa.binary()) for x in (words, counts))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "bundle", "words", "counts"])

    return rows.mapInArrow(ask, "shard int, bundle long, words binary, counts binary")


def _word_answers(requests: DataFrame, n_shards: int) -> DataFrame:
    """(bundle, shard, ids, counts, known): training count and id of each word asked for, in its order.

    Ids of a shard are its number plus multiples of ``n_shards``, the smallest for the most frequent;
    ``known`` has, once in a shard, how many of its words are in training texts.
    """

    def answer(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        asked = [unpack(x) for x in group.column("words").to_pylist()]
        counts = np.concatenate([unpack(x) for x in group.column("counts").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(inverse, counts.astype(np.float64), len(distinct)).astype(np.int64)
        ids = np.empty(len(distinct), np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(distinct)) * n_shards + shard + FIRST
        out = np.split(inverse, np.cumsum([len(x) for x in asked])[:-1])
        known = [int((total > 0).sum())] + [0] * (len(asked) - 1)
        return pa.table({
            "bundle": group.column("bundle"), "shard": group.column("shard"), "ids": pa.array([pack(ids[x]) for x in out], pa.binary()),
            "counts": pa.array([pack(total[x]) for x in out], pa.binary()), "known": pa.array(known, pa.int64()),
        })

    return requests.groupBy("shard").applyInArrow(answer, "bundle long, shard int, ids binary, counts binary, known long")


@dataclass
class Sizes:
    """Whole numbers that every task knows."""

    word_shards: int
    shards: int
    train: int
    known: int
    train_docs: int

    @property
    def hot(self) -> float:
        """Tokens beyond which a first word is dealt by the second."""
        return self.train / (4 * self.shards)


@dataclass
class Grams:
    """The n-grams of a bundle in the order in which shards get them: by shard, first, second, third word.

    Words are places in ``ids`` and ``counts``, which are in order of id. The count of the start is the
    number of training texts, as a context.
    """

    ids: np.ndarray
    counts: np.ndarray
    lens: np.ndarray
    held: np.ndarray
    doc: np.ndarray  # text of each event
    event: np.ndarray  # trigram of each event
    shard: np.ndarray  # of each pair
    first: np.ndarray
    second: np.ndarray
    pair: np.ndarray  # of each trigram
    third: np.ndarray

    @staticmethod
    def of(row: dict, sizes: Sizes) -> Grams:
        shard, tokens = word_shard(unpack(row["words"]), sizes.word_shards), _ints(row["tokens"])
        lens, held = np.array(row["lens"], np.int64), np.array(row["held"], bool)
        m = len(shard)
        ids, counts = np.zeros(m + 3, np.int64), np.zeros(m + 3, np.int64)
        for a in row["answers"] or []:
            own = np.flatnonzero(shard == a["shard"])
            ids[own], counts[own] = unpack(a["ids"]), unpack(a["counts"])
        ids[m:], counts[m:] = (AFTER, END, START), (0, sizes.train_docs, sizes.train_docs)
        order = np.argsort(ids)
        place = np.empty(m + 3, np.int64)
        place[order] = np.arange(m + 3)
        # Two starts, the words, the end and what comes after; an event is a place with the two before it.
        stream = np.full(len(tokens) + 4 * len(lens), START)
        begins = np.concatenate([[0], np.cumsum(lens + 4)])[:-1]
        is_word = np.ones(len(stream), bool)
        for k in (0, 1):
            is_word[begins + k] = False
        stream[begins + lens + 2], stream[begins + lens + 3] = END, AFTER
        is_word[begins + lens + 2] = is_word[begins + lens + 3] = False
        stream[is_word] = place[tokens]
        at = np.ones(len(stream), bool)
        for k in (0, 1):
            at[begins + k] = False
        at = np.flatnonzero(at)
        doc = np.repeat(np.arange(len(lens)), lens + 2)
        n = m + 3
        pairs, pair = np.unique(stream[at - 2] * n + stream[at - 1], return_inverse=True)
        first, second = pairs // n, pairs % n
        counts, ids = counts[order], ids[order]
        dealt = np.where(counts[first] > sizes.hot, ids[second] + 1, 0).astype(U64)
        to = (mix(mix(ids[first].astype(U64) + U64(0x9E3779B97F4A7C15)) + dealt) % U64(sizes.shards)).astype(np.int64)
        by_shard = np.argsort(to, kind="stable")
        rank = np.empty(len(pairs), np.int64)
        rank[by_shard] = np.arange(len(pairs))
        triples, event = np.unique(rank[pair] * n + stream[at], return_inverse=True)
        return Grams(ids, counts, lens, held, doc, event, to[by_shard], first[by_shard], second[by_shard], triples // n, triples % n)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: a row is a whole bundle."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


_REQUESTS = "shard int, bundle long, firsts binary, totals binary, n_seconds binary, seconds binary, n_thirds binary, thirds binary, times binary"


def _with_answers(made: DataFrame, answers: DataFrame) -> DataFrame:
    by_bundle = answers.groupBy("bundle").agg(F.collect_list(F.struct("shard", "ids", "counts")).alias("answers"))
    return made.select("bundle", "doc_ids", "held", "lens", "words", "tokens").join(by_bundle, "bundle", "left")


def _requests(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """Distinct trigrams of each bundle and shard, as a tree: first words, their seconds, their thirds, training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            if len(row["lens"]):
                yield from tree(row["bundle"], Grams.of(row, sizes))

    def tree(bundle: int, g: Grams) -> Iterator[pa.RecordBatch]:
        times = np.bincount(g.event[~g.held[g.doc]], minlength=len(g.third))
        n_thirds = np.bincount(g.pair, minlength=len(g.first))
        opens = np.flatnonzero(np.concatenate([[True], (g.first[1:] != g.first[:-1]) | (g.shard[1:] != g.shard[:-1])]))
        n_seconds = np.diff(np.append(opens, len(g.first)))
        present, pair_at = np.unique(g.shard, return_index=True)
        pair_at = np.append(pair_at, len(g.shard))
        first_at, third_at = np.searchsorted(opens, pair_at), np.searchsorted(g.pair, pair_at)
        firsts, seconds, thirds = g.ids[g.first[opens]], g.ids[g.second], g.ids[g.third]
        totals = g.counts[g.first[opens]]
        columns: list[list] = [[] for _ in range(7)]
        for k in range(len(present)):
            f, p, t = (slice(at[k], at[k + 1]) for at in (first_at, pair_at, third_at))
            for out, x in zip(columns, (np.diff(firsts[f], prepend=0), totals[f], n_seconds[f], seconds[p], n_thirds[p], thirds[t], times[t]), strict=True):
                out.append(pack(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array(present, pa.int32()), pa.array([bundle] * len(present), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)],
            ["shard", "bundle", "firsts", "totals", "n_seconds", "seconds", "n_thirds", "thirds", "times"],
        )

    return rows.mapInArrow(ask, _REQUESTS)


def distinct_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low) in ascending order, and which of them each pair is."""
    values = None
    if len(low) and int(high.max()).bit_length() + int(low.max()).bit_length() > 63:
        values, low = np.unique(low, return_inverse=True)
    bits = U64(int(low.max()).bit_length() if len(low) else 1)
    key, inverse = np.unique((high.astype(U64) << bits) | low.astype(U64), return_inverse=True)
    found = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
    return (key >> bits).astype(np.int64), found if values is None else values[found], inverse


def train_trie(first: np.ndarray, totals: np.ndarray, pair_first: np.ndarray, second: np.ndarray, pair: np.ndarray, third: np.ndarray, times: np.ndarray) -> bytes:
    """Trie of one shard: distinct first words with their counts as contexts, distinct pairs (place of the
    first word, second), distinct trigrams (place of the pair, third) with training counts; all ascending."""
    seen = np.flatnonzero(times > 0)
    n_pair = np.bincount(pair[seen], times[seen], len(second))
    share3 = times[seen] / (n_pair[pair[seen]] + A3)
    kept = np.flatnonzero(n_pair > 0)
    place = np.cumsum(n_pair > 0) - 1
    share2 = n_pair[kept] / (totals[pair_first[kept]] + A2)
    one = (np.zeros(len(first), np.int64), first, 1, np.zeros(len(first), np.uint16))
    return Trie.build([one, (pair_first[kept], second[kept], len(first), quantise(share2)), (place[pair[seen]], third[seen], len(kept), quantise(share3))])


def _answers(requests: DataFrame) -> DataFrame:
    """(bundle, shard, pairs, trigrams): codes of the n-grams that a bundle sent to a shard, in its order."""

    def answer(group: pa.Table) -> pa.Table:
        column = lambda c: [_ints(x) for x in group.column(c).to_pylist()]
        firsts, seconds, thirds = [np.cumsum(x) for x in column("firsts")], column("seconds"), column("thirds")
        first, at_first = np.unique(np.concatenate(firsts), return_inverse=True)
        totals = np.zeros(len(first), np.int64)
        totals[at_first] = np.concatenate(column("totals"))
        of_pair = np.repeat(at_first, np.concatenate(column("n_seconds")))
        pair_first, second, at_pair = distinct_pairs(of_pair, np.concatenate(seconds))
        of_third = np.repeat(at_pair, np.concatenate(column("n_thirds")))
        pair, third, at_third = distinct_pairs(of_third, np.concatenate(thirds))
        times = np.bincount(at_third, np.concatenate(column("times")), len(third)).astype(np.int64)
        trie = Trie.mapped(train_trie(first, totals, pair_first, second, pair, third, times))
        one, two, three = trie.levels
        node = one.find(np.zeros(len(first), np.int64), first)
        node = two.find(node[pair_first], second)
        codes2 = np.where(node >= 0, two.codes[node] if len(two.codes) else 0, 0)
        node = three.find(node[pair], third)
        codes3 = np.where(node >= 0, three.codes[node] if len(three.codes) else 0, 0)
        cut = lambda codes, at, parts: pa.array([pack(x) for x in np.split(codes[at], np.cumsum([len(p) for p in parts])[:-1])], pa.binary())
        return pa.table({"bundle": group.column("bundle"), "shard": group.column("shard"), "pairs": cut(codes2, at_pair, seconds), "trigrams": cut(codes3, at_third, thirds)})

    return requests.groupBy("shard").applyInArrow(answer, "bundle long, shard int, pairs binary, trigrams binary")


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(rows: DataFrame, found: DataFrame, sizes: Sizes) -> DataFrame:
    codes = found.groupBy("bundle").agg(F.collect_list(F.struct("shard", "pairs", "trigrams")).alias("codes"))
    floor = np.log10(sizes.train + sizes.known + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            if not len(row["lens"]):
                continue
            g = Grams.of(row, sizes)
            parts = sorted(row["codes"], key=lambda x: x["shard"])
            pairs, trigrams = (dequantise(np.concatenate([unpack(x[c]) for x in parts])) for c in ("pairs", "trigrams"))
            one = (g.counts + 1.0) * 10.0**-floor
            counts = g.counts.astype(np.float64)
            # A share of a count up to some thousands gives the count itself back.
            n_pair = np.round(pairs * (counts[g.first] + A2))
            pairs = n_pair / (counts[g.first] + A2)
            trigrams = np.round(trigrams * (n_pair[g.pair] + A3)) / (n_pair[g.pair] + A3)
            # The pair of a trigram's second and third word is a pair of the bundle too, unless nothing is scored there.
            scored = g.ids[g.third] != AFTER
            n = len(g.ids)
            by_words = np.argsort(g.first * n + g.second)
            keys = (g.first * n + g.second)[by_words]
            second = g.second[g.pair]
            low = by_words[np.minimum(np.searchsorted(keys, second * n + g.third), len(keys) - 1)]
            p2 = pairs[low] + A2 / (counts[second] + A2) * one[g.third]
            p3 = trigrams + A3 / (n_pair[g.pair] + A3) * p2
            logs = np.where(scored, np.log10(p3), 0.0)
            n_texts = len(g.lens)
            event_third = g.third[g.event]
            real = scored[g.event]
            base = np.bincount(g.doc[real], np.log10(one)[event_third[real]], n_texts)
            known = np.bincount(g.doc[real], g.counts[event_third[real]] > 0, n_texts).astype(np.int64)
            score = np.bincount(g.doc, logs[g.event], n_texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(g.lens + 1), pa.array(known),
                    pa.array(np.full(n_texts, sizes.train, np.int64)), pa.array(base), pa.array(score),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return rows.join(codes, "bundle").mapInArrow(add, _SCORES)


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text)."""
    made = bucketed(bundles(docs, held_out))
    total = made.agg(
        F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens"), F.sum("train_tokens").alias("train"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("docs")
    ).first()
    shards = lambda n: int(-(-(n or 1) // SHARD_ENTRIES))
    word_shards, n_docs = shards(total["words"]), int(total["docs"] or 0)
    answers = written(_word_answers(_word_requests(made, word_shards), word_shards), "word-answers")
    # The end is a training token too.
    n_known = int(answers.agg(F.sum("known")).first()[0] or 0) + (n_docs > 0)
    sizes = Sizes(word_shards, shards(total["tokens"]), int(total["train"] or 0), n_known, n_docs)
    rows = _with_answers(made, answers)
    return _scores(rows, _answers(_requests(rows, sizes)), sizes)


def op1_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return score_texts(table(spark, sf_dir, "documents"), held_out)
