"""Quality classifier: a factorisation machine over hashed words, form statistics and metadata.

The score of a text is sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is
taken in linear time as half of (square of sums minus sum of squares) for each factor. Features:

* the words of the text, hashed to ``WORD_BUCKETS`` buckets (value: the share of the text's words that
  the bucket holds; a word that is repeated is one feature, in the fit as in the score);
* form statistics (see `textstats`), each in a bucket of its own range (value one);
* metadata: the bucket of the stated n_chars, where the table has it.

The model is fitted on a bounded sample of labelled rows and is small (a few hundred kB); scoring
reads every text whole, one slice of a batch at a time.

Defined cases: null and empty texts score by their form alone; a null or absent n_chars has a bucket
of its own; repeated rows score alike; an empty table gives an empty result; without labels of both
kinds the model gives every text the share of good labels, so nothing is learned; of several rows with
one labelled id the fit takes the one whose features are least in byte order; input columns
that clash with the added ones are kept apart by the prefix `_fm_`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tagplane.llm import textstats
from tagplane.llm.common import table
from tagplane.llm.words import U64, Words, word_slices

WORD_BUCKETS = 1 << 12
FACTORS = 8
#: Labelled rows that the model is fitted on, at most: those with the lowest hash of the id.
SAMPLE_ROWS = 4000
#: Words of a sampled text that are kept for the fit are its bucket counts, so a long text costs
#: WORD_BUCKETS numbers at most.
EPOCHS = 12
N_BINS = 14
#: name, numerator, denominator, scale of the square-root bins.
RATIOS = (
    ("symbols", "n_symbols", "n_words", 2.0),
    ("marked", "n_marked", "n_words", 1.0),
    ("dup_lines", "n_dup_lines", "n_lines", 1.0),
    ("repeats", "n_repeat_words", "n_words", 1.0),
    ("upper", "n_upper", "n_letters", 1.0),
    ("digits", "n_digits", "n_letters", 0.5),
    ("capitalised", "n_capitalised", "n_words", 1.0),
    ("stops", "n_stops", "n_words", 0.5),
    ("shouts", "n_shouts", "n_words", 1.0),
    ("word_length", "word_chars", "n_words", 16.0),
    ("lines", "n_lines", "n_words", 0.5),
)
N_FORM = (len(RATIOS) + 2) * (N_BINS + 1)
SIZE = WORD_BUCKETS + N_FORM


def form_features(words: Words, n_chars: np.ndarray) -> np.ndarray:
    """Index of the feature that is one, for each text and statistic."""
    stats = textstats.form(words)
    bins = []
    for _, over, under, top in RATIOS:
        ratio = stats[over] / np.maximum(stats[under], 1)
        bins.append(np.minimum(np.sqrt(ratio / top) * (N_BINS - 1), N_BINS - 1).astype(np.int64) + (stats[over] > 0))
    bins.append(np.minimum(np.log2(stats["n_words"] + 1), N_BINS).astype(np.int64))
    bins.append(np.where(n_chars < 0, 0, np.minimum(1 + np.log2(np.maximum(n_chars, 0) + 1) / 2, N_BINS).astype(np.int64)))
    return WORD_BUCKETS + np.stack(bins, axis=1) + np.arange(len(bins)) * (N_BINS + 1)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each text's words, the share of its words in each, and where each text's buckets start."""
    key = words.doc * WORD_BUCKETS + (words.hashes % U64(WORD_BUCKETS)).astype(np.int64)
    seen, times = np.unique(key, return_counts=True)
    doc = seen // WORD_BUCKETS
    return seen % WORD_BUCKETS, times / words.counts()[doc], np.searchsorted(doc, np.arange(words.n + 1))


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x FACTORS

    def margins(self, words: Words, n_chars: np.ndarray) -> np.ndarray:
        """Half of (square of sums minus sum of squares) for each factor, over the features of `features`."""
        form = form_features(words, n_chars)
        bucket, value, starts = word_features(words)
        each = np.concatenate([self.linear[:, None], self.factors, (self.factors**2).sum(axis=1)[:, None]], axis=1).astype(np.float32)
        rows = each[bucket] * value[:, None].astype(np.float32)
        rows[:, -1] *= value
        sums = np.zeros((words.n, each.shape[1]))
        filled = np.flatnonzero(np.diff(starts))
        if len(filled):
            sums[filled] = np.add.reduceat(rows, starts[filled], axis=0, dtype=np.float64)
        sums += each[form].sum(axis=1)
        return self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(axis=1) - sums[:, -1])


def fit(ids: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam on the logistic loss; both labels weigh by their share."""
    draw = np.random.Generator(np.random.PCG64(seed))
    w0, w, v = 0.0, np.zeros(SIZE), draw.normal(0, 0.05, (SIZE, FACTORS))
    n, n_good = len(labels), float(labels.sum())
    prior = (n_good + 1) / (n + 2)
    w0 = float(np.log(prior / (1 - prior)))
    if n_good in (0, n):
        return Model(w0, w, np.zeros_like(v))
    params = [np.array([w0]), w, v]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = draw.permutation(n)
        for lo in range(0, n, 64):
            rows = order[lo : lo + 64]
            idx = np.concatenate([ids[r] for r in rows])
            x = np.concatenate([values[r] for r in rows])
            at = np.concatenate([[0], np.cumsum([len(ids[r]) for r in rows])])[:-1]
            size = np.diff(np.append(at, len(idx)))
            xv = v[idx] * x[:, None]
            sums = np.add.reduceat(xv, at, axis=0)
            margin = params[0][0] + np.add.reduceat(w[idx] * x, at) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((xv**2).sum(axis=1), at))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(slope, size) * x
            grads = [np.array([slope.sum()]), np.bincount(idx, each, SIZE), np.zeros_like(v)]
            pull = each[:, None] * (np.repeat(sums, size, axis=0) - xv)
            for f in range(FACTORS):
                grads[2][:, f] = np.bincount(idx, pull[:, f], SIZE)
            step += 1
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                g = g + decay * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return Model(float(params[0][0]), w, v)


def _n_chars(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def training_rows(docs: DataFrame, labels: DataFrame, unseen: Column, limit: int) -> DataFrame:
    """doc_id, label, feature ids and values of the sampled documents, one row each."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~unseen)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("_fm_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _n_chars(docs).alias("n_chars"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "_fm_label", "text", "n_chars")  # limit rows at most

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = batch.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
            for words in word_slices(batch.column(2), lower=True):
                form, (bucket, value, starts) = form_features(words, chars[words.rows]), word_features(words)
                own = [slice(starts[d], starts[d + 1]) for d in range(words.n)]
                ids = [np.concatenate([bucket[x], form[d]]).astype(np.int32).tobytes() for d, x in enumerate(own)]
                values = [np.concatenate([value[x], np.ones(form.shape[1])]).astype(np.float32).tobytes() for x in own]
                part = batch.slice(words.first, words.n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "label", "ids", "vals"])

    made = rows.mapInArrow(sparse, "doc_id long, label int, ids binary, vals binary")
    return made.groupBy("doc_id").agg(F.min(F.struct("ids", "vals", "label")).alias("one")).select("doc_id", "one.label", "one.ids", "one.vals")


def train(docs: DataFrame, labels: DataFrame, unseen: Column | None = None, limit: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``limit`` labelled documents, those whose ids have the lowest hashes."""
    rows = training_rows(docs, labels, F.lit(False) if unseen is None else unseen, limit).collect()  # limit rows at most
    rows.sort(key=lambda r: (bytes(r["ids"]), bytes(r["vals"]), r["label"], r["doc_id"]))
    ids = [np.frombuffer(r["ids"], np.int32).astype(np.int64) for r in rows]
    values = [np.frombuffer(r["vals"], np.float32).astype(np.float64) for r in rows]
    return fit(ids, values, np.array([r["label"] for r in rows], np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with `_fm_score`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # SIZE x (FACTORS + 1) numbers
    rows = docs.select(F.col("text").cast("string").alias("_fm_text"), _n_chars(docs).alias("_fm_chars"), *[F.col(f"`{c}`") for c in docs.columns])
    schema = StructType([*docs.schema.fields, StructField("_fm_score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            chars = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            for words in word_slices(batch.column(0), lower=True):
                margin = model.margins(words, chars[words.rows])
                good = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                part = batch.slice(words.first, words.n)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(good)], [*part.schema.names[2:], "_fm_score"])

    return rows.mapInArrow(score, schema)


def held_out() -> Column:
    """Rows that the contract keeps from the fit."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op7_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels"), held_out())
    return scored(docs.select("doc_id", "text", "n_chars"), model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("_fm_score").alias("score"),
        (F.col("_fm_score") >= 0.5).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier accepts."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where("_fm_score >= 0.5").select(*docs.columns)
