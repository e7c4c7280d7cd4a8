"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains (0). Expectation-
maximisation over the vote patterns estimates, without labels, how often each rule votes bad on good
and on bad texts; a text is kept by its posterior probability of being good, not by passing every
rule. Patterns are counted in Spark: there are at most 3 ** rules of them however large the corpus,
so the estimation itself is a small table.

Defined cases: null and empty texts have zero counts and fail the base rule; very long texts are read
whole; repeated rows each get a row; an empty table gives an empty result; columns other than the
id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.llm import textstats
from tagplane.llm.common import checkpoint, table
from tagplane.llm.words import word_slices


@dataclass(frozen=True)
class Rule:
    """Votes on numerator / denominator: good within [good_from, good_to], bad outside [bad_below, bad_above]."""

    name: str
    over: str
    under: str
    good_from: float
    good_to: float
    bad_below: float
    bad_above: float

    def vote(self) -> Column:
        ratio = F.col(self.over) / F.greatest(F.col(self.under), F.lit(1))
        if self.under == "one":
            ratio = F.col(self.over).cast("double")
        bad = (ratio < self.bad_below) | (ratio > self.bad_above)
        return F.when(bad, -1).when(ratio.between(self.good_from, self.good_to), 1).otherwise(0)


INF = float("inf")
RULES = (
    Rule("length", "n_words", "one", 100, 100_000, 20, INF),
    Rule("word_length", "word_chars", "n_words", 3.0, 10.0, 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.05, -1.0, 0.3),
    Rule("marked_words", "n_marked", "n_words", 0.0, 0.02, -1.0, 0.2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.1, -1.0, 0.3),
    Rule("repetition", "n_repeat_words", "n_words", 0.0, 0.1, -1.0, 0.3),
    Rule("capitals", "n_upper", "n_letters", 0.0, 0.1, -1.0, 0.4),
    Rule("shouting", "n_shouts", "n_words", 0.0, 0.02, -1.0, 0.2),
)


def form_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the counts of `textstats.form` for each row."""
    names = textstats.NAMES
    keys = docs.select(F.col(key), F.col(text).cast("string"))
    schema = keys.select(key).schema
    for n in names:
        schema = schema.add(n, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(1), lower=False):
                found = textstats.form(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, words.n), *(pa.array(found[n]) for n in names)], [batch.schema.names[0], *names]
                )

    return keys.mapInArrow(count, schema)


def pattern(rules: tuple[Rule, ...]) -> Column:
    """The votes of all rules as digits of one number in base three."""
    total = F.lit(0)
    for k, r in enumerate(rules):
        total = total + (r.vote() + 1) * 3**k
    return total.cast("int")


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(n_rules)) % 3 - 1


@dataclass(frozen=True)
class Estimate:
    """What expectation-maximisation found: share of good texts; of the votes that a rule casts, how
    many are bad on bad texts (hits) and on good texts (alarms)."""

    good: float
    hits: np.ndarray
    alarms: np.ndarray
    rounds: int

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        bad, fine = votes == -1, votes == 1
        log_bad = np.log(1 - self.good) + bad @ np.log(self.hits) + fine @ np.log(1 - self.hits)
        log_good = np.log(self.good) + bad @ np.log(self.alarms) + fine @ np.log(1 - self.alarms)
        return 1 / (1 + np.exp(np.clip(log_bad - log_good, -60, 60)))


def fit(votes: np.ndarray, counts: np.ndarray, max_rounds: int = 200, tolerance: float = 1e-9) -> Estimate:
    """Two classes with rates of their own for each rule; abstaining tells nothing.

    It starts from `a text with a bad vote is bad`. Three bounds keep the classes to their meaning: rates
    stay off zero and one by two pseudo-votes, alarms are half of hits at most, so that no rule's bad
    vote speaks for a text, and the share of good texts lies between 0.02 and 0.998, with ten
    pseudo-texts of which nine are good, so that neither class dies out.
    """
    counts = counts.astype(float)
    bad, fine = (votes == -1).astype(float), (votes == 1).astype(float)
    good = np.where(bad.any(axis=1), 0.1, 0.95)
    found = Estimate(0.9, np.full(votes.shape[1], 0.3), np.full(votes.shape[1], 0.01), 0)
    last = -1.0
    for rounds in range(1, max_rounds + 1):
        g, b = counts * good, counts * (1 - good)
        hits = (b @ bad + 0.6) / (b @ (bad + fine) + 2)
        alarms = np.minimum((g @ bad + 0.02) / (g @ (bad + fine) + 2), hits / 2)
        share = float(np.clip((g.sum() + 9) / (counts.sum() + 10), 0.02, 0.998))
        found = Estimate(share, hits, alarms, rounds)
        good = found.posterior(votes)
        if abs(share - last) < tolerance:
            break
        last = share
    return found


def posteriors(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of counts with their vote pattern and posterior of being good."""
    spark = counted.sparkSession
    voted = counted.withColumn("pattern", pattern(rules))
    rows = voted.groupBy("pattern").count().collect()  # 3 ** rules at most
    patterns = np.array([r["pattern"] for r in rows], np.int64)
    votes = votes_of(patterns, len(rules))
    found = fit(votes, np.array([r["count"] for r in rows], np.int64))
    scored = spark.createDataFrame(
        [(int(p), float(x)) for p, x in zip(patterns, found.posterior(votes), strict=True)], "pattern int, posterior double"
    )
    return voted.join(F.broadcast(scored), "pattern")


def op2_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = checkpoint(form_counts(table(spark, sf_dir, "documents")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return posteriors(counted).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= 0.5)).alias("kept"),
        "posterior",
    )
