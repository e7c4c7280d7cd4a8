"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over (source, lang, topic) cells. The tokens wanted of the cells are raked to the
three target marginals in turn until the marginals hold; a document is then sampled with the
probability of its cell. All of it is DataFrame functions over a table of cells; documents meet it in
one join.

Nothing is repeated to fill a target. A category that has fewer tokens than its target gives all it has,
and the categories of its margin that have more take over the rest by their targets. A cell that raking
would take more from than it has gives all, and the other cells are raked to what then remains of the
targets, until no cell is over. What is left of a miss is reported (`Missed` warning).

Defined cases: null source, language or topic is the category `(none)`; null or wordless texts have
no tokens and take the probability of their cell like any other; a target for a category without
tokens is left out and the others are scaled to sum to one; repeated rows with one id are drawn
alike, rows without an id by their text; an empty table gives an empty result. Columns whose names clash with those made here are
kept apart by a prefix.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.llm.common import SPACE, checkpoint, small, table, tasks

NONE = "(none)"
MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """What the mixture should look like.

    A margin with explicit shares takes them (categories that are not named share ``rest`` by their
    own tokens); a margin without takes its own shares to the power ``flatten``.
    """

    lang: dict[str, float] = field(default_factory=dict)
    topic: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)
    rest: float = 0.02
    flatten: float = 0.7
    #: Share of all tokens that the mixture should have.
    budget: float = 0.6
    #: Largest miss of a category, as a share of its target, at which raking ends.
    tolerance: float = 2e-3
    max_rounds: int = 100


PRODUCTION = Targets(
    lang={"en": 0.5, "de": 0.18, "fr": 0.17, "es": 0.15},
    topic={"prose": 0.84, "short": 0.02, "table": 0.05, "marked": 0.05, "figures": 0.04},
)


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the text."""
    body = F.coalesce(text, F.lit(""))
    n = F.length(body)
    bars = n - F.length(F.replace(body, F.lit("|"), F.lit("")))
    marks = F.regexp_count(body, F.lit("[#*$%&<>]"))
    digits = F.regexp_count(body, F.lit("[0-9]"))
    return (
        F.when(n < 200, "short")
        .when(bars * 100 > n, "table")
        .when(marks * 100 > n * 2, "marked")
        .when(digits * 100 > n, "figures")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def with_cell(docs: DataFrame, seed: str) -> DataFrame:
    """The rows and, under names that begin with `_mix_`, their cell, tokens and draw."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return docs.withColumns(
        {
            "_mix_source": name("source"),
            "_mix_lang": name("lang"),
            "_mix_topic": topic_of(F.col("text")),
            "_mix_tokens": n_tokens(F.col("text")),
            "_mix_draw": F.coalesce(F.when(F.col("doc_id").isNotNull(), draw(F.col("doc_id"), seed)), draw(F.col("text"), seed)),
        }
    )


class Missed(UserWarning):
    """Targets that raking did not reach."""


def _goal(cells: DataFrame, margin: str, targets: Targets, wanted: float) -> DataFrame:
    """Tokens wanted of each category of a margin: its share of ``wanted``, or all it has if that is less."""
    shares = getattr(targets, margin)
    have = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("have")).where("have > 0")
    if shares:
        named = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col(margin)]
        # Categories without a name share ``rest`` by their own tokens.
        others = have.where(named.isNull()).agg(F.sum("have")).first()[0] or 1.0
        raw = F.coalesce(named, F.col("have") / F.lit(others) * F.lit(targets.rest))
    else:
        raw = F.pow("have", F.lit(targets.flatten))
    goal = small(have.select(margin, "have", raw.alias("raw")))
    scale = 0.0
    while True:
        # The factor of the categories that are not used up; it only grows.
        free = F.col("raw") * F.lit(scale) < F.col("have")
        left = goal.agg(F.sum(F.when(free, F.col("raw"))).alias("raw"), F.sum(F.when(~free, F.col("have"))).alias("used")).first()
        grown = (wanted - (left["used"] or 0.0)) / left["raw"] if left["raw"] else scale
        if grown <= scale * (1 + 1e-12):
            return goal.select(margin, F.least("have", F.col("raw") * F.lit(scale)).alias("goal"))
        scale = grown


def rake(cells: DataFrame, targets: Targets) -> tuple[DataFrame, float, int]:
    """Cells with the tokens wanted of them, the largest miss of a category as a share of its goal, and
    the rounds taken.

    The table has a row for each cell with tokens, with the goals of its categories. Each step scales the
    free cells of a category by what remains of its goal over their sum, with a partial sum before each
    shuffle; each round ends in a checkpoint, and cells that are over their tokens are then used up.
    """
    n = tasks(cells.count())
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.where("tokens > 0").withColumns({"wanted": F.col("tokens") * F.lit(targets.budget), "full": F.lit(False)})
    for m in MARGINS:
        goal = _goal(cells, m, targets, total * targets.budget).withColumnRenamed("goal", f"goal_{m}")
        now = now.join(goal, m)
    now = checkpoint(now.coalesce(n))
    miss, rounds = 0.0, 0
    for rounds in range(1, targets.max_rounds + 1):
        for m in MARGINS:
            free, used = (F.coalesce(F.sum(F.when(F.col("full") == x, F.col("wanted"))), F.lit(0.0)) for x in (False, True))
            left = F.greatest(F.any_value(f"goal_{m}") - used, F.lit(0.0))
            scale = now.groupBy(m).agg(F.when(free > 0, left / free).otherwise(1.0).alias("scale"))
            now = now.join(scale, m).withColumn("wanted", F.when(F.col("full"), F.col("wanted")).otherwise(F.col("wanted") * F.col("scale"))).drop("scale")
        over = F.col("wanted") >= F.col("tokens")
        now = now.withColumns({"full": F.col("full") | over, "wanted": F.when(over, F.col("tokens").cast("double")).otherwise(F.col("wanted"))})
        now = checkpoint(now.coalesce(n))
        misses = [now.groupBy(m).agg((F.abs(F.sum("wanted") - F.any_value(f"goal_{m}")) / F.any_value(f"goal_{m}")).alias("miss")).select("miss") for m in MARGINS]
        miss = misses[0].union(misses[1]).union(misses[2]).agg(F.max("miss")).first()[0] or 0.0
        if miss <= targets.tolerance:
            break
    return now.select(*MARGINS, "tokens", "wanted", *[f"goal_{m}" for m in MARGINS]), miss, rounds


def cell_rates(counted: DataFrame, targets: Targets = PRODUCTION) -> DataFrame:
    """source, lang, topic, tokens, rate: rate is the calibrated probability, 1 at most."""
    cells = small(counted)
    raked, miss, rounds = rake(cells, targets)
    if miss > targets.tolerance:
        warnings.warn(f"after {rounds} rounds a category misses its target by {miss:.2%}", Missed, stacklevel=2)
    rates = raked.withColumn("rate", F.least(F.lit(1.0), F.col("wanted") / F.col("tokens")))
    bare = cells.where("tokens = 0").select(*MARGINS, "tokens", F.lit(float(targets.budget)).alias("rate"))
    return small(rates.select(*MARGINS, "tokens", "rate").unionByName(bare))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that the key and seed fix."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


#: Cells up to which the table of rates is sent to every task; it is counted first, and joined by a
#: shuffle beyond.
BROADCAST_CELLS = 20_000


def with_rate(rows: DataFrame, targets: Targets) -> DataFrame:
    """Rows that have cell columns with `_mix_rate` and `_mix_kept`."""
    cells = rows.groupBy(*[F.col(f"_mix_{m}").alias(m) for m in MARGINS]).agg(F.sum("_mix_tokens").alias("tokens"))
    rates = cell_rates(cells, targets).select(*[F.col(m).alias(f"_mix_{m}") for m in MARGINS], F.col("rate").alias("_mix_rate"))
    if rates.count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    return rows.join(rates, [f"_mix_{m}" for m in MARGINS]).withColumn("_mix_kept", F.col("_mix_draw") < F.col("_mix_rate"))


def sampled(docs: DataFrame, targets: Targets = PRODUCTION, seed: str = "mix-1") -> DataFrame:
    """Every row of docs with `_mix_rate` and `_mix_kept` beside the cell columns."""
    return with_rate(with_cell(docs, seed), targets)


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, calibrated probability and draw of every document; texts are read once."""
    narrow = checkpoint(with_cell(table(spark, sf_dir, "documents"), "mix-1").drop("text", "source", "lang", "n_chars"))
    return with_rate(narrow, PRODUCTION).select(
        "doc_id", *[F.col(f"_mix_{m}").alias(m) for m in MARGINS], F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_rate").alias("rate"), F.col("_mix_kept").alias("kept")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are drawn."""
    return sampled(docs).where("_mix_kept").select(*docs.columns)
