"""URL filter: explicit rules first, link-graph propagation for the rest.

Hosts and links between them form a graph. Trust spreads by personalised PageRank from the hosts
that allow rules cover; distrust spreads the same way against the direction of links from hosts that
block rules cover. Rules of other urls are seeds and no more. Both ranks are compared with the host's plain
PageRank: a host is blocked where the part that comes from distrusted seeds outweighs that from trusted ones.
DataFrame functions only; the graph is a table of weighted edges, each round a join and a sum. The
links of a host that has very many are split, and the host's rank is sent to each piece.

Defined cases: a null url or one without `://` has an empty host and path, no rule, and is allowed;
null html has no links; repeated pages count once per host and target; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.llm.common import checkpoint, lower_ascii, small, table, tasks


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)
DAMPING = 0.85
#: A host is blocked where its share of distrust is above this many times its share of trust, and the margin.
RATIO, MARGIN = 1.0, 0.01
#: Uncertainty of a share under which ranks have settled, if verdicts have not before.
TOLERANCE = 1e-9
#: Rounds between two checkpoints; even, as trust goes to and fro between a domain and what is below it.
ROUNDS = 2
SALTS = 32
#: Links out of a host that one piece of it holds, about.
LINKS_PER_PIECE = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """Rule text or verdict of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(getattr(r, what))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight between hosts of pages(host, html).

    Absolute links weigh one for each page and target. Each host is also tied, both ways, to its
    parent domain, and that to its own, down to two labels, since owners of a domain answer for what is below it.
    """
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), 1)))
    links = pages.select(F.col("host").alias("src"), target.alias("dst")).withColumn("dst", lower_ascii(F.col("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    known = pages.select("host").union(links.select("dst")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    # A host with all its parent domains down to two labels.
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    hosts = known.select(F.explode(own).alias("host")).distinct()
    parent = F.concat_ws(".", F.slice(labels, 2, F.size(labels)))
    up = hosts.where(F.size(labels) > 2).select(F.col("host").alias("src"), parent.alias("dst"), F.lit(1.0).alias("weight"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return links.unionByName(up).unionByName(down).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def rank_shares(edges: DataFrame, seeds: DataFrame, hosts: DataFrame, ratio: float = RATIO, margin: float | None = MARGIN, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust: the shares of each host's PageRank that come from trusted seeds along edges(src,
    dst, weight), and from distrusted ones against them.

    A walk starts at every host; seeds(host, trust, distrust) tell which part of the walks of a host counts as
    trusted or distrusted. So a share is between none and all, whatever the number of seeds, and hosts are
    compared with what plain PageRank gives them. Mass that reaches a host without links leaves the graph.

    Each round passes on what arrived in the last one. What a host still gets is bounded: if no host got more
    than r times as much in these rounds as in the ones before, none will in any later ones, as all they get comes
    through the same links. The rounds end when no verdict of ``hosts`` can change within these bounds, or
    no share by more than the tolerance; without a margin only the latter counts.
    """
    ways = edges.withColumn("way", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("way")))
    out = checkpoint(ways.groupBy("way", "src").agg(F.sum("weight").alias("out"), F.ceil(F.count("*") / LINKS_PER_PIECE).cast("int").alias("pieces")))
    dealt = F.pmod(F.xxhash64("dst"), F.col("pieces")).cast("int")
    moves = small(ways.join(out, ["way", "src"]).select("way", F.col("src").alias("host"), dealt.alias("piece"), "dst", (F.col("weight") / F.col("out") * damping).alias("part")))
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).union(hosts.select("host")).distinct()
    each = nodes.join(seeds, "host", "left").withColumn("way", F.explode(F.array(F.lit("trust"), F.lit("distrust"))))
    mass = F.coalesce(F.when(F.col("way") == "trust", F.col("trust")).otherwise(F.col("distrust")), F.lit(0.0))
    begun = each.select("way", "host", mass.alias("seed"), F.lit(1.0).alias("base"))
    begun = begun.join(out.select("way", F.col("src").alias("host"), "pieces"), ["way", "host"], "left").fillna(1, ["pieces"])
    # seed and base arrive in a round; the sums are all that arrived, gained and before that of these rounds and the last ones.
    sums = ["seed_sum", "base_sum", "gained", "before"]
    rank = small(begun.select("way", "host", "seed", "base", F.col("seed").alias("seed_sum"), F.col("base").alias("base_sum"), F.lit(0.0).alias("gained"), F.lit(0.0).alias("before"), "pieces"))
    n = tasks(edges.count())
    first = True
    while True:
        for _ in range(ROUNDS):
            spread = rank.select("way", "host", "seed", "base", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
            nothing = [F.lit(0.0).alias(c) for c in sums]
            # A small graph stays in few tasks, whatever the number of shuffle partitions: many rounds of many files fill disks.
            sent = spread.join(moves, ["way", "host", "piece"]).coalesce(n).select("way", F.col("dst").alias("host"), (F.col("seed") * F.col("part")).alias("seed"), (F.col("base") * F.col("part")).alias("base"), *nothing, F.lit(1).alias("pieces"))
            stays = rank.select("way", "host", F.lit(0.0).alias("seed"), F.lit(0.0).alias("base"), *sums, "pieces")
            rank = sent.unionByName(stays).groupBy("way", "host").agg(*[F.sum(c).alias(c) for c in ("seed", "base", *sums)], F.max("pieces").alias("pieces")).coalesce(n)
            rank = rank.withColumns({"seed_sum": F.col("seed_sum") + F.col("seed"), "base_sum": F.col("base_sum") + F.col("base"), "gained": F.col("gained") + F.col("base")})
        rank = checkpoint(rank)
        if not first:
            grew = {r["way"]: r["r"] or 0.0 for r in rank.where("before > 0").groupBy("way").agg(F.max(F.col("gained") / F.col("before")).alias("r")).collect()}
            if max(grew.values(), default=0.0) < 1:
                left = F.col("gained") * F.coalesce(*[F.when(F.col("way") == w, F.lit(r / (1 - r))) for w, r in grew.items()], F.lit(0.0))
                bounds = rank.withColumn("left", left).select("way", "host", (F.col("seed_sum") / (F.col("base_sum") + F.col("left"))).alias("low"), ((F.col("seed_sum") + F.col("left")) / (F.col("base_sum") + F.col("left"))).alias("high"))
                of = lambda way, c: F.max(F.when(F.col("way") == way, F.col(c)))
                both = bounds.join(hosts.select("host"), "host", "left_semi").groupBy("host").agg(*[of(w, c).alias(f"{w}_{c}") for w in ("trust", "distrust") for c in ("low", "high")])
                least, most = F.col("distrust_low") - ratio * F.col("trust_high"), F.col("distrust_high") - ratio * F.col("trust_low")
                loose = (F.col("distrust_high") - F.col("distrust_low") > tolerance) | (F.col("trust_high") - F.col("trust_low") > tolerance)
                unsure = loose if margin is None else loose & (least <= margin) & (most > margin)
                if not both.where(unsure).limit(1).count():
                    share = lambda way: F.sum(F.when(F.col("way") == way, F.col("seed_sum") / F.col("base_sum")))
                    return rank.groupBy("host").agg(share("trust").alias("trust"), share("distrust").alias("distrust"))
        first = False
        rank = rank.withColumns({"before": F.col("gained"), "gained": F.lit(0.0)})


def host_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked_labels: tuple[str, ...] = (), ratio: float = RATIO, margin: float = MARGIN) -> DataFrame:
    """host, trust, distrust, verdict for every host of pages(url, html).

    Seeds are hosts with pages that rules cover, by the part of them that is allowed or blocked; a host with a
    label of a block list, if one is given, is distrusted as a whole.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(host.alias("host"), matched(host, path, rules, "verdict").alias("ruled"), F.col("html"))
    edges = small(host_edges(parsed))
    listed = F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in blocked_labels])) if blocked_labels else F.lit(False)
    hosts = small(
        parsed.where("host <> ''")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
        .withColumn("listed", listed)
    )
    part = lambda own, all_: F.when(F.col("listed"), F.lit(all_)).otherwise(F.col(own) / F.col("n"))
    seeds = hosts.select("host", part("allowed", 0.0).alias("trust"), part("blocked", 1.0).alias("distrust")).where("trust > 0 or distrust > 0")
    scored = hosts.select("host").join(rank_shares(edges, seeds, hosts, ratio, margin), "host")
    over = F.col("distrust") - F.col("trust") * ratio > margin
    return scored.select("host", "trust", "distrust", F.when(over, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked_labels: tuple[str, ...] = (), ratio: float = RATIO, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust.

    A host may have a large part of all pages, so the host table is repeated under each of a few
    salts and pages pick one.
    """
    host, path = host_and_path(F.col("url"))
    verdicts = small(host_verdicts(pages, rules, blocked_labels, ratio, margin))
    spread = verdicts.withColumnRenamed("verdict", "judged").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        matched(host, path, rules, "rule").alias("rule"),
        matched(host, path, rules, "verdict").alias("ruled"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    return rows.join(spread, ["host", "salt"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict"), "trust", "distrust"
    )


def op5_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
