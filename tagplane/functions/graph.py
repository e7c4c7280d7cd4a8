"""Connected components of a table of links by hooking and jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links that one task handles in a round.
LINKS_PER_TASK = 250_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that the session names; set here only where it names none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/shared")
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """A table as Parquet in the folder that driver and executors share, read again: smaller than a checkpoint."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/shared"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the least node reachable.

    Each round a node takes the least label among its neighbours, hands it to the node that its own
    label names, and jumps to the label of its label. As whole trees hook onto each other, rounds grow
    with the logarithm of the size of a component, not with the length of its chains. The links stay as
    they are and labels are a table of their own, so that a node with very many links is a skewed side
    of a join, which adaptive execution splits; minima are partial before each shuffle. Links of a node
    with itself and repeated links make no difference; without links the result is empty.
    """
    both = checkpoint(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    n = max(1, -(-both.count() // LINKS_PER_TASK))
    both = both.coalesce(n)
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")).coalesce(n))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").withColumn("least", F.least("component", "near"))
        hooked = met.select("node", "least", F.col("component").alias("was")).union(met.select("component", "least", F.lit(None)))
        lower = hooked.groupBy("node").agg(F.min("least").alias("to"), F.max("was").alias("was"))
        target = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        moved = checkpoint(lower.join(target, "to").select("node", F.least("to", "far").alias("component"), "was").coalesce(n))
        changed = moved.where("component <> was").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
