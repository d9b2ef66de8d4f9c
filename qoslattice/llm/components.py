"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest
    node that can be reached.

    Each round takes the smallest label among a node and its neighbours, then
    jumps to that label's own label, so a chain's reach doubles with each round. A
    hub's rows meet one row of the other side, by a sort-merge join whose large
    partitions Spark splits; groups are added up before they are shuffled.

    Defined results: links of a node to itself and repeated links add nothing; no
    links give no nodes; ends are not null.
    Every round is written to the shared folder; it ends when no label changes.
    """
    # Written first: the links' own plan would run once for each direction.
    one_way = materialize(links.select("a", "b").filter("a <> b"))
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        # A node's own label stands beside its neighbours': no second join with the labels.
        beside = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        own = labels.select("node", "label", F.col("label").cast("long").alias("was"))
        lower = beside.unionByName(own).groupBy("node").agg(F.min("label").alias("step"), F.max("was").alias("was"))
        roots = labels.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        after = materialize(lower.join(roots, "step").select("node", "was", F.col("jump").alias("label")))
        discard(labels)
        labels = after.drop("was")
        if after.filter("label <> was").isEmpty():
            discard(one_way)
            return labels
