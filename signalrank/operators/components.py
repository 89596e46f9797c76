"""Connected components of an edge table by neighbour minima with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalrank.session import cut, scratch, sized

MAX_ROUNDS = 60


def components(edges: DataFrame, most_broadcast: int | None = None) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the least node of its component. Loops and repeated edges do no harm.

    Labels of a measured small size are broadcast, so that a round shuffles once; larger ones are joined by sort and merge,
    where Spark splits a node or label that many rows have.
    """
    spark = edges.sparkSession
    with scratch(spark) as kept:
        either = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
        both = cut(edges.where("a <> b").select(either).select("e.a", "e.b").distinct(), narrow=True)
        labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), narrow=True)
        for _ in range(MAX_ROUNDS):
            small = sized(labels, most_broadcast)
            near = both.join(small.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            lower = near.join(small, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            parents = small.select(F.col("node").alias("label"), F.col("label").alias("above"))
            jumped = cut(lower.join(parents, "label").select("node", "old", F.least("label", "above").alias("label")), narrow=True)
            labels = jumped.select("node", "label")
            if jumped.where("old <> label").isEmpty():
                return kept(labels, narrow=True)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) for all of `nodes` (node); a node without edges is its own label."""
    found = components(edges)
    return nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
