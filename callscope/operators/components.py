"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.sources.storage import kept


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): the least node of each node's component; nodes without an edge are not listed.

    Each round hooks every node to its neighbour of the least rank, follows that twice and
    contracts the edges. Ranks are hashes of the ids, so that of any graph, also of a chain
    in order, a third of the nodes at most is expected to be left a round.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("id"))
    pairs = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, labels = kept(pairs(edges), "edges"), None
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min(ranked("b")).alias("to"))
        step = kept(least.select(F.col("a").alias("node"), F.least("to", ranked("a"))["id"].alias("root")), "hooks")
        for _ in range(2):
            up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
            step = step.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        step = kept(step, "hooks")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = step if labels is None else kept(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = kept(pairs(edges), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    first = labels.groupBy("root").agg(F.min("node").alias("first"))
    return labels.join(first, "root").select("node", F.col("first").alias("root"))
