"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import discarding, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node, root), root being the component's least node; the result is a written table.

    Each round points every node at its neighbour of the least rank (or itself), follows
    the pointers twice, and contracts the edges; a node that is not a local minimum
    vanishes. Ranks are hashes of the ids, so that no order of ids (a chain of
    neighbours by number) makes long paths: the rounds are logarithmic. All steps are
    equi-joins and pre-aggregated minima; only "are edges left" comes to the driver.
    Nodes without an edge are not listed. Loops and repeated edges are harmless; an
    empty table gives an empty result.
    """
    with discarding(edges.sparkSession) as keep:
        return keep(_contracted(edges))


def _contracted(edges: DataFrame) -> DataFrame:
    ranked = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("id"))
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = both.groupBy("node").agg(F.min(ranked("to")).alias("to")).select("node", F.least("to", ranked("node"))["id"].alias("root"))
        step = materialise(step, "step")
        for _ in range(2):
            up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
            step = step.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        step = materialise(step, "step")
        if labels is None:
            labels = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
            labels = materialise(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if labels is None:
        return materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return materialise(labels.join(least, "root").select("node", F.col("least").alias("root")), "labels")
