"""Connected components by contraction: each round hooks every node to its least neighbour and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maregraph.llm.common import persisted


def connected_components(links: DataFrame) -> DataFrame:
    """Rows `node, root` (root: least node reachable) for the nodes of links `a, b` (long).

    Edges shrink from round to round: both ends are replaced by their hook and loops go,
    so a path halves at least and a star goes in one round. Rounds meet only through
    written tables. A hub isn't one task's aggregate, as tasks give a row a node, nor one
    task's join: both sides are plain exchanges, whose large partitions Spark splits.
    """
    edges = persisted(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        hook = persisted(hook, "hooks")
        # follow the hooks twice: every step leads to a smaller node of the same component
        for _ in range(2):
            nxt = hook.select(F.col("node").alias("up"), F.col("up").alias("next"))
            hook = hook.join(nxt, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
        hook = persisted(hook, "hooks")
        here = hook.select(F.col("node").alias("root"), "up")
        if roots is None:
            roots = hook.select("node", F.col("up").alias("root"))
        else:
            roots = persisted(roots.join(here, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("up").alias("up_a")), "a")
        left = left.join(hook.select(F.col("node").alias("b"), F.col("up").alias("up_b")), "b")
        edges = persisted(left.filter("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "links")
    if roots is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    return roots
