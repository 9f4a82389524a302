"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from case_insights.llm.store import discard, saved


def _to_smallest(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest among them and the node.

    ``smaller_only``: of neighbours below the node (and the node itself); else neighbours above it. The
    smallest is a plain aggregate with partial sums in each task, so a node with very many neighbours
    costs each task one row in it, and the join that follows may be split by adaptive execution."""
    if smaller_only:
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    else:
        both = edges.union(edges.select("b", "a")).toDF("node", "near")
    smallest = both.groupBy("node").agg(F.min("near").alias("low"))
    joined = both.join(smallest, "node")
    low = F.least("low", "node")
    if smaller_only:
        linked = joined.select("near", low.alias("low")).union(joined.select("node", low))
    else:
        linked = joined.filter("near > node").select("near", low.alias("low"))
    return linked.toDF("x", "low").filter("x <> low").select(F.col("low").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (two columns of one orderable type, any order,
    repeats allowed): the smallest node of its connected component. No edges give no rows.

    Each round is written to shared storage; about log(n) rounds are needed. Links that touch the same
    node twice (self-links) and nulls are ignored, so a node with only such links has no row."""
    edges = saved(edges.toDF("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        before, edges = edges, saved(_to_smallest(_to_smallest(edges, False), True), "edges")
        discard(before)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(edges.select("a", "a").distinct())
