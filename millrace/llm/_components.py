"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import Scratch


def _toward(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with `m`, the least of u and its neighbours v; and the table of the least ones."""
    least = scratch.put(edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")), f"{name}-least")
    return edges.join(least, "u"), least


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """`links`: rows (a, b) of integers. Returns (node, component): the least node reachable, for every node linked.

    Neither step gathers the neighbours of a node: a minimum is aggregated and joined back, so a
    node with very many links is spread over tasks like any skewed key. Every round is written
    to the shared folder. Rounds go on until nothing changes, which takes about the logarithm of
    the largest component.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.put(edges, "links")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, least = _toward(both, scratch, "large")
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.put(large.filter("u <> v").distinct(), "large")
        scratch.drop(least)
        small, least = _toward(large, scratch, "small")
        # all smaller neighbours, and u itself, point to the least of them
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        last, edges = edges, scratch.put(moved.filter("u <> v").distinct(), "edges")
        scratch.drop(last, large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = tuple(now)
