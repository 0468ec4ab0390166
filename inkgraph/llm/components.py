"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.shared import discard, join_hot, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; any orderable type); component: smallest node.

    Each round links the larger neighbours of every node to its smallest one (large star), then the smaller ones
    (small star). Aggregates combine before their shuffle, and the edges of a node of many meet its smallest neighbour
    by broadcast, so that no task gathers a hub's neighbours; rounds grow with the logarithm of the longest chain. Null
    ends and loops are ignored; no edges give no rows.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _signature(current)
    while seen[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        least = materialize(least, "least")
        large = join_hot(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        discard(least)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        for done in (current, large, least):
            discard(done)
        current, before = fresh, seen
        seen = _signature(current)
        if seen == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
