"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import materialise, n_shuffle


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b).

    Nulls, loops and repeated edges are let go. Each round hooks every node to its smallest neighbour
    and halves the distances, so rounds grow with the logarithm of the longest path; nothing is collected but counts.
    """
    spark = edges.sparkSession
    few = max(1, n_shuffle(spark) // 4)
    pairs = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(few), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(smallest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialise(hooked.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct().coalesce(few), "edges")
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now


def extended(found: DataFrame, more: DataFrame) -> DataFrame:
    """components with further edges (a, b): of whole components, each one node, and of nodes that were in none."""
    name = lambda s: found.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    edges = more.join(name("a"), "a", "left").join(name("b"), "b", "left")
    links = components(edges.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    up = links.select(F.col("node").alias("component"), F.col("component").alias("higher"))
    known = found.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
    return known.unionByName(links.join(found.select("node"), "node", "left_anti"))
