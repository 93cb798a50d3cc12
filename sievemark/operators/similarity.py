"""Inverted index, candidate pairs and weighted Jaccard similarity over (id, hash) sets."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.operators import meets as M
from sievemark.sources.stored import stored

WEIGHT = "decimal(18,12)"


def idf(df: Column) -> Column:
    """1 / ln(1 + df), as a decimal so that sums do not depend on their order."""
    return (1 / F.log(1 + df)).cast(WEIGHT)


def document_frequency(prints: DataFrame) -> DataFrame:
    return prints.groupBy("hash").agg(F.count("*").alias("df"))


def weighted(prints: DataFrame) -> DataFrame:
    """prints with df and weight; frequencies are combined before their shuffle, so a common hash is no large group."""
    return prints.join(document_frequency(prints), "hash").withColumn("weight", idf(F.col("df")))


def without_boilerplate(prints: DataFrame, hashes: DataFrame) -> DataFrame:
    """prints whose hash is no boilerplate; the planner chooses whether to broadcast by size."""
    return prints.join(hashes, "hash", "left_anti")


def candidate_pairs(prints: DataFrame, key: str = "doc_id", is_ref: str | None = None) -> DataFrame:
    """Distinct pairs with a hash in common, and n_shared; without pairs of references if is_ref names their mark.

    Where every row is a reference, all count as submissions.
    """
    prints = stored(prints, "prints") if is_ref else prints  # the marks are read besides
    return M.cells(key, prints, None, M.shared_hashes, M.SHARED_HASHES, is_ref=is_ref)


def weighted_jaccard(prints: DataFrame, key: str = "doc_id", is_ref: str | None = None) -> DataFrame:
    """Per candidate pair: n_shared and similarity, the weight in common over the weight of both."""
    return similarity(M.cells(key, stored(prints, "prints"), None, M.shared, M.SHARED, sized=True, is_ref=is_ref)).select(f"{key}_a", f"{key}_b", "n_shared", "similarity")


def similarity(pairs: DataFrame) -> DataFrame:
    """Pairs of meets.shared with their similarity."""
    part = F.lit(1 / Decimal(M.PART))
    of = lambda c: F.col(c).cast("decimal(20,0)") * part
    union = of("total_a") + of("total_b") - of("shared")
    score = F.when(union == 0, 0.0).otherwise(of("shared").cast("double") / union.cast("double"))
    return pairs.withColumn("similarity", F.round(score, 4))


def scored(pairs: DataFrame, totals: DataFrame, key: str = "doc_id") -> DataFrame:
    """pairs (n_shared, shared) with the similarity, from each document's total weight."""
    for s in ("a", "b"):
        pairs = pairs.join(totals.select(F.col(key).alias(f"{key}_{s}"), F.col("total").alias(f"total_{s}")), f"{key}_{s}")
    union = F.col("total_a") + F.col("total_b") - F.col("shared")
    score = F.when(union == 0, 0.0).otherwise(F.col("shared").cast("double") / union.cast("double"))
    return pairs.select(f"{key}_a", f"{key}_b", "n_shared", F.round(score, 4).alias("similarity"))


def plain_jaccard(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per candidate pair the Jaccard similarity of the hash sets, three decimals."""
    pairs = M.cells(key, stored(prints, "prints"), None, M.shared, M.SHARED, sized=True)
    score = F.col("n_shared") / (F.col("size_a") + F.col("size_b") - F.col("n_shared"))
    return pairs.select(f"{key}_a", f"{key}_b", F.round(score, 3).alias("similarity"))
