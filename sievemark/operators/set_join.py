"""Weighted set join: pairs of (id, hash) sets whose weighted Jaccard similarity reaches a threshold, without all pairs of a common hash.

1. Equal sets are one class, stood for by its smallest id; weights still count every id.
2. Hashes are ordered from heavy (rare) to light. From hash e on, a set's suffix weighs S(e). Two sets with similarity t share at least
   t W of the weight W of either, so the first hash that they share stands where S(e) >= t W in both: only that prefix is indexed.
3. Of a pair that meets, the heaviest meeting has the larger bound: what they share is min(S_a(e), S_b(e)) at most. Pairs whose bound, or
   whose weights alone, stay below t are let go before sets are compared.
4. Postings of a hash beyond BLOCK are dealt into blocks, and each two blocks meet in a task of their own: the
   triangle of a hash in a third of all sets goes to as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.operators.similarity import idf
from sievemark.sources.stored import stored

#: Postings of a hash that meet in one task.
BLOCK = 2000
SUM = "decimal(28,12)"


def classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per id: class_id (the smallest id with the same set), class_size and size (of the set). Rows of prints are distinct; ids without a hash are not there.

    A set is told by its size and two sums, each over 60 bits of its hashes' MD5, so no set has to be in one row.
    """
    digest = F.md5(F.col("hash").cast("string").cast("binary"))
    part = lambda a, b: F.sum(F.conv(F.substring(digest, a, b), 16, 10).cast("decimal(20,0)")).alias(f"d{a}")
    sets = prints.groupBy(key).agg(F.count("*").alias("size"), part(1, 15), part(17, 15))
    by = ["size", "d1", "d17"]
    groups = sets.groupBy(*by).agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"))
    return sets.join(groups, by).select(key, "class_id", "class_size", "size")


def pairs_over(prints: DataFrame, threshold: float, key: str = "doc_id", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership). pairs: class_a < class_b, n_shared, shared, total_a, total_b of classes with similarity >= threshold; membership as classes().

    prints has distinct (key, hash) rows; a weight is 1 / ln(1 + df) over all ids. Ids of one class have similarity 1 and are told by the
    membership only. With threshold 0 all pairs with a hash in common come, the whole sets being the prefix. Sums are decimals, so equal
    inputs give equal results whatever their order; the threshold is taken to four decimals.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is from 0 to 1")
    member, sets = _weighed(prints, key)
    return _pairs(sets, threshold, block), member


def _weighed(prints: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Membership, and of each class' set the hashes that several ids have: id, hash, weight, total (of the whole set), suffix (from that hash on).

    Hashes of one id meet nothing and are the heaviest, so they stand before all others and only count in the total: most hashes are such, and go no further than their count.
    """
    prints = stored(prints.select(key, "hash"), "set-prints")
    member = stored(classes(prints, key), "set-classes")
    dealt = prints.repartition("hash")
    counts = dealt.groupBy("hash").agg(F.count("*").alias("df"), F.min(key).alias("low"), F.max(key).alias("high")).where("low < high")  # with the key, so that rows are dealt once for both
    several = dealt.join(counts.select("hash", "df"), "hash")
    of = several.join(member.where(F.col(key) == F.col("class_id")).select(key, "size"), key).select(F.col(key).alias("id"), "hash", "size", idf(F.col("df")).alias("weight"))
    rare_first = Window.partitionBy("id").orderBy(F.desc("weight"), "hash")  # a set's rows, those of one document
    whole = Window.partitionBy("id")
    held = F.sum("weight").over(whole).cast(SUM)
    lone = ((F.col("size") - F.count("*").over(whole)).cast("decimal(10,0)") * idf(F.lit(1))).cast(SUM)
    suffix = held - F.coalesce(F.sum("weight").over(rare_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(SUM)
    return member, stored(of.select("id", "hash", "weight", (held + lone).cast(SUM).alias("total"), suffix.cast(SUM).alias("suffix")), "set-sets")


def _pairs(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    t = F.lit(f"{threshold:.4f}").cast("decimal(5,4)")
    index = sets.where(F.col("suffix") >= t * F.col("total"))
    postings = index.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    postings = stored(postings, "set-postings")
    dealt = index.join(postings, "hash").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    side = lambda s, low, high: dealt.select("hash", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "total", "suffix", "b")), F.explode(F.sequence(low, high)).alias("other"))
    left = side("x", F.col("b"), F.col("blocks") - 1).select("*", F.col("b_x").alias("row"), F.col("other").alias("column")).drop("other")
    right = side("y", F.lit(0), F.col("b")).select("*", F.col("other").alias("row"), F.col("b_y").alias("column")).drop("other")
    once = (F.col("row") < F.col("column")) | (F.col("id_x") < F.col("id_y"))
    small, large = F.least("total_x", "total_y"), F.greatest("total_x", "total_y")
    met = left.join(right, ["hash", "row", "column"]).where(once & (small >= t * large))
    bound = F.least("suffix_x", "suffix_y")
    near = met.groupBy(F.least("id_x", "id_y").alias("class_a"), F.greatest("id_x", "id_y").alias("class_b")).agg(F.max(bound).alias("bound"), F.max(F.col("total_x") + F.col("total_y")).alias("both"))
    # shared >= t (both - shared)
    near = stored(near.where((F.lit(1) + t) * F.col("bound") >= t * F.col("both")).select("class_a", "class_b"), "set-candidates")

    one = lambda s: sets.select(F.col("id").alias(f"class_{s}"), "hash", *([F.col("weight")] if s == "a" else []))
    shared = near.join(one("a"), "class_a").join(one("b"), ["class_b", "hash"]).groupBy("class_a", "class_b").agg(F.count("*").alias("n_shared"), F.sum("weight").cast(SUM).alias("shared"))
    totals = sets.groupBy("id").agg(F.max("total").alias("total"))
    for s in "ab":
        shared = shared.join(totals.select(F.col("id").alias(f"class_{s}"), F.col("total").alias(f"total_{s}")), f"class_{s}")
    pairs = shared.where(F.col("shared") >= t * (F.col("total_a") + F.col("total_b") - F.col("shared")))
    return pairs.select("class_a", "class_b", "n_shared", "shared", "total_a", "total_b")


def similarity(pairs: DataFrame) -> DataFrame:
    """pairs_over's pairs with the similarity, four decimals."""
    union = F.col("total_a") + F.col("total_b") - F.col("shared")
    return pairs.select("class_a", "class_b", "n_shared", F.round(F.when(union == 0, 0.0).otherwise(F.col("shared").cast("double") / union.cast("double")), 4).alias("similarity"))


def expanded(pairs: DataFrame, member: DataFrame, key: str = "doc_id") -> DataFrame:
    """All pairs of ids (key_a < key_b) that pairs and membership stand for: n_shared, similarity. Their number is that of the pairs asked for."""
    between = similarity(pairs)
    of = lambda s: member.select(F.col(key).alias(f"_{s}"), F.col("class_id").alias(f"class_{s}"))
    ids = between.join(of("a"), "class_a").join(of("b"), "class_b").select("_a", "_b", "n_shared", "similarity")
    within = of("a").join(of("b").withColumnRenamed("class_b", "class_a"), "class_a").where("_a < _b").join(member.select(F.col(key).alias("class_a"), "size").distinct(), "class_a")
    ids = ids.unionByName(within.select("_a", "_b", F.col("size").alias("n_shared"), F.lit(1.0).alias("similarity")))
    return ids.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"), "n_shared", "similarity")


#: Thresholds that are tried in turn for the most similar pairs; at the last one every pair with a hash in common comes.
TRIED = (0.9999, 0.9, 0.5, 0.0)


def top(prints: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The most similar pairs of ids (key_a, key_b, n_shared, similarity), then by key_a and key_b; most is the length of a report.

    A threshold is taken where enough pairs lie above it, so pairs below are not made. Of a class the first most + 1 ids count: before a pair
    with a later one stand most pairs of the same two classes with earlier ones. From half a last decimal above a threshold all pairs are known.
    """
    member, sets = _weighed(prints, key)
    first = member.withColumn("_n", F.row_number().over(Window.partitionBy("class_id").orderBy(key))).where(F.col("_n") <= most + 1).drop("_n")
    order = [F.desc("similarity"), f"{key}_a", f"{key}_b"]
    for t in TRIED:
        found = expanded(_pairs(sets, t), first, key)
        found = stored((found.where(F.col("similarity") >= t + 0.00005) if t else found).orderBy(*order).limit(most), "top")
        if found.count() >= most:
            break
    return found.orderBy(*order)
