"""What each of several filters removes, in every order of them: a histogram of failure masks, and permutations from its cells.

Native expressions turn each document into a mask of the filters it fails, one bit each; equality with an earlier document comes from
the groups of equal texts. A part's documents are then 2 ** filters counts at most, from which
all orders follow: after the filters of a set S, those documents are left whose mask has no bit of S.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import bounded, materialise
from sievemark.llm.exact_dedup import deduplicate

#: Words are runs of what is no ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: The filters in the order of their bits; the last one is that of copies.
LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def text_masks(text: Column) -> Column:
    """Bits of the filters that need the text only: 1 fewer than 200 words, 2 under half of the words distinct, 4 over 3 % capitals, 8 a sign of #$%&*|.

    A null text is empty; it fails the first one only.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    numbers = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]  # so that the words are made once
    bit = lambda failed, b: F.when(failed, b).otherwise(0)
    of_words = F.transform(F.array(numbers), lambda k: bit(k["all"] < 200, 1) + bit(k["distinct"].cast("long") * 100 < k["all"].cast("long") * 50, 2))[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return of_words + bit(capitals * 100 > F.char_length(text).cast("long") * 3, 4) + bit(text.rlike("[#$%&*|]"), 8)


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each language (null: empty) by the filters they fail, and how many are labelled so.

    A document fails the last filter if any with a smaller doc_id has its text, byte for byte; null identifiers are neither smaller nor larger, those
    that repeat are not smaller than each other. A document is good (toxic) if any of its labels says 1.
    """
    carry = {"part": F.coalesce(docs["lang"], F.lit("")), "mask": text_masks(docs["text"])}
    rows = deduplicate(docs, keep="smallest", carry=carry).select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("keep_id"), 16).otherwise(0)).alias("mask"))
    is_one = lambda c: F.coalesce(F.bool_or(labels[c] == 1), F.lit(False)).alias(c)
    marks = materialise(labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic")), "audit-labels")
    marked = rows.join(bounded(marks), "doc_id", "left")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic"))


def with_steps(rows: DataFrame) -> DataFrame:
    """rows for each permutation of the filters (filter_order) and step, with the step's bit and the bits before and after it."""
    every = F.split(F.lit(",".join(map("".join, permutations(LETTERS)))), ",")
    rows = rows.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bit = lambda at: F.pow(F.lit(2), F.ascii(F.substring("filter_order", at, 1)) - ord(LETTERS[0])).cast("int")
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(LETTERS))), F.lit(0), lambda sum_, at: sum_ + F.when(at < F.col("step"), bit(at)).otherwise(0))
    rows = rows.withColumns({"bit": bit(F.col("step")), "before": before})
    return rows.withColumn("after", F.col("before") + F.col("bit"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part has all its 600 rows, zeros included; no document gives no row. Null and repeated identifiers, null texts and languages: as in
    histogram. What is shuffled is one row for each document's hash, and counts.
    """
    cells = histogram(docs, labels)
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # a cell for each mask: 32 at most
    subsets = F.sequence(F.lit(0), F.lit((1 << len(LETTERS)) - 1))
    total = lambda test, c: F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda s, x: s + x[c])
    left_of = lambda c: F.transform(subsets, lambda s: total(lambda x: x["mask"].bitwiseAND(s) == 0, c))
    left = {f"left_{c}": left_of(c) for c in COUNTS}
    exact = F.transform(subsets, lambda s: total(lambda x: x["mask"] == s, "n"))
    rows = with_steps(held.select("part", *[v.alias(k) for k, v in left.items()], exact.alias("exact")))
    of = lambda c, s: F.get(F.col(c), F.col(s))
    lost = lambda c: of(c, "before") - of(c, "after")
    fails = F.get("left_n", F.lit(0)) - of("left_n", "bit")
    rows = rows.select(
        "part", "filter_order", "step", "bit", of("left_n", "after").alias("kept"), lost("left_n").alias("removed"), (fails - lost("left_n")).alias("redundant"),
        of("exact", "bit").alias("unique_fails"), lost("left_good").alias("good_lost"), lost("left_toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")  # 120 rows
