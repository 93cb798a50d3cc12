"""Exact copies by a 128-bit hash of the content, bytes compared within groups. DataFrame functions only.

1. Each row is written once with its hash and a number of its own, without its text.
2. Rows are counted by hash, combined before the shuffle: a hash that a third of all rows share sends a row for each task.
3. The texts of hashes that occur more than once are grouped by hash *and* text, again combined before the shuffle, so
   a copy moves once for each task. Grouping compares the bytes; a hash with more than one text is a collision.
4. Rows of a hash without collisions get their group by a join on the hash; both sides are written tables, so
   Spark can split a hot hash. Rows of colliding hashes (none, unless somebody made them) are grouped by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import BROADCAST_ROWS, materialise

#: The inner column of the carried ones, which may have any names within.
_CARRIED = "_carried"


def content_hash(text: Column) -> Column:
    """16 bytes: MD5 of the UTF-8 text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _group(rows: DataFrame, by: list[str], keep: str) -> DataFrame:
    """Size of each group and the row that stays: by doc_id (null ones last), of equal ones the first row."""
    known = F.col("doc_id").isNotNull()
    if keep == "largest":
        first = F.max(F.struct(known.alias("known"), "doc_id", (-F.col("row")).alias("row")))
        row = -first["row"]
    else:
        first = F.min(F.struct((~known).alias("known"), "doc_id", "row"))
        row = first["row"]
    return rows.groupBy(*by).agg(F.count("*").alias("group_size"), first["doc_id"].alias("keep_id"), row.alias("keep_row"))


def deduplicate(docs: DataFrame, keep: str = "smallest", carry: dict[str, Column] | None = None, content: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 and the carried columns.

    Rows with equal texts, byte for byte, are one group; a null text equals an empty one. Of a group the row with the smallest (or
    keep="largest") doc_id is kept; a null doc_id only where the group has no other, and of several rows with that doc_id
    one. carry names further columns to return, which may be computed from any column of docs. Groups are whole, however large;
    no row gives no row. Texts are read twice at most, and those without a copy never move while the hashes that occur more than once
    are few enough to broadcast (common.BROADCAST_ROWS); beyond that every distinct text moves once.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    text = F.coalesce(docs["text"], F.lit(""))
    carried = F.struct(*[c.alias(n) for n, c in (carry or {}).items()]) if carry else F.lit(None).cast("int")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), content(text).alias("hash"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"), carried.alias(_CARRIED))
    rows = materialise(base.withColumn("row", F.monotonically_increasing_id()), "copies-rows")
    groups = materialise(_group(rows, ["hash"], keep).where("group_size > 1"), "copies-groups")
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), carried.alias(_CARRIED)).withColumn("hash", content(F.col("text")))
    # beyond the bound all texts are compared: a text that occurs once is a group like others
    compared = texts.join(F.broadcast(groups.select("hash")), "hash", "left_semi") if few else texts
    different = compared.groupBy("hash", "text").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("texts"))
    collided = materialise(different.where("texts > 1").select("hash"), "copies-collisions")
    if collided.isEmpty():
        out = _joined(rows, groups, ["hash"])
    else:
        odd = texts.join(collided, "hash", "left_semi").withColumns({"row": F.monotonically_increasing_id(), "text_sha256": F.sha2(F.encode("text", "UTF-8"), 256)})
        odd = materialise(odd, "copies-odd")
        own = materialise(_group(odd, ["hash", "text"], keep), "copies-odd-groups")
        out = _joined(rows.join(collided, "hash", "left_anti"), groups, ["hash"]).unionByName(_joined(odd, own, ["hash", "text"]))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return out.select(*columns, *([F.col(f"{_CARRIED}.`{n}`").alias(n) for n in carry] if carry else []))


def _joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with their group; a row whose group is not listed is alone."""
    met = rows.join(groups, by, "left")
    alone = F.col("group_size").isNull()
    return met.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", _CARRIED)
