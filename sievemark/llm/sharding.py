"""Balanced label propagation: documents into shards, linked ones together, sizes even. DataFrame functions only.

Documents that share a link key (their text) are neighbours. Large keys claim shards first, the largest
before the others: whole where a shard has room, else on as few shards as hold them. All others start on hashed
shards, as many on each as the claims leave room for. Each
round counts, for every key, its documents by shard, and a key's documents on one shard
ask to move to the shard that holds most of the key. For each ordered pair of shards a quota admits as many
as come back the other way, and what room the capacity leaves beside other linked documents; larger gains go first, and of
the documents of one key that meet the quota's end the first ones go. At
last every shard keeps its first documents in the order of keys, up to its even share, unlinked ones going first,
and the surplus fills the shards that lack some. The law is "rows": counts differ by one at most.

Links are never listed in pairs: a key's histogram over shards stands for all of its edges, so a key that
holds a third of all documents costs one row for each shard. At most SHARDS * CLAIMS keys are large; only these
and their counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import documents, materialise

SHARDS, ROUNDS, SLACK = 24, 4, 0.02
#: Ordering buckets for each shard, and those that a large key is cut into.
BUCKETS, PARTS = 64, 16
#: A key is large, and claims its place, with more than a shard's even share over this.
CLAIMS = 64


def _round(linked: DataFrame, fixed: DataFrame, capacity: int, number: int) -> DataFrame:
    """One round of moves: linked (doc_id, size, crc, link, shard) with new shards; fixed (shard, n) counts what stays."""
    held = linked.groupBy("link", "shard").agg(F.count("*").alias("c"))
    luck = F.xxhash64("link", "shard", F.lit(number))  # so that ties don't all go one way, nor the same way in each round
    best = held.groupBy("link").agg(F.max(F.struct("c", luck.alias("luck"), "shard")).alias("m")).select("link", F.col("m.shard").alias("to"), F.col("m.c").alias("most"))
    units = held.join(best, "link").where(F.col("shard") != F.col("to")).select("link", F.col("shard").alias("from"), "to", "c", (F.col("most") - F.col("c")).alias("gain"))
    flows = units.groupBy("from", "to").agg(F.sum("c").alias("want"))
    back = flows.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("want").alias("back"))
    loads = linked.groupBy("shard").agg(F.count("*").alias("n")).unionByName(fixed).groupBy("shard").agg(F.sum("n").alias("load"))
    room = loads.select(F.col("shard").alias("to"), F.greatest(F.lit(0), F.lit(capacity) - F.col("load")).alias("room"))
    asked = flows.groupBy("to").agg(F.sum("want").alias("asked"))
    quota = flows.join(back, ["from", "to"], "left").join(room, "to", "left").join(asked, "to")
    share = F.floor(F.coalesce("room", F.lit(capacity)) * F.col("want") / F.col("asked"))
    quota = quota.select("from", "to", F.least("want", F.coalesce("back", F.lit(0)) + share).alias("quota"))
    ahead = Window.partitionBy("from", "to").orderBy(F.desc("gain"), "link").rowsBetween(Window.unboundedPreceding, 0)
    admitted = units.join(quota, ["from", "to"]).withColumn("before", F.sum("c").over(ahead) - F.col("c")).where("before < quota")
    admitted = admitted.select("link", F.col("from").alias("shard"), "to", (F.col("quota") - F.col("before")).alias("most"))
    nth = F.row_number().over(Window.partitionBy("link", "shard").orderBy("doc_id"))  # no large key is here
    moved = linked.withColumn("nth", nth).join(admitted, ["link", "shard"], "left")
    return materialise(moved.select("doc_id", "size", "crc", "link", F.when(F.col("nth") <= F.col("most"), F.col("to")).otherwise(F.col("shard")).alias("shard")), "linked")


def claims(large: list[tuple[str, int]], free: list[int]) -> list[tuple[str, int, int, int]]:
    """Pieces (link, shard, low, high) of the large keys, in ranks within the key; free is left with the room of each shard."""
    pieces = []
    for link, n in sorted(large, key=lambda k: (-k[1], k[0])):
        at = 0
        while at < n:
            whole = [s for s, room in enumerate(free) if room >= n - at]
            s = min(whole, key=lambda s: (free[s], s)) if whole else max(range(len(free)), key=lambda s: (free[s], -s))
            take = min(n - at, free[s])
            pieces.append((link, s, at, at + take))
            free[s] -= take
            at += take
    return pieces


def _placed(rows: DataFrame, large: DataFrame, pieces: DataFrame, threshold: int) -> DataFrame:
    """Documents of large keys on the claimed shards; the rank within a key is by parts of about threshold rows."""
    rows = rows.join(F.broadcast(large), "link").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("of_link") / threshold)))
    offsets = rows.groupBy("link", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("link").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = offsets.select("link", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("link", "part").orderBy("doc_id")) - 1
    rows = rows.withColumn("nth", nth).join(F.broadcast(offsets), ["link", "part"]).withColumn("nth", F.col("nth") + F.col("offset"))
    at = rows.join(F.broadcast(pieces), "link").where("nth >= low and nth < high")
    return at.select("doc_id", "size", "crc", "link", "shard")


def _ranked(all_docs: DataFrame) -> DataFrame:
    """A gapless rank within each shard: large keys first, then other linked documents, by key; windows are over buckets, not shards."""
    spread = F.pmod(F.xxhash64("link"), F.lit(BUCKETS))
    within = F.when(F.col("kind") == 0, 1 + F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(0)
    rows = all_docs.withColumn("bucket", (F.col("kind") * BUCKETS + spread) * (PARTS + 1) + within)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("link", "doc_id")) - 1
    return rows.withColumn("place", place).join(offsets, ["shard", "bucket"]).withColumn("rank", F.col("place") + F.col("offset"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is rows).

    size is the text's UTF-8 bytes plus 8; a null text is an empty one here. Equal texts are linked.
    Rows with null or repeated doc_id are documents like others; no row gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = documents(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.md5(F.encode(text, "UTF-8")).alias("link"))
    base = materialise(base, "sharding")
    counts = materialise(base.groupBy("link").agg(F.count("*").alias("of_link")).where("of_link > 1"), "counts")
    total = base.count()
    capacity = int(total / shards * (1 + SLACK)) + 1
    large = [(r["link"], r["of_link"]) for r in counts.where(F.col("of_link") * (shards * CLAIMS) > total).collect()]
    free = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = claims(large, free)
    large_keys = spark.createDataFrame(large, "link string, of_link long")
    placed = base.join(F.broadcast(large_keys.select("link")), "link", "left_semi")
    placed = materialise(_placed(placed, large_keys, spark.createDataFrame(pieces, "link string, shard int, low long, high long"), total // (shards * CLAIMS) + 1), "placed")
    fixed = spark.createDataFrame([(s, high - low) for _, s, low, high in pieces], "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))

    others = base.join(F.broadcast(large_keys.select("link")), "link", "left_anti")
    at, start = F.pmod(F.xxhash64("doc_id", "link"), F.lit(max(1, sum(free)))), F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        start = F.when(at < sum(free[: s + 1]), s).otherwise(start)
    others = others.withColumn("shard", start.cast("int"))
    linked = materialise(others.join(counts, "link", "left_semi").select("doc_id", "size", "crc", "link", "shard"), "linked")
    alone = others.join(counts, "link", "left_anti").select("doc_id", "size", "crc", "link", "shard")
    for number in range(rounds):
        linked = _round(linked, fixed, capacity, number)
    every = placed.withColumn("kind", F.lit(0)).unionByName(linked.withColumn("kind", F.lit(1))).unionByName(alone.withColumn("kind", F.lit(2)))
    ranked = _ranked(every)

    # even shares and what lacks: a row for each shard
    load = {r["shard"]: r["n"] for r in every.groupBy("shard").agg(F.count("*").alias("n")).toLocalIterator()}
    order = sorted(range(shards), key=lambda s: (-load.get(s, 0), s))
    share = {s: total // shards + (i < total % shards) for i, s in enumerate(order)}
    surplus, lack, so_far, at = [], [], 0, 0
    for s in range(shards):
        surplus.append((s, share[s], so_far))
        so_far += max(0, load.get(s, 0) - share[s])
        if (need := share[s] - load.get(s, 0)) > 0:
            lack.append((s, at, at + need, load.get(s, 0)))
            at += need
    limits = spark.createDataFrame(surplus, "shard int, share long, before long")
    ranked = ranked.join(F.broadcast(limits), "shard").withColumn("over", F.when(F.col("rank") >= F.col("share"), F.col("before") + F.col("rank") - F.col("share")))
    new_shard, new_slot = F.col("shard"), F.col("rank")
    for s, low, high, first in lack:
        here = (F.col("over") >= low) & (F.col("over") < high)
        new_shard, new_slot = F.when(here, s).otherwise(new_shard), F.when(here, F.col("over") - low + first).otherwise(new_slot)
    return ranked.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), new_shard.cast("int").alias("shard"), new_slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
