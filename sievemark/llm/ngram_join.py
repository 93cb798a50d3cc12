"""Exact similarity join of documents on their word shingles, with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent. Of two sets with a Jaccard similarity of t or more,
the first |x| - ceil(t |x|) + l shingles of each (the l-prefixes) have l in common, for every l up to
the overlap; and more, where the pair's own least overlap, t / (1 + t) of both sizes, is above ceil(t |x|).
A document takes the longer prefixes the more candidates its shingles' frequencies
promise, and a pair needs as many prefix shingles in common as the smaller of its two l asks.

1. Every shingle's document frequency is counted, in blobs of truncated hashes by range, and kept as
   a table of fixed size with the logarithm of the count, and a bitmap of those in several documents; any table gives right results, a better one fewer candidates.
2. Per document: set size, digest of the set, prefix and set. Documents with equal sets are one class,
   stood for by the smallest doc_id.
3. Stars: in the postings of each shingle, every document is verified against one pivot; links make components.
4. Shingles with postings in several components remain. Their documents outside the shingle's largest component
   are verified against the nearest of PIVOTS of its members, which joins most of what is left of large groups.
5. Only pairs of documents in different components remain to be tried: of each shingle's postings, those outside
   its largest component meet the rest. A parity sketch bounds the difference of two sets from below: bit i is the
   parity of the shingles that fall in slot i, and each shingle that only one set has flips one bit. Pairs within the bound
   and with enough prefix matches are verified on whole sets.

So a group of thousands of near copies costs a star, not its square, and no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import arrow_schema, batch_of, bounded, bounded_chunks, clear_worker, documents, materialise, n_shuffle, release_shuffles, texts_of, without
from sievemark.llm.components import components, extended

WORDS = 5
#: Slots of the frequency table (a byte each, broadcast), and the hash bits that a count tells apart below those of its range.
TABLE_BITS, COUNT_BITS = 24, 32
#: Slots of the bitmap of shingles that may be in several documents (a bit each, broadcast beside the table).
SHARED_BITS = 28
#: Bits of a parity sketch, and members of a component against which others are tried.
SKETCH_BITS, PIVOTS = 512, 8
#: Candidates that a document may expect before its prefix grows, and the longest multi-match.
EXPECTED, MOST_MATCHES = 8, 8

_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) * (2 * k + 1) & (2**64 - 1) | 1) for k in range(1, 65)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes: A-Z lower-cased, words of what is no ASCII white space."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = pa.array(chain.from_iterable(split), pa.binary()).dictionary_encode()
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    hashed = of_word[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    windows = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for k in range(words):
        windows += hashed[k : k + len(windows)] * _MULTIPLIERS[k]
    windows = _mix(windows)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= words:
            out.append(np.unique(windows[at : at + n - words + 1]))
        elif n:
            few = sum((int(hashed[at + k]) * int(_MULTIPLIERS[k]) for k in range(n)), n)
            out.append(_mix(np.array([few & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def frequency_table(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each slot of hashes the largest logarithm (base 2, rounded down) of a shingle's number of documents, and the shared bits.

    Where over half of a range's slots would be marked, only its frequent shingles are. A bit
    is set where a shingle of its (finer) slot is in several documents; where too many are, so are all bits,
    and more candidates are tried. Both are of fixed size.
    """
    spark = docs.sparkSession
    range_bits = min(16, max(4, (4 * n_shuffle(spark) - 1).bit_length()))
    ranges = 1 << range_bits
    fields = spark.createDataFrame([], "r int, hashes binary, counts binary").schema
    out_schema = arrow_schema(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = counts.astype("<u4")
            ends = np.searchsorted(keys >> np.uint64(64 - range_bits), np.arange(ranges + 1))
            short = ((keys << np.uint64(range_bits)) >> np.uint64(64 - COUNT_BITS)).astype("<u4")
            full = [i for i in range(ranges) if ends[i + 1] > ends[i]]
            return batch_of(out_schema, [full, [short[ends[i] : ends[i + 1]].tobytes() for i in full], [(counts[a:b].astype("u1") if counts[a:b].max() < 256 else counts[a:b]).tobytes() for a, b in ((ends[i], ends[i + 1]) for i in full)]])

        for batch in batches:
            for part in bounded_chunks(batch, "text"):
                for s in shingle_sets(texts_of(part.column("text")), words):
                    held.append(s)
                    size += len(s)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    slots, fine = 1 << (TABLE_BITS - range_bits), 1 << (SHARED_BITS - range_bits)
    sliced = spark.createDataFrame([], "r int, slots binary, shared binary").schema
    slice_schema = arrow_schema(sliced)

    def gather(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True):
            keys.append(np.frombuffer(h, "<u4"))
            counts.append(np.frombuffer(c, "u1" if len(c) * 4 == len(h) else "<u4").astype(np.int64))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, totals = keys[first], np.add.reduceat(counts[order], first)
        logs = np.log2(totals).astype(np.uint8)
        out, least = np.zeros(slots, np.uint8), 1
        while (logs >= least).sum() > slots // 2:
            least += 1
        marked = logs >= least
        np.maximum.at(out, keys[marked] >> np.uint32(COUNT_BITS - (TABLE_BITS - range_bits)), logs[marked])
        bits = np.zeros(fine, bool)
        bits[keys[totals > 1] >> np.uint32(COUNT_BITS - (SHARED_BITS - range_bits))] = True
        return pa.Table.from_batches([batch_of(slice_schema, [[table.column("r")[0].as_py()], [zlib.compress(out.tobytes(), 1)], [zlib.compress(np.packbits(bits).tobytes(), 1)]])])

    table, shared = np.zeros(1 << TABLE_BITS, np.uint8), np.zeros(1 << (SHARED_BITS - 3), np.uint8)
    # slices of fixed size for each range: 2**TABLE_BITS and 2**SHARED_BITS / 8 bytes in all, whatever the input
    for row in documents(docs, "text").mapInArrow(count, fields).groupBy("r").applyInArrow(gather, sliced).toLocalIterator():
        table[row["r"] * slots : (row["r"] + 1) * slots] = np.frombuffer(zlib.decompress(row["slots"]), np.uint8)
        shared[row["r"] * fine // 8 : (row["r"] + 1) * fine // 8] = np.frombuffer(zlib.decompress(row["shared"]), np.uint8)
    return table, shared


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def classes_of(shingles: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles' frequency classes: 0 for those of one document, else 1 at least."""
    table, shared = tables
    slot = (shingles >> np.uint64(64 - SHARED_BITS)).astype(np.int64)
    several = (shared[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
    return several * np.maximum(1, table[slot >> (SHARED_BITS - TABLE_BITS)])


def prefix_of(shingles: np.ndarray, tables: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The matches a document asks for, its prefix's shingles that may be in others, and for each the least l whose prefix has it."""
    n = len(shingles)
    need = _needed(n, percent)
    classes = classes_of(shingles, tables)
    order = np.argsort(classes, kind="stable")
    expected = np.cumsum(np.where(classes[order] > 0, 2.0 ** classes[order] - 1, 0))
    matches = 1
    while matches < min(need, MOST_MATCHES) and expected[n - need + matches - 1] / matches > EXPECTED:
        matches = min(2 * matches, need, MOST_MATCHES)
    order = order[: n - need + matches]
    levels = np.maximum(1, np.arange(len(order)) - (n - need) + 1)
    shared = classes[order] > 0
    return matches, shingles[order][shared], levels[shared].astype(np.int32)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """The parities of the shingles' numbers in SKETCH_BITS slots, as 64-bit integers."""
    odd = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def profiles(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """doc_id, n, digest, matches, tokens, levels, hashes, sketch of every document, written to the shared folder; the last two only where a token may be shared."""
    spark = docs.sparkSession
    shared_table = spark.sparkContext.broadcast(frequency_table(docs, words))
    release_shuffles(spark)
    fields = spark.createDataFrame([], "doc_id long, n long, digest binary, matches int, tokens array<long>, levels array<int>, hashes binary, sketch array<long>").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for batch in batches:
            for part in bounded_chunks(batch, "text"):
                cols: list[list] = [[] for _ in range(7)]
                for s in shingle_sets(texts_of(part.column("text")), words):
                    matches, tokens, levels = prefix_of(s, shared_table.value, percent) if len(s) else (1, s, np.zeros(0, np.int32))
                    raw = s.tobytes()
                    for c, v in zip(cols, (len(s), xxhash.xxh3_128_digest(raw) if len(s) else None, matches, tokens.view(np.int64), levels, raw if len(tokens) else None, sketch_of(s) if len(tokens) else None), strict=True):
                        c.append(v)
                yield batch_of(out_schema, [part.column("doc_id").cast(pa.int64()), *cols])

    return materialise(documents(docs, "doc_id", "text").mapInArrow(run, fields), "profiles")


def _alike(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _asked(a: str, b: str, matches: Column, percent: int) -> Column:
    """The prefix tokens that documents of sizes a and b must have in common at this l: each l-prefix leaves ceil(t n) - l tokens out."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent} - ({percent} * greatest({a}, {b}) + 99) div 100") + matches


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose whole sets link, with their intersection and union sizes."""
    spark = pairs.sparkSession
    fields = spark.createDataFrame([], "a long, b long, shared long, united long").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([s, t]))
                shared = int((both[1:] == both[:-1]).sum())
                united = len(s) + len(t) - shared
                if 100 * shared >= percent * united:
                    for c, v in zip(out, (a, b, shared, united), strict=True):
                        c.append(v)
            yield batch_of(out_schema, out)

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, fields)


def _near(a: str, b: str, percent: int) -> Column:
    """Whether the sketches differ in no more bits than two linked sets may differ in shingles."""
    bits = " + ".join(f"bit_count(sketch_{a}[{i}] ^ sketch_{b}[{i}])" for i in range(SKETCH_BITS // 64))
    return F.expr(f"{bits} <= ({100 - percent} * (n_{a} + n_{b})) div {100 + percent}")


def _mixed(postings: DataFrame) -> DataFrame:
    """The postings of tokens that several components share, and each token's largest component (main)."""
    by_component = postings.groupBy("token", "component").agg(F.count("*").alias("size"))
    mixed = by_component.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("largest")).where("parts > 1")
    return postings.join(mixed.select("token", F.col("largest.component").alias("main")), "token")


def _side(df: DataFrame, s: str, *more: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "matches", "level", "component", "held", "sketch")], *more)


def _tries(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each document outside a token's largest component, and that of PIVOTS of its members whose sketch is nearest."""
    member = F.struct(*[F.col(c) for c in ("doc_id", "n", "held", "sketch")])
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS))
    least = [F.min(F.when(slot == i, member)).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = rows.where("component = main").groupBy("token").agg(*least).select("token", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("p")).where("p is not null")
    pivots = pivots.select("token", *[F.col(f"p.{c}").alias(f"{c}_b") for c in ("doc_id", "n", "held", "sketch")])
    outside = _side(rows.where("component <> main"), "a", "main")
    could = _alike("n_a", "n_b", percent) & (_asked("n_a", "n_b", F.lit(1), percent) <= F.least("held_a", "held_b"))
    met = outside.join(pivots, (outside["token"] == pivots["token"]) & could & _near("a", "b", percent))
    differ = F.expr(" + ".join(f"bit_count(sketch_a[{i}] ^ sketch_b[{i}])" for i in range(SKETCH_BITS // 64)))
    return met.groupBy(F.col("doc_id_a").alias("a"), "main").agg(F.min(F.struct(differ.alias("d"), "doc_id_b")).alias("m")).select("a", F.col("m.doc_id_b").alias("b")).distinct()


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of documents in different components that share as many prefix tokens as they must; rows as of _mixed, with sketch."""
    few, all_of = _side(rows.where("component <> main"), "a"), _side(rows, "b", "main")
    least = F.least("matches_a", "matches_b")
    asked = _asked("n_a", "n_b", least, percent)
    once = (F.col("component_b") == F.col("main")) | (F.col("doc_id_a") < F.col("doc_id_b"))
    met = few.join(all_of, (few["token"] == all_of["token"]) & (F.col("component_a") != F.col("component_b")) & once & _alike("n_a", "n_b", percent) & (F.col("level_a") <= least) & (F.col("level_b") <= least) & (asked <= F.least("held_a", "held_b")) & _near("a", "b", percent))
    counted = met.groupBy(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).agg(F.count("*").alias("hits"), F.min(asked).alias("asked"))
    return counted.where("hits >= asked").select("a", "b")


def join_components(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_id (the smallest with the same set).

    Two documents link when 100 * intersection >= percent * union of their shingle sets. A text of fewer
    words than a shingle is one shingle; a null or wordless text has none and links with nothing.
    Rows with a null doc_id are kept, link with nothing and have null ids. Rows with one doc_id are
    one node: links of either count. No row gives no row.
    """
    spark = docs.sparkSession
    known = profiles(docs, percent, words)
    named = known.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    stand = classes.select(F.col("class_id").alias("doc_id")).distinct()
    with_tokens = named.where(F.size("tokens") > 0)
    sets = with_tokens.select("doc_id", "hashes")
    exploded = with_tokens.join(stand, "doc_id", "left_semi").select("doc_id", "n", "matches", F.size("tokens").alias("held"), F.explode(F.arrays_zip("tokens", "levels")).alias("t")).select("doc_id", "n", "matches", "held", F.col("t.tokens").alias("token"), F.col("t.levels").alias("level"))
    pivots = exploded.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "n", "held")).alias("p")).where("size > 1").select("token", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.held").alias("pivot_held"))
    postings = materialise(exploded.join(pivots, "token"), "postings")
    release_shuffles(spark)

    # stars: each document against the pivot with which it shares most prefix tokens
    could = _alike("n", "pivot_n", percent) & (_asked("n", "pivot_n", F.lit(1), percent) <= F.least("held", "pivot_held"))
    met = postings.where((F.col("doc_id") != F.col("pivot")) & could).groupBy("doc_id", "pivot").agg(F.count("*").alias("hits"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("hits", (-F.col("pivot")).alias("p"))).alias("m")).select(F.col("doc_id").alias("a"), (-F.col("m.p")).alias("b"))
    links = materialise(verified(best, sets, percent).select("a", "b"), "links")
    found = components(links)

    # what different components may still have in common
    labelled = lambda rows, found: rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    some = _mixed(labelled(postings.select("token", "doc_id", "n", "matches", "held", "level"), found))
    rows = materialise(some.join(with_tokens.select("doc_id", "sketch").dropDuplicates(["doc_id"]), "doc_id"), "mixed")
    release_shuffles(spark)
    tried = materialise(verified(_tries(rows, percent), sets, percent).select("a", "b"), "links")
    found = materialise(extended(found, tried), "found")
    rows = materialise(_mixed(labelled(rows.drop("component", "main"), found)), "mixed")
    more = materialise(verified(_candidates(rows, percent), sets, percent).select("a", "b"), "links")
    final = extended(found, more)

    own = classes.join(final.withColumnRenamed("node", "class_id"), "class_id", "left").select("digest", "class_id", F.coalesce("component", "class_id").alias("component"))
    out = known.select("doc_id", "n", "digest").join(own, "digest", "left")
    has = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(has, F.coalesce("component", "doc_id")).alias("component_id"), F.when(has, F.coalesce("class_id", "doc_id")).alias("class_id"))


def join_pairs(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """All linked pairs of class representatives: a < b, shared, united. Membership is in join_components' class_id."""
    known = profiles(docs, percent, words)
    named = known.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    stand = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    with_tokens = named.where(F.size("tokens") > 0).join(stand, "doc_id", "left_semi")
    postings = with_tokens.select("doc_id", "n", "matches", "sketch", F.size("tokens").alias("held"), F.explode(F.arrays_zip("tokens", "levels")).alias("t")).select(F.col("t.tokens").alias("token"), "doc_id", "n", "matches", "held", "sketch", F.col("t.levels").alias("level"), F.col("doc_id").alias("component"))
    return verified(_candidates(_mixed(materialise(postings, "postings")), percent), with_tokens.select("doc_id", "hashes"), percent).distinct()


def extra_copies(docs: DataFrame, percent: int = 80, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Of each group of linked documents all but one, as (doc_id, text_hash), and those of the kept that stand in several equal rows.

    Kept is the smallest doc_id, of several texts under it that with the smallest hash. A null doc_id is no
    hindrance: such a text goes by its hash, behind all identifiers below 2 ** 62. Texts without words are no copies. Both tables are written.
    """
    base = documents(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    stand_in = F.coalesce("doc_id", F.lit(1 << 62).bitwiseOR(F.col("text_hash").bitwiseAND(F.lit((1 << 62) - 1))))
    groups = join_components(base.select(stand_in.alias("doc_id"), "text"), percent, words).where("n_shingles > 0").select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct()
    rows = base.where(F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0).groupBy(stand_in.alias("node"), "doc_id", "text_hash").agg(F.count("*").alias("n"))
    of_group = materialise(rows.join(groups, "node"), "copies")
    kept = of_group.groupBy("component").agg(F.min(F.struct("node", "text_hash")).alias("kept"))
    several = of_group.groupBy("component").agg(F.sum("n").alias("rows")).where("rows > 1").select("component")
    told = of_group.join(kept.join(several, "component"), "component").withColumn("stays", F.struct("node", "text_hash") == F.col("kept"))
    gone = materialise(told.where("not stays").select("doc_id", "text_hash"), "gone")
    return gone, materialise(told.where("stays and n > 1").select("doc_id", "text_hash"), "repeated")


def one_of_each(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """The rows of docs without near copies: one row of each group of linked documents."""
    gone, repeated = extra_copies(docs, percent, words)
    if repeated.isEmpty():
        return without(docs, gone)
    rest = without(without(docs, gone), repeated)
    keys = bounded(repeated).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(keys["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["_hash"])
    once = docs.join(keys, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(once)
