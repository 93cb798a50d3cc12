"""Collocations: contiguous phrases mined by prefix growth over projected occurrences, scored by their weakest cut.

Everything is per language. A word goes by a 64-bit hash of language and word, which is checked against all words.

1. Words are counted. A phrase is frequent only if its words are, and its pairs of neighbours.
2. Pairs of neighbouring frequent words are counted, which are the phrases of two words and the prefixes of all others. Filters
   of fixed size tell frequent words and pairs; a rare one that passes costs work and never a result.
3. Three words that are not frequent are let go by their slot, in which all threes of one hash are counted: each task counts in slots of
   fixed number, and the tasks' slots are summed. A slot that reaches the threshold by several rare ones costs work and never a result.
   Projection: every occurrence of three words that may be frequent gives what stands from there on, up to five words and as far as
   threes may be frequent. Equal ones are counted before they are shuffled by their prefix, the pair.
4. Growth: within the task of a prefix its projected occurrences are sorted, so the occurrences of each longer prefix are
   a run within the run of the shorter one; one pass grows all of them depth-first, to the right, with
   a counter for each depth. So no prefix has to fit in memory. Prefixes with over a thousandth of all occurrences are
   dealt over many tasks by what follows them, and the tasks' counts are summed.
5. Candidates meet the counts of their parts and of the phrases one word longer by joins on written tables.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.common import arrow_schema, batch_of, clear_worker, documents, materialise, n_shuffle

#: What ends a piece; words are runs of what is no space and no tab.
PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]+")
LONGEST = 5
#: Slots of the filters (a bit each, broadcast), and bytes of text that a task splits at once.
BITS, SLICE = 27, 4_000_000
#: Different words, pairs and windows that a task counts before it sends them on, and how many of them it takes in at once.
WORDS_HELD, PAIRS_HELD, WINDOWS_HELD, AT_ONCE = 400_000, 1_200_000, 500_000, 250_000
#: Slots in which threes are counted, and slots of a row (a byte or more each).
THREES, ROW_SLOTS = 1 << 24, 1 << 16
#: A prefix with more than one in HOT of all words is dealt over as many tasks by what follows.
HOT = 1024
#: Buckets in which the first phrases of a language are sought before they meet.
BUCKETS = 64

_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) | 1) for k in range(LONGEST)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased; b"." stands where a piece ends, and is no word."""
    return PIECE_END.sub(b" . ", text.lower()).split()


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The text in slices of about size, cut before a space, tab or end of a piece, so that no word is cut (a longer word stays whole)."""
    at = 0
    while len(text) - at > size:
        found = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]").search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def word_ids(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """64-bit hashes of a language's words; never 0, which is the end of a piece."""
    name = lang.encode("utf-8", "surrogatepass")
    start = len(name).to_bytes(4, "big") + name
    out = np.fromiter((xxhash.xxh3_64_intdigest(start + w, seed) for w in words), np.uint64, len(words))
    out[out == 0] = 1
    return out


def streams(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, bool]]:
    """lang, the dictionary of words, their ids, and the stream as indices into it (-1: end of a piece); whether the next one goes on from this.

    Texts of one language stand behind each other; a text longer than a slice is told in several, which go on.
    """

    def encoded(lang: str, split: list[list[bytes]], goes_on: bool):
        flat = [w for ws in split for w in (*ws, b".")]
        if goes_on:
            flat.pop()
        words = pa.array(flat, pa.binary()).dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        if b"." in (known := words.dictionary.to_pylist()):
            index = np.where(index == known.index(b"."), -1, index)
        return lang, words.dictionary, word_ids(known, lang, seed), index, goes_on

    held: dict[str, tuple[list[list[bytes]], int]] = {}
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            text = text.as_py()
            if len(text) > SLICE:
                parts = list(slices(text))
                for i, part in enumerate(parts):
                    yield encoded(lang, [tokens(part)], i + 1 < len(parts))
                continue
            split, size = held.pop(lang, ([], 0))
            split.append(tokens(text))
            size += len(text)
            if size > SLICE:
                yield encoded(lang, split, False)
            else:
                held[lang] = split, size
        if sum(size for _, size in held.values()) > SLICE:
            for lang, (split, _) in held.items():
                yield encoded(lang, split, False)
            held = {}
    for lang, (split, _) in held.items():
        yield encoded(lang, split, False)


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    return documents(docs, "lang", "text").where("text is not null").select(lang.alias("lang"), "text")


def count_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, id, n of every word."""
    fields = docs.sparkSession.createDataFrame([], "lang string, word string, id long, n long").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        held: dict[str, dict[bytes, int]] = {}  # where a word's id and count stand
        ids, counts = array("Q"), array("q")

        def flush():
            langs = [lang for lang, of in held.items() for _ in of]
            words = pa.array((w for of in held.values() for w in of), pa.binary()).cast(pa.string())
            at = np.fromiter((i for of in held.values() for i in of.values()), np.int64, len(ids))
            return batch_of(out_schema, [langs, words, np.frombuffer(ids, np.int64)[at] if ids else [], np.frombuffer(counts, np.int64)[at] if ids else []])

        for lang, known, hashes, index, _ in streams(batches, seed):
            of = held.setdefault(lang, {})
            found = np.bincount(index[index >= 0], minlength=len(known))
            for w, h, n in zip(known.to_pylist(), hashes.tolist(), found.tolist(), strict=True):
                if (i := of.get(w)) is not None:
                    counts[i] += n
                elif n:
                    of[w] = len(ids)
                    ids.append(h)
                    counts.append(n)
            if len(ids) > WORDS_HELD:
                yield flush()
                held, ids, counts = {}, array("Q"), array("q")
        yield flush()

    return _texts(docs).mapInArrow(run, fields).groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def bitmap(keys: DataFrame, name: str, bits: int = BITS) -> np.ndarray:
    """A Bloom filter of 64-bit keys with two bits for each, from its upper and its lower half; of fixed size, 8 bytes for each 64 slots come to the driver."""
    key = F.col(name)
    slots = F.array(F.shiftrightunsigned(key, 64 - bits), key.bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    slot = F.col("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    cells = keys.select(F.explode(slots).alias("slot")).groupBy(F.shiftrightunsigned(slot, 6).alias("cell")).agg(F.bit_or(bit).alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = cells.toArrow()
    out[found.column("cell").to_numpy()] = found.column("b").to_numpy()
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of a key are there."""
    cells, n = bits.view(np.uint64), np.uint64(len(bits) * 64)
    upper, lower = keys >> np.uint64(64 - (len(bits) * 64 - 1).bit_length()), keys & (n - np.uint64(1))
    held = lambda slot: (cells[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return held(upper) & held(lower)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A key for each word and its right neighbour."""
    return _mix(left * _ODD[0] + _mix(right * _ODD[1]))


def window_keys(windows: np.ndarray) -> np.ndarray:
    return _mix((windows * np.array(_ODD[: windows.shape[1]])).sum(axis=1, dtype=np.uint64))


def _chains(batches: Iterator[pa.RecordBatch], seed: int, words: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Streams as ids (0: end of a piece or a word that is not frequent), and in how many places a phrase may begin.

    Where a stream goes on, its last words are told again at the head of the next one, and phrases that begin there come then.
    """
    before = np.zeros(0, np.uint64)
    for _, _, hashes, index, goes_on in streams(batches, seed):
        of = np.append(np.where(marked(words, hashes), hashes, 0), np.uint64(0)).astype(np.uint64)
        ids = np.concatenate([before, of[index]])
        ahead = min(len(ids), LONGEST - 1) if goes_on else 0
        before = ids[len(ids) - ahead :] if goes_on else np.zeros(0, np.uint64)
        yield ids, len(ids) - ahead


def count_pairs(docs: DataFrame, words: np.ndarray, seed: int = 0) -> DataFrame:
    """w1, w2, n: how often neighbours that may both be frequent occur."""
    spark = docs.sparkSession
    fields = spark.createDataFrame([], "w1 long, w2 long, n long").schema
    out_schema, shared = arrow_schema(fields), spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()

        def found():
            for ids, starts in _chains(batches, seed, shared.value):
                both = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
                both = both[both < starts]
                yield np.column_stack([ids[both], ids[both + 1]])

        for pairs, n in combined(found(), PAIRS_HELD):
            yield batch_of(out_schema, [*_columns(pairs), n])

    return _texts(docs).mapInArrow(run, fields).groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def with_keys(pairs: DataFrame) -> DataFrame:
    """pairs (w1, w2, n) with the key that tells them in filters."""
    fields = pairs.sparkSession.createDataFrame([], "w1 long, w2 long, n long, pair long").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w1, w2 = (b.column(w).to_numpy().view(np.uint64) for w in ("w1", "w2"))
            yield batch_of(out_schema, [b.column("w1"), b.column("w2"), b.column("n"), pair_keys(w1, w2).view(np.int64)])

    return pairs.select("w1", "w2", "n").mapInArrow(run, fields)


def _columns(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[:, k].copy().view(np.int64) for k in range(rows.shape[1])]


WINDOW = ("w1", "w2", "w3", "w4", "w5")


def threes_of(ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where three words begin of whose pairs both may be frequent."""
    if len(ids) < 3:
        return np.zeros(0, np.int64)
    linked = (ids[:-1] != 0) & (ids[1:] != 0)
    linked[linked] = marked(pairs, pair_keys(ids[:-1][linked], ids[1:][linked]))
    return np.flatnonzero(linked[:-1] & linked[1:])


def three_slots(ids: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    return (window_keys(np.column_stack([ids[at], ids[at + 1], ids[at + 2]])) & np.uint64(slots - 1)).astype(np.int64)


def count_threes(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, least: int, seed: int = 0, slots: int = THREES) -> np.ndarray:
    """Which slots hold at least so many occurrences of threes, a bit each; of fixed size on the driver.

    A task's counts stop at least, which is all that a sum has to know, so a slot is a byte where least is below 256.
    """
    spark = docs.sparkSession
    per_row = min(ROW_SLOTS, slots)
    fields = spark.createDataFrame([], "part int, counts binary").schema
    out_schema, shared = arrow_schema(fields), spark.sparkContext.broadcast((words, pairs))
    kind = np.min_scalar_type(least)

    def rows(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, counts in parts.items():
            yield batch_of(out_schema, [[part], [counts.tobytes()]])

    def add(parts: dict[int, np.ndarray], part: int, at: np.ndarray | slice, counts: np.ndarray) -> None:
        held = parts.setdefault(part, np.zeros(per_row, kind))
        held[at] = np.minimum(held[at].astype(np.int64) + counts, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        words, pairs = shared.value
        parts: dict[int, np.ndarray] = {}
        for ids, starts in _chains(batches, seed, words):
            at = threes_of(ids, pairs)
            found, n = np.unique(three_slots(ids, at[at < starts], slots), return_counts=True)
            of, first = np.unique(found // per_row, return_index=True)
            for part, start, end in zip(of.tolist(), first, [*first[1:], len(found)]):  # noqa: B905, as there may be none
                add(parts, part, found[start:end] % per_row, n[start:end])
        yield from rows(parts)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                add(parts, part, slice(None), np.frombuffer(counts.as_buffer(), kind))
        yield from rows({part: np.packbits(counts >= least, bitorder="little") for part, counts in parts.items()})

    found = _texts(docs).mapInArrow(run, fields).repartition(n_shuffle(spark), "part").mapInArrow(summed, fields).toArrow()
    out = np.zeros((slots // per_row, per_row // 8), np.uint8)
    for part, bits in zip(found.column("part").to_pylist(), found.column("counts").to_pylist(), strict=True):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def windows_of(ids: np.ndarray, starts: int, pairs: np.ndarray, threes: np.ndarray | None = None) -> np.ndarray:
    """For each place where three words begin that may be frequent (all, without threes): the words as far as threes are, LONGEST at most, then zeros."""
    every = threes_of(ids, pairs)
    if threes is not None and len(every):
        slot = three_slots(ids, every, len(threes) * 8)
        every = every[(threes[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)]
    begins = every[every < starts]
    out = np.zeros((len(begins), LONGEST), np.uint64)
    padded, on = np.append(ids, np.zeros(LONGEST, np.uint64)), np.zeros(len(ids) + LONGEST, bool)
    on[every] = True
    out[:, 0], out[:, 1], alive = padded[begins], padded[begins + 1], np.ones(len(begins), bool)
    for k in range(2, LONGEST):
        alive &= on[begins + k - 2]
        out[alive, k] = padded[begins[alive] + k]
    return out


def counted(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the counts of equal neighbours summed, after a sort by hash (so nearly all equal ones are neighbours)."""
    order = np.argsort(window_keys(rows), kind="stable")
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[first], np.add.reduceat(counts, first)


def combined(parts: Iterator[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Equal rows of parts with their counts, combined as far as `most` different ones go."""
    taken, size, held = [], 0, None

    def together():
        every = np.concatenate([*([held[0]] if held else []), *taken])
        return counted(every, np.concatenate([*([held[1]] if held else []), np.ones(size, np.int64)]))

    for part in parts:
        if len(part):
            taken.append(part)
            size += len(part)
        if size > AT_ONCE:
            held, taken, size = together(), [], 0
            if len(held[0]) > most:
                yield held
                held = None
    if size:
        held = together()
    if held:
        yield held


def project(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, threes: np.ndarray, hot: list[int], seed: int = 0) -> DataFrame:
    """The projected occurrences: w1 to w5, salt, n. salt is 0 but for hot pairs, whose windows are dealt by their hash."""
    spark = docs.sparkSession
    fields = spark.createDataFrame([], ", ".join(f"{w} long" for w in WINDOW) + ", salt int, n long").schema
    out_schema, shared = arrow_schema(fields), spark.sparkContext.broadcast((words, pairs, threes, np.array(sorted(hot), np.int64).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        words, pairs, threes, hot = shared.value
        found = (windows_of(ids, starts, pairs, threes) for ids, starts in _chains(batches, seed, words))
        for every, n in combined(found, WINDOWS_HELD):
            salts = 1 + (window_keys(every) % np.uint64(HOT)).astype(np.int32)
            is_hot = np.isin(pair_keys(every[:, 0], every[:, 1]), hot)
            yield batch_of(out_schema, [*_columns(every), np.where(is_hot, salts, 0).astype(np.int32), n])

    return _texts(docs).mapInArrow(run, fields)


def grown(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of three words and more, and counts, from sorted batches (windows, salts, counts): depth by depth the runs of equal prefixes.

    Runs that a batch leaves open go on in the next one. Runs below least are let go, but for salted ones, which are parts.
    """
    open_: dict[int, tuple[np.ndarray, int, int]] = {}  # depth: prefix, salt, count so far

    def told(prefixes, salts, sums):
        kept = (sums >= least) | (salts > 0)
        return prefixes[kept], sums[kept]

    for windows, salts, counts in batches:
        if not len(windows):
            continue
        for depth in range(3, LONGEST + 1):
            rows = np.flatnonzero(windows[:, depth - 1])
            if not len(rows):
                continue
            prefixes, salt = np.zeros((len(rows), LONGEST), np.uint64), salts[rows]
            prefixes[:, :depth] = windows[rows, :depth]
            first = np.flatnonzero(np.r_[True, (prefixes[1:] != prefixes[:-1]).any(axis=1) | (salt[1:] != salt[:-1])])
            sums, prefixes, salt = np.add.reduceat(counts[rows], first), prefixes[first], salt[first]
            if depth in open_:
                held, of, n = open_[depth]
                if (prefixes[0] == held).all() and salt[0] == of:
                    sums[0] += n
                else:
                    prefixes, salt, sums = np.vstack([held[None], prefixes]), np.r_[of, salt], np.r_[n, sums]
            open_[depth] = prefixes[-1], salt[-1], int(sums[-1])
            yield told(prefixes[:-1], salt[:-1], sums[:-1])
    for prefix, salt, n in open_.values():
        yield told(prefix[None], np.array([salt]), np.array([n], np.int64))


def frequent_phrases(projected: DataFrame, least: int) -> DataFrame:
    """ids (array of 3 to 5), f of every phrase with f >= least."""
    spark = projected.sparkSession
    fields = spark.createDataFrame([], ", ".join(f"{w} long" for w in WINDOW) + ", f long").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()

        def arrays():
            for b in batches:
                yield np.column_stack([b.column(w).to_numpy() for w in WINDOW]).view(np.uint64), b.column("salt").to_numpy(), b.column("n").to_numpy()

        for phrases, f in grown(arrays(), least):
            if len(f):
                yield batch_of(out_schema, [*_columns(phrases), f])

    dealt = projected.repartition(n_shuffle(spark), "w1", "w2", "salt").sortWithinPartitions("salt", *WINDOW)
    parts = dealt.mapInArrow(run, fields)
    whole = parts.groupBy(*WINDOW).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return whole.select(F.filter(F.array(*WINDOW), lambda w: w != 0).alias("ids"), "f")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide(a) * wide(n)).cast("decimal(34,0)"), (wide(l) * wide(r)).cast("decimal(34,0)"))


def _seeded_words(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """All words, with a seed for which no frequent word shares its id."""
    seed = 0
    while True:
        words = materialise(count_words(docs, seed), "words")
        if words.groupBy("id").agg(F.count("*").alias("c"), F.max("n").alias("m")).where(f"c > 1 and m >= {least}").isEmpty():
            return words, seed
        seed += 1


def mine(docs: DataFrame, most: int = 2000, least: int = 100, drop_percent: int = 100) -> DataFrame:
    """The first `most` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z lower-cased and are split at .,;:!? and line ends into pieces, these at spaces and tabs into words; phrases lie
    within a piece. n counts a language's words, a a phrase's occurrences, of overlapping ones each. Phrases are of 2 to 5 words with a >= least;
    l and r count the parts of the cut with the lowest score floor(1000 a n / (l r)), the first of several. A phrase goes if it lies within a longer one
    with 100 f(longer) >= drop_percent * a; as counts fall with length, one word longer is enough to look at. Order: score and a
    descending, then the phrase in the order of its UTF-8 bytes. A null lang is "und", null and empty texts have no words, ids do not matter,
    repeated rows count each, and tables without a frequent phrase give no row. Texts are read four times; words and
    whole counts are shuffled, never texts.
    """
    if not 0 < drop_percent <= 100:
        raise ValueError("drop_percent is from 1 to 100")
    spark = docs.sparkSession
    words, seed = _seeded_words(docs, least)
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "words-totals")
    frequent = materialise(words.where(F.col("n") >= least), "words-frequent")
    word_bits = bitmap(frequent, "id")
    pairs = materialise(with_keys(count_pairs(docs, word_bits, seed).where(F.col("n") >= least)), "pairs")
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot = [r["pair"] for r in pairs.where(F.col("n") * HOT > total).select("pair").collect()]  # fewer than HOT, as pairs are not more than words
    pair_bits = bitmap(pairs, "pair")
    projected = project(docs, word_bits, pair_bits, count_threes(docs, word_bits, pair_bits, least, seed), hot, seed)
    longer = frequent_phrases(projected, least)
    phrases = materialise(longer.unionByName(pairs.select(F.array("w1", "w2").alias("ids"), F.col("n").alias("f"))), "phrases")
    return _ranked(spark, phrases, frequent, totals, most, drop_percent)


def _ranked(spark: SparkSession, phrases: DataFrame, frequent: DataFrame, totals: DataFrame, most: int, drop_percent: int) -> DataFrame:
    size = F.size("ids")
    known = materialise(phrases.unionByName(frequent.select(F.array("id").alias("ids"), F.col("n").alias("f"))), "counts")
    within = phrases.where(size > 2).select(F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"), F.col("f").alias("longer"))
    within = within.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = phrases.join(within, "ids", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * drop_percent)).select("ids", F.col("f").alias("a"))
    kept = materialise(kept, "candidates")

    spelt = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(frequent.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"), F.min("lang").alias("lang"))  # five words at most
    spelt = spelt.select("ids", "lang", F.array_join("words.word", " ").alias("phrase"))

    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", 1, F.col("k")), "right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select(F.col("ids").alias(side), F.col("f").alias(name)), side)
    scored = cuts.join(spelt, "ids").join(totals, "lang").withColumn("score", score(*map(F.col, ("a", "n", "l", "r"))))
    best = scored.groupBy("ids", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    near = rows.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("place") <= most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
