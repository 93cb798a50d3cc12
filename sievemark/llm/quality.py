"""Quality by perplexity under an interpolated modified Kneser-Ney model of bytes, a model for each language.

Trusted texts are counted as runs of five bytes; a mark byte stands before a word that repeats the one before
it, so that repetition, which trusted text lacks, is unlikely under the model. Counts are sharded by the two bytes before
the predicted one: all contexts and runs of three bytes and more that concern one prediction then lie in one
shard, and only the table of byte pairs (256 * 256 values for each language, whatever the input) goes everywhere.

To score, documents are dealt into blocks; a block asks each shard once for the distinct runs it holds, a join
of requests and shards answers with log probabilities, and a second join brings them back to the block's texts.
A document is rejected where its bits a byte exceed its language's limit, which comes from quantiles of
trusted texts that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import arrow_schema, batch_of, bounded_chunks, clear_worker, documents, materialise, n_shuffle, texts_of, without

ORDER, SHARDS = 5, 64
#: Runs that wait until they are added to a shard's counts.
WAITING = 2_000_000
START, AGAIN = b"\x02", "\x01"
#: Bytes of text of a block, and characters of the pieces in which texts are counted.
BLOCK_BYTES, PIECE_CHARS = 8_000_000, 4_000_000
#: Blocks whose requests meet one copy of the counts; for more blocks there are more copies.
BLOCKS_A_COPY = 512
#: The languages with most trusted texts have models of their own, so many at most; other texts go to one model of all trusted texts.
LANGUAGES, POOL = 200, "\x00"
#: One trusted text in so many is kept from the counts and sets the limit.
HELD_OUT = 5
#: The limit: the median of unseen trusted texts and so many times the way from there to their upper quantile.
UPPER, REACH = 0.95, 4.0
#: A text is judged as if so many bytes at its language's median stood beside it: short texts vary more.
PRIOR_BYTES = 64

_MARKS = str.maketrans("\x00\x01\x02", "   ")


class Words:
    """The texts' bytes, word by word: white space as one space, a mark before a word like the one before, a space behind.

    Most runs of five bytes lie within a word or in its first bytes and the four before it; both are
    numbered once for each distinct word and each distinct border, so that work goes with words, not bytes.
    runs holds the runs with repeats: those of border i, then of word i, as often as place says.
    """

    def __init__(self, texts: list[str]):
        flat, counts = [], []
        for t in texts:
            words = (t.translate(_MARKS) if "\x00" in t or "\x01" in t or "\x02" in t else t).split()
            flat += [w if w != p else AGAIN + w for w, p in zip(words, chain((None,), words))]
            counts.append(len(words))
        self.n_words = np.array(counts, np.int64)
        numbered = pa.array(flat, pa.string()).dictionary_encode()
        spelt = [w.encode("utf-8", "replace") + b" " for w in numbered.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        raw = np.frombuffer(b"".join(spelt) + bytes(ORDER), np.uint8).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        self.word = word = numbered.indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        self.sizes = np.add.reduceat(np.r_[sizes[word], 0], np.minimum(np.cumsum(self.n_words) - self.n_words, len(word))) * (self.n_words > 0) if len(counts) else np.zeros(0, np.int64)
        keys = np.zeros(max(0, len(raw) - ORDER + 1), np.uint64)
        for i in range(ORDER):
            keys = (keys << np.uint64(8)) | raw[i : i + len(keys)]
        # the first four bytes of each word, zeros behind short ones, and the last four, zeros before
        short = np.minimum(sizes, 4).astype(np.uint64)
        head = keys[starts] >> np.uint64(8)
        head = (head >> (np.uint64(32) - np.uint64(8) * short)) << (np.uint64(32) - np.uint64(8) * short)
        ends = starts + sizes
        tail = np.zeros(len(spelt), np.uint64)
        for i in range(4, 0, -1):
            tail = (tail << np.uint64(8)) | np.where(sizes >= i, raw[np.maximum(ends - i, 0)], np.uint64(0))
        # the four bytes before each word of the texts: a word with its space has two bytes at least, so two words hold them
        start = np.zeros(len(word), bool)
        start[(np.cumsum(self.n_words) - self.n_words)[self.n_words > 0]] = True
        filled = np.uint64(int.from_bytes(START * 4, "big"))
        own, size = tail[word], np.minimum(sizes[word], 4).astype(np.uint64)
        joined = lambda before: np.where(size >= 4, own, ((before << (np.uint64(8) * size)) | own) & np.uint64(0xFFFFFFFF))
        last = joined(np.where(start, filled, np.r_[filled, own[:-1]] if len(own) else own))
        last = joined(np.where(start, filled, np.r_[filled, last[:-1]] if len(own) else own))
        context = np.where(start, filled, np.r_[filled, last[:-1]] if len(own) else own)
        borders = pa.array(((context << np.uint64(32)) | head[word]).view(np.int64)).dictionary_encode()
        self.border = borders.indices.to_numpy().astype(np.int64) if len(word) else np.zeros(0, np.int64)
        pairs = borders.dictionary.to_numpy().view(np.uint64)
        cells = [(np.where((pairs & np.uint64(0xFF << 24 - 8 * i)) > 0, (pairs >> np.uint64(24 - 8 * i)) & np.uint64((1 << 40) - 1), np.uint64(0))) for i in range(4)]
        crossing = np.stack(cells, axis=1).ravel() if len(pairs) else np.zeros(0, np.uint64)
        within = np.maximum(sizes - 4, 0)
        place = np.repeat(starts - (np.cumsum(within) - within), within) + np.arange(within.sum())
        valid = crossing > 0
        self.of_border = np.repeat(np.arange(len(pairs)), 4)[valid]
        self.of_word = np.repeat(np.arange(len(spelt)), within)
        self.runs = np.concatenate([crossing[valid], keys[place]])
        self.n_borders, self.n_spelt = len(pairs), len(spelt)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct runs, sorted, with their numbers in the texts."""
        often = np.concatenate([np.bincount(self.border, minlength=self.n_borders)[self.of_border], np.bincount(self.word, minlength=self.n_spelt)[self.of_word]])
        return _added(self.runs, often)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of the runs' values (one for each of runs) over each text."""
        k = len(self.of_border)
        border = np.bincount(self.of_border, values[:k], self.n_borders)
        word = np.bincount(self.of_word, values[k:], self.n_spelt)
        each = np.r_[0.0, np.cumsum(border[self.border] + word[self.word])]
        ends = np.cumsum(self.n_words)
        return each[ends] - each[ends - self.n_words]


def shard_of(keys: np.ndarray) -> np.ndarray:
    middle = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((middle * np.uint64(0x9E3779B1)) >> np.uint64(12)) % np.uint64(SHARDS)


def _packed(keys: np.ndarray) -> bytes:
    return (keys >> np.uint64(32)).astype("u1").tobytes() + keys.astype("<u4").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return (np.frombuffer(blob[:n], "u1").astype(np.uint64) << np.uint64(32)) | np.frombuffer(blob[n:], "<u4").astype(np.uint64)


def _sized(counts: np.ndarray) -> bytes:
    """Counts of four bytes each, or of eight where one needs them."""
    return counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<i8").tobytes()


def _unsized(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if len(blob) == 4 * n else "<i8").astype(np.int64)


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > PIECE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def lower(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of one byte less that end alike, each with the number of distinct bytes seen before it."""
    return np.unique(keys & np.uint64((1 << 8 * (order - 1)) - 1), return_counts=True)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from how many runs have counts of 1 to 4."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


def interpolated(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, d: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities of the runs asked for, from sorted keys with counts and the next lower order's probabilities."""
    if not len(keys):
        return below
    contexts = keys >> np.uint64(8)
    first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]])
    classes = np.minimum(counts, 3)
    total = np.add.reduceat(counts, first).astype(np.float64)
    mass = np.add.reduceat(d[classes], first) / total
    contexts = contexts[first]
    at = np.minimum(np.searchsorted(contexts, asked >> np.uint64(8)), len(contexts) - 1)
    seen = contexts[at] == asked >> np.uint64(8)
    k = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    found = keys[k] == asked
    own = np.where(found, counts[k] - d[classes[k]], 0.0)
    return np.where(seen, own / total[at] + mass[at] * below, below)


def pair_table(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probabilities of a byte after a byte, 256 * 256, from continuation counts."""
    c2 = np.zeros(1 << 16, np.int64)
    c2[pairs] = counts
    c1 = (c2.reshape(256, 256) > 0).sum(0)
    every = np.arange(256, dtype=np.uint64)
    of = lambda c: discounts(*(float((c == k).sum()) for k in (1, 2, 3, 4)))
    p1 = interpolated(every[c1 > 0], c1[c1 > 0], every, of(c1), np.full(256, 1 / 256))
    both = np.arange(1 << 16, dtype=np.uint64)
    return interpolated(both[c2 > 0], c2[c2 > 0], both, of(c2), np.tile(p1, 256))


def log_probabilities(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, d: dict[int, np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """log2 of the probability of each run's last byte, from the shard that holds its middle bytes."""
    k4, c4 = lower(keys, 5)
    k3, c3 = lower(k4, 4)
    p = pairs[(asked & np.uint64(0xFFFF)).astype(np.int64)]
    for k, c, o in ((k3, c3, 3), (k4, c4, 4), (keys, counts, 5)):
        p = interpolated(k, c, asked & np.uint64((1 << 8 * o) - 1), d[o], p)
    return np.log2(p)


class Model:
    """Count shards (a table: lang, r, keys, counts), and for each language the discounts and pair table."""

    def __init__(self, shards: DataFrame, by_lang: dict[str, tuple[dict[int, np.ndarray], np.ndarray]]):
        self.shards, self.by_lang = shards, by_lang


def train(trusted: DataFrame) -> Model:
    """Count every text of trusted (lang, text); a null language counts as the language named by the empty text."""
    spark = trusted.sparkSession
    fields = spark.createDataFrame([], "lang string, r int, keys binary, counts binary").schema
    out_schema = arrow_schema(fields)

    def rows_of(lang: str, keys: np.ndarray, counts: np.ndarray):
        shard = shard_of(keys)
        for r in np.unique(shard).tolist():
            yield lang, r, _packed(keys[shard == r]), counts[shard == r].astype("<u4").tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        known: dict[str, list] = {}
        for batch in batches:
            for part in bounded_chunks(batch, "text"):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), texts_of(part.column("text")), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    for piece in _pieces(texts):
                        keys, counts = Words(piece).counted()
                        old = known.get(lang)
                        known[lang] = [keys, counts] if old is None else list(_added(np.concatenate([old[0], keys]), np.concatenate([old[1], counts])))
                if sum(len(k) for k, _ in known.values()) > 8_000_000:
                    for lang, (keys, counts) in known.items():
                        yield batch_of(out_schema, list(map(list, zip(*rows_of(lang, keys, counts), strict=True))) or [[], [], [], []])
                    known = {}
        for lang, (keys, counts) in known.items():
            if len(keys):
                yield batch_of(out_schema, list(map(list, zip(*rows_of(lang, keys, counts), strict=True))))

    merged = spark.createDataFrame([], "lang string, r int, keys binary, counts binary, stats array<long>, pairs array<int>, pair_counts array<int>").schema
    merged_schema = arrow_schema(merged)

    def finished(lang: str, r: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        k4, c4 = lower(keys, 5)
        k3, c3 = lower(k4, 4)
        k2, c2 = lower(k3, 3)
        stats = [int((c == k).sum()) for c in (c3, c4, counts) for k in (1, 2, 3, 4)]
        return batch_of(merged_schema, [[lang], [r], [_packed(keys)], [_sized(counts)], [stats], [k2.astype(np.int32)], [c2.astype(np.int32)]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted partial counts, one shard after the other: what is held are its distinct runs and as many that wait, however many parts come."""
        clear_worker()
        at, waiting, size = None, [], 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def together():
            return _added(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))

        for batch in batches:
            for lang, r, k, c in zip(*(batch.column(x).to_pylist() for x in ("lang", "r", "keys", "counts")), strict=True):
                if at is not None and at != (lang, r):
                    yield finished(*at, *together())
                    keys, counts, waiting, size = keys[:0], counts[:0], [], 0
                at = lang, r
                waiting.append((_unpacked(k), np.frombuffer(c, "<u4").astype(np.int64)))
                size += len(waiting[-1][0])
                if size > max(len(keys), WAITING):
                    (keys, counts), waiting, size = together(), [], 0
        if at is not None:
            yield finished(*at, *together())

    parts = documents(trusted, "lang", "text").withColumn("lang", F.coalesce("lang", F.lit(""))).mapInArrow(count, fields)
    sorted_parts = parts.repartition(n_shuffle(spark), "lang", "r").sortWithinPartitions("lang", "r")
    shards = materialise(sorted_parts.mapInArrow(merge, merged), "counts")
    # at most SHARDS * 12 numbers and 65,536 pairs for each language, whatever the input
    stats = shards.select("lang", F.posexplode("stats").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n")).toLocalIterator()
    numbers: dict[str, dict[int, int]] = {}
    for row in stats:
        numbers.setdefault(row["lang"], {})[row["i"]] = row["n"]
    pairs = shards.select("lang", F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).groupBy("lang", "p.pairs").agg(F.sum("p.pair_counts").alias("n"))
    seen: dict[str, tuple[list, list]] = {}
    for row in pairs.toLocalIterator():
        for c, v in zip(seen.setdefault(row["lang"], ([], [])), (row["pairs"], row["n"]), strict=True):
            c.append(v)
    by_lang = {}
    for lang, n in numbers.items():
        d = {o: discounts(*(float(n[4 * i + k]) for k in range(4))) for i, o in enumerate((3, 4, 5))}
        by_lang[lang] = d, pair_table(np.array(seen[lang][0], np.int64), np.array(seen[lang][1], np.int64))
    return Model(shards.select("lang", "r", "keys", "counts"), by_lang)


def bits_per_byte(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, tag, lang, n_bytes, bits (a byte; null for texts without words and languages that the model lacks).

    docs: doc_id, tag (a text that goes along), lang (the model to take), text.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tag", "lang", F.coalesce("text", F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64("doc_id", F.substring("text", -64, 64)), F.lit(blocks))
    dealt = base.withColumn("block", block)
    shared = spark.sparkContext.broadcast(model.by_lang)  # 512 KB for each language
    ask = spark.createDataFrame([], "block long, lang string, r int, keys binary").schema
    ask_schema = arrow_schema(ask)
    reply = spark.createDataFrame([], "block long, lang string, r int, logs binary").schema
    reply_schema = arrow_schema(reply)
    out = spark.createDataFrame([], "doc_id long, tag string, lang string, n_bytes long, bits double").schema
    out_schema = arrow_schema(out)

    def langs_of(table: pa.Table) -> dict[str, list[int]]:
        rows: dict[str, list[int]] = {}
        for i, lang in enumerate(table.column("lang").to_pylist()):
            rows.setdefault(lang, []).append(i)
        return rows

    def distinct(pieces: list[Words]) -> np.ndarray:
        return np.unique(np.concatenate([w.runs for w in pieces])) if pieces else np.zeros(0, np.uint64)

    def request(table: pa.Table) -> pa.Table:
        clear_worker()
        rows: list[list] = [[], [], [], []]
        for lang, where in langs_of(table).items():
            if lang in shared.value:
                keys = distinct([Words(p) for p in _pieces(table.column("text").take(where).to_pylist())])
                shard = shard_of(keys)
                for r in np.unique(shard).tolist():
                    for c, v in zip(rows, (table.column("block")[0].as_py(), lang, r, _packed(keys[shard == r])), strict=True):
                        c.append(v)
        return pa.Table.from_batches([batch_of(ask_schema, rows)])

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], []]
        if asked.num_rows:
            lang = asked.column("lang")[0].as_py()
            keys = _unpacked(shard.column("keys")[0].as_py()) if shard.num_rows else np.zeros(0, np.uint64)
            counts = _unsized(shard.column("counts")[0].as_py(), len(keys)) if shard.num_rows else np.zeros(0, np.int64)
            for block, r, blob in zip(*(asked.column(c).to_pylist() for c in ("block", "r", "keys")), strict=True):
                logs = log_probabilities(keys, counts, _unpacked(blob), *shared.value[lang]).astype("<f4").tobytes()
                for c, v in zip(rows, (block, lang, r, logs), strict=True):
                    c.append(v)
        return pa.Table.from_batches([batch_of(reply_schema, rows)])

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([batch_of(out_schema, [[], [], [], [], []])])
        sizes, bits = [0] * table.num_rows, [None] * table.num_rows
        got = {(lang, r): np.frombuffer(b, "<f4") for lang, r, b in zip(*(replies.column(c).to_pylist() for c in ("lang", "r", "logs")), strict=True)}
        for lang, where in langs_of(table).items():
            known = lang in shared.value
            pieces = [Words(p) for p in _pieces(table.column("text").take(where).to_pylist())]
            keys = distinct(pieces) if known else np.zeros(0, np.uint64)
            logs = np.zeros(len(keys))
            shard = shard_of(keys)
            for r in np.unique(shard).tolist():
                logs[shard == r] = got[lang, r]
            at = 0
            for piece in pieces:
                totals = piece.sums(logs[np.searchsorted(keys, piece.runs)]) if known else piece.sizes
                for total, size in zip(totals.tolist(), piece.sizes.tolist(), strict=True):
                    sizes[where[at]] = size
                    bits[where[at]] = -total / size if known and size else None
                    at += 1
        return pa.Table.from_batches([batch_of(out_schema, [*(table.column(c).combine_chunks() for c in ("doc_id", "tag", "lang")), sizes, bits])])

    copies = blocks // BLOCKS_A_COPY + 1
    asked = dealt.groupBy("block").applyInArrow(request, ask).withColumn("copy", F.pmod("block", F.lit(copies)))
    counts = model.shards.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    answers = asked.groupBy("lang", "r", "copy").cogroup(counts.groupBy("lang", "r", "copy")).applyInArrow(answer, reply)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)


def _ids(labels: DataFrame, condition: str) -> DataFrame:
    ids = labels.where(condition).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return materialise(ids, "ids")  # its size decides whether it is broadcast


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, n_bytes, bits, perplexity (2 ** bits, of a byte), judged_bits, bits_limit, keep, text_hash.

    Trusted are the documents labelled quality 1, all of them. Empty and null texts have null bits and are kept.
    Texts in a language without trusted texts, or with a null one, are judged by a model and limit of all trusted texts.
    A language with no unseen trusted text takes the quantiles of those seen; without any trusted text all are kept. Rows with null or
    repeated doc_id are scored each for itself; text_hash tells repeated ids apart; no row gives no row.
    """
    base = documents(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("said"), "text")
    good = _ids(labels, "quality = 1")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    trusted = base.join(good, "doc_id", "left_semi")
    # at most LANGUAGES names come to the driver
    known = [r["said"] for r in trusted.groupBy("said").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "said").limit(LANGUAGES).collect()]
    pooled = bool(base.where(~F.col("said").isin(known)).limit(1).count())
    own = F.when(F.col("said").isin(known), F.col("said")).otherwise(POOL)
    every = trusted.withColumn("lang", own)
    if pooled:
        every = every.where(F.col("lang") != POOL).unionByName(trusted.withColumn("lang", F.lit(POOL)))
    model = train(every.where(~held))
    asked = base.select("doc_id", F.concat_ws("|", F.xxhash64("text"), "said").alias("tag"), own.alias("lang"), "text")
    if pooled:  # the trusted texts show what the pooled model's limit should be
        asked = asked.unionByName(trusted.where(own != POOL).select("doc_id", F.lit(None).cast("string").alias("tag"), F.lit(POOL).alias("lang"), "text"))
    scored = materialise(bits_per_byte(asked, model), "perplexity")
    seen = scored.join(good, "doc_id", "left_semi").where("bits is not null").select("lang", F.round("bits", 3).alias("bits"), held.alias("held"))
    # exact quantiles of rounded values: their number is bounded, whatever the input
    cut = lambda h: F.when(h, F.col("bits"))
    q = seen.groupBy("lang").agg(F.percentile(cut(F.col("held")), F.array(F.lit(0.5), F.lit(UPPER))).alias("h"), F.percentile("bits", F.array(F.lit(0.5), F.lit(UPPER))).alias("a"))
    q = q.select("lang", F.coalesce("h", "a").alias("q"))
    limits = q.select("lang", F.col("q")[0].alias("median"), F.round(F.col("q")[0] + REACH * (F.col("q")[1] - F.col("q")[0]), 4).alias("bits_limit"))
    out = scored.where("tag is not null").join(F.broadcast(limits), "lang", "left")  # LANGUAGES + 1 rows at most
    judged = (F.col("bits") * F.col("n_bytes") + F.col("median") * PRIOR_BYTES) / (F.col("n_bytes") + PRIOR_BYTES)
    keep = F.coalesce(judged <= F.col("bits_limit"), F.lit(True))
    said = F.expr("substr(tag, instr(tag, '|') + 1)")
    return out.select("doc_id", said.alias("lang"), "n_bytes", F.round("bits", 4).alias("bits"), F.round(F.pow(F.lit(2.0), F.col("bits")), 3).alias("perplexity"), F.round(judged, 4).alias("judged_bits"), "bits_limit", keep.alias("keep"), F.expr("cast(substr(tag, 1, instr(tag, '|') - 1) as bigint)").alias("text_hash"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify keeps, told by doc_id (null too) and text."""
    rejected = classify(docs, labels).where("not keep").select("doc_id", "text_hash").distinct()
    return without(docs, materialise(rejected, "rejected"))
