"""Tokens, adaptive k-grams and winnowed fingerprints, per document and without a shuffle but for that of texts."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark import params as P

WORD = r"[\p{L}\p{N}]+"
#: Bytes of a text beyond which it goes in segments, and characters of a segment.
LONG_BYTES, SEGMENT_CHARS = 4 << 20, 1 << 18
#: Tokens within which a stretch's neighbours have to hold what its windows need, and bytes of rows that a task tells at once.
REACH, BATCH_BYTES = 64, 4 << 20
#: Bytes of a scan for each task, so that a task's memory does not grow with the input.
SPLIT_BYTES = 8 << 20
#: A size beyond that of any table: the planner does not know.
UNKNOWN_BYTES = 1 << 53
#: Characters of a hash, and digits and last of a place.
HEX, DIGITS, LAST = 32, 9, 999_999_999


def by_steps(value: Column, steps, last) -> Column:
    """CASE over (below, result) steps."""
    out = F
    for below, result in steps:
        out = out.when(value < below, result)
    return out.otherwise(last)


def adaptive_k(n: Column) -> Column:
    return by_steps(n, P.K_STEPS, P.K_LAST)


def adaptive_window(n: Column) -> Column:
    return by_steps(n, P.WINDOW_STEPS, P.WINDOW_LAST)


def words(text: str = "text") -> Column:
    """Prose tokens: runs of letters and digits, in lower case; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def tokenised(docs: DataFrame, text: str = "text", with_lines: bool = False) -> DataFrame:
    """docs with tokens, n_tokens, k, w, and lines (each token's line) if asked for."""
    if with_lines:  # a line's words are found once, for tokens and lines
        of_line = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))
        out = docs.withColumn("_words", of_line)
        out = out.withColumns({"tokens": F.flatten("_words"), "lines": F.flatten(F.transform("_words", lambda x, i: F.array_repeat((i + 1).cast("int"), F.size(x))))}).drop("_words")
    else:
        out = docs.withColumn("tokens", words(text))
    out = out.withColumn("n_tokens", F.size("tokens"))
    return out.withColumn("k", adaptive_k(F.col("n_tokens"))).withColumn("w", adaptive_window(F.col("n_tokens")))


def with_grams(docs: DataFrame) -> DataFrame:
    """Tokenised docs with grams: (i, h) of each k-gram with enough different tokens; the tokens of a gram are sliced once."""
    least = F.when(F.col("n_tokens") < P.SHORT_TOKENS, 2).otherwise(3)
    return docs.withColumn("grams", grams_of(F.col("tokens"), F.col("k"), least, F.lit(0)))


def grams_of(tokens: Column, k: Column, least: Column, first: Column) -> Column:
    """(i, h) of the k-grams of tokens with at least so many different ones; i counts from first."""
    starts = F.when(F.size(tokens) >= k, F.sequence(F.lit(0), F.size(tokens) - k)).otherwise(F.array().cast("array<int>"))
    slices = F.transform(starts, lambda i: F.struct((i + first).cast("int").alias("i"), F.slice(tokens, i + 1, k).alias("s")))
    kept = F.filter(slices, lambda g: F.size(F.array_distinct(g["s"])) >= least)
    return F.transform(kept, lambda g: F.struct(g["i"].alias("i"), F.md5(F.concat_ws(" ", g["s"]).cast("binary")).alias("h")))


def winnowed_hashes(hashes: Column, w: Column) -> Column:
    """The distinct minima of all windows of w hashes; of fewer, the one minimum."""
    m = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(1), m - w + 1), lambda i: F.array_min(F.slice(hashes, i, w)))
    return F.when(m == 0, F.array().cast("array<string>")).when(m < w, F.array(F.array_min(hashes))).otherwise(F.array_distinct(windows))


def with_winnowed_grams(docs: DataFrame) -> DataFrame:
    """docs with minima: like winnowed_hashes for grams (i, h), each window's rightmost minimum; of too few grams, the leftmost.

    A gram is a string of its hash and of LAST less its place, so that distinct minima are told by their hashes: of structs, each would be
    compared with all before it, which is quadratic in the text. right is a column of its own, so that it is not made anew for each window.
    """
    m = F.size("right")
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), m - F.col("w") + 1), lambda i: F.array_min(F.slice("right", i, F.col("w")))))
    place = lambda x: (F.lit(LAST) - F.substring(x, -DIGITS, DIGITS).cast("int")).cast("int")
    back = lambda a: F.transform(a, lambda x: F.struct(F.substring(x, 1, HEX).alias("h"), place(x).alias("i")))
    least = F.array(F.array_min(back(F.col("right"))))
    out = docs.withColumn("right", F.transform("grams", lambda g: F.concat(g["h"], F.lpad((F.lit(LAST) - g["i"]).cast("string"), DIGITS, "0")))).drop("grams")
    return out.withColumn("minima", F.when(m == 0, F.slice(back(F.col("right")), 1, 0)).when(m < F.col("w"), least).otherwise(back(windows))).drop("right")


def _told(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The winnowed k-grams of some texts (tokens behind one another, a space between): the text and first token of each, and its MD5.

    Like with_grams and with_winnowed_grams: each window's rightmost minimum, of too few grams the leftmost.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
    offsets = (offsets - offsets[0]).astype(np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])  # texts with a token
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == ord(" "))
    starts, ends = np.sort(np.r_[offsets[full], gaps + 1]), np.sort(np.r_[gaps, offsets[full + 1]])
    text = np.searchsorted(offsets[full], starts, side="right") - 1
    n = np.bincount(text, minlength=len(full))
    first = np.cumsum(n) - n
    k, w, least = np.array([(_step(x, P.K_STEPS, P.K_LAST), _step(x, P.WINDOW_STEPS, P.WINDOW_LAST), 2 if x < P.SHORT_TOKENS else 3) for x in n.tolist()], np.int64).reshape(-1, 3).T
    # the place before, in its text, of each token
    ids = pa.array(data.split(b" ") if len(full) == 1 else [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    order = np.lexsort((ids, text))
    again = (ids[order][1:] == ids[order][:-1]) & (text[order][1:] == text[order][:-1])
    before = np.full(len(ids), -1)
    before[order[1:][again]] = order[:-1][again]
    at = np.flatnonzero(np.arange(len(ids)) + k[text] <= (first + n)[text])
    size, different = k[text[at]], np.zeros(len(at), np.int64)
    for j in range(int(k.max(initial=0))):
        within = j < size
        different += within & (before[np.where(within, at + j, at)] < at)
    at = at[different >= least[text[at]]]
    hashes = [md5(data[a:b]).digest() for a, b in zip(starts[at].tolist(), ends[at + k[text[at]] - 1].tolist(), strict=True)]
    high, low = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2).T
    of = text[at]
    m = np.bincount(of, minlength=len(full))
    begin = np.cumsum(m) - m
    best = np.flatnonzero(np.arange(len(at)) + w[of] <= (begin + m)[of])
    window, width = best.copy(), w[of[best]]
    for j in range(1, int(w.max(initial=0))):
        other = np.where(j < width, window + j, best)
        best = np.where((high[other] < high[best]) | ((high[other] == high[best]) & (low[other] <= low[best])), other, best)
    best = best[np.r_[True, best[1:] != best[:-1]]] if len(best) else best  # windows' minima only go on
    few = [begin[i] + min(range(m[i]), key=lambda j, b=begin[i]: hashes[b + j]) for i in np.flatnonzero((m > 0) & (m < w)).tolist()]
    best = np.sort(np.r_[best, np.array(few, np.int64)])
    return full[of[best]], (at - first[of])[best], [hashes[i] for i in best.tolist()]


def _some_texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of about BATCH_BYTES / 2 of its second column, text by text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BATCH_BYTES // 2, side="right")))
        yield batch.slice(low, high - low)
        low = high


def packed(docs: DataFrame, key: str = "doc_id", places: bool = False, unit_lines: int = 0) -> DataFrame:
    """Winnowed fingerprints of docs (key, text), of texts that need no segments: (key, hash), the different ones of each row, the hash as 16 bytes.

    With places: (key, hash, pos, start, end). With unit_lines: (key, hash, unit, m, whole), how many times a hash stands in a unit of so many lines (null: in none),
    with its times in all in one row of each hash; each row of docs is told by itself. Tokens are found by Spark; a task hashes and winnows some texts at a time.
    """
    fields = [("hash", "binary"), *[(c, "int") for c in (("unit", "m", "whole") if unit_lines else ("pos", "start", "end") if places else ())]]
    places = places or unit_lines > 0
    made = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(c, T._parse_datatype_string(x)) for c, x in fields]])
    if places:
        of_line = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))
        rows = spread(docs).select(key, of_line.alias("words")).select(key, F.array_join(F.flatten("words"), " ").alias("text"), F.transform("words", lambda x: F.size(x)).alias("sizes"))
    else:
        rows = spread(docs).select(key, F.array_join(words(), " ").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(made)
        for batch in batches:
            for some in _some_texts(batch):
                row, pos, hashes = _told(some.column(1))
                columns = []
                if places:
                    lists = some.column(2)
                    per_line = lists.flatten().to_numpy(zero_copy_only=False)
                    n_lines = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    number = np.arange(len(per_line)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines) + 1
                    lines = np.repeat(number, per_line)
                    n = np.bincount(np.repeat(np.arange(len(n_lines)), n_lines), weights=per_line, minlength=len(n_lines)).astype(np.int64)
                    first = (np.cumsum(n) - n)[row] + pos
                    k = np.array([_step(x, P.K_STEPS, P.K_LAST) for x in n.tolist()], np.int64)[row]
                    columns = [pos, lines[first], lines[first + k - 1]]
                    if unit_lines:
                        start = (columns[1] - 1) // unit_lines * unit_lines + 1
                        unit = np.where(columns[2] < start + unit_lines, start, 0)
                        times = Counter(zip(row.tolist(), hashes, unit.tolist(), strict=True))
                        whole = Counter(zip(row.tolist(), hashes, strict=True))
                        row, hashes = np.array([r for r, _, _ in times], np.int64), [h for _, h, _ in times]
                        columns = [[u or None for _, _, u in times], list(times.values()), [whole.pop((r, h), None) for r, h, _ in times]]
                else:
                    once = dict.fromkeys(zip(row.tolist(), hashes, strict=True))
                    row, hashes = np.array([r for r, _ in once], np.int64), [h for _, h in once]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row, pa.int64())), pa.array(hashes, pa.binary()), *[pa.array(c, pa.int32()) for c in columns]], schema=schema)

    return rows.mapInArrow(run, made)


def unit_counts(docs: DataFrame, unit_lines: int, key: str = "doc_id", longest: int = LONG_BYTES) -> DataFrame:
    """packed() with unit_lines of texts of any length; counts of a key in several rows, and of texts in segments, are added up by a shuffle."""
    docs = docs.select(key, "text")
    short, long = by_length(docs, longest)
    if long is None and docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return packed(short, key, unit_lines=unit_lines)
    start = (F.floor((F.col("start") - 1) / unit_lines) * unit_lines + 1).cast("int")
    rows = fingerprints(docs, key, longest).select(key, F.unhex("hash").alias("hash"), F.when(F.col("end") < start + unit_lines, start).alias("unit"))
    counts = rows.groupBy(key, "hash", "unit").agg(F.count("*").cast("int").alias("m"))
    of = Window.partitionBy(key, "hash")  # the units of one hash in one text
    first = F.row_number().over(of.orderBy("unit")) == 1
    return counts.withColumn("whole", F.when(first, F.sum("m").over(of).cast("int")))


def fingerprint_set(docs: DataFrame, key: str = "doc_id", longest: int = LONG_BYTES) -> DataFrame:
    """Distinct (key, hash) of the winnowed fingerprints. Texts of more than longest bytes go in segments."""
    short, long = by_length(docs.select(key, "text"), longest)
    out = packed(short, key).withColumn("hash", F.lower(F.hex("hash")))
    return out if long is None else out.unionByName(segmented(long, key).select(key, "hash").distinct())


def all_hashes(docs: DataFrame, longest: int = LONG_BYTES) -> DataFrame:
    """Distinct hashes of every k-gram: what boilerplate takes away."""
    short, long = by_length(docs.select("text"), longest)
    out = with_grams(tokenised(spread(short))).select(F.explode_outer("grams").alias("g")).select(F.col("g.h").alias("hash")).where("hash is not null")
    if long is not None:
        out = out.unionByName(segmented(long.withColumn("_key", F.lit(0)), "_key", every=True).select("hash"))
    return out.distinct()


def by_length(docs: DataFrame, longest: int) -> tuple[DataFrame, DataFrame | None]:
    """docs without texts of more than longest bytes, and those that have one; None where there are none (found by one look at the lengths)."""
    long = F.octet_length("text") > longest
    found = docs.where(long)
    if found.isEmpty():
        return docs, None
    return docs.where(~F.coalesce(long, F.lit(False))), found


def parts_of(rows: DataFrame, size: int) -> int:
    """A part for each so many bytes that the planner expects of rows, and for each core at least."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    expected = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected > UNKNOWN_BYTES:  # what the planner says of rows from Python
        return max(cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, -(-expected // size))


def spread(docs: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """docs over parts of SPLIT_BYTES (of sized, if given): tokens cost more than the move of a text."""
    return docs.repartition(parts_of(docs if sized is None else sized, SPLIT_BYTES))


def fingerprints(docs: DataFrame, key: str = "doc_id", longest: int = LONG_BYTES) -> DataFrame:
    """Winnowed fingerprints with places: key, hash, pos, start, end (lines). Texts of more than longest bytes go in segments."""
    short, long = by_length(docs.select(key, "text"), longest)
    out = packed(short, key, places=True).withColumn("hash", F.lower(F.hex("hash")))
    return out if long is None else out.unionByName(segmented(long, key))


# --- texts of any length

_WORD = regex.compile(WORD)


def _step(n: int, steps, last: int) -> int:
    return next((value for below, value in steps if n < below), last)


def _kept(tokens: list[str], k: int, least: int) -> list[int]:
    """Where the k-grams with enough different tokens begin."""
    return [i for i in range(len(tokens) - k + 1) if len(set(tokens[i : i + k])) >= least]


def _stretches(text: str, chars: int) -> Iterator[tuple[str, int, int, int, int, int]]:
    """A text in lower case in stretches of about chars: the text of each, n_tokens (of the whole text), the index and line of its first token, and from and to which k-gram it is.

    A stretch holds its neighbours' nearest w - 1 kept k-grams besides, so each of its own stands in all its windows. Where these do not lie
    within REACH tokens (long runs of few words) no cut is made. k, w and the least number of different tokens are those of the whole text.
    """
    n = sum(1 for _ in _WORD.finditer(text))
    k, w, least = _step(n, P.K_STEPS, P.K_LAST), _step(n, P.WINDOW_STEPS, P.WINDOW_LAST), 2 if n < P.SHORT_TOKENS else 3
    recent: deque[tuple[int, int]] = deque(maxlen=REACH)  # where the last tokens stand
    start = low = first = 0  # of the stretch: its text, own k-grams and first token
    line, goal = 1, chars
    for i, found in enumerate(_WORD.finditer(text)):
        at = found.start()
        if at >= goal and i > low:
            goal = at + chars
            ahead = [m.span() for m in islice(_WORD.finditer(text, at), REACH)]
            after = _kept([text[a:b] for a, b in ahead], k, least)
            behind = [*recent, *ahead[: k - 1]]
            before = [j for j in _kept([text[a:b] for a, b in behind], k, least) if j < len(recent)]
            if min(len(after), len(before)) >= w - 1:
                yield text[start : ahead[after[w - 2] + k - 1][1]], n, first, line, low, i
                begin = behind[before[1 - w]][0]
                line += text.count("\n", start, begin) if begin >= start else -text.count("\n", begin, start)
                start, low, first = begin, i, i - len(recent) + before[1 - w]
        recent.append(found.span())
    yield text[start:], n, first, line, low, n


def _winnowed(hashes: list[str], w: int) -> list[int]:
    """Where the minima of all windows stand, each window's rightmost one; of too few hashes, the leftmost."""
    if len(hashes) < w:
        return [hashes.index(min(hashes))] if hashes else []
    out, least = [], -1
    for end in range(w - 1, len(hashes)):
        start = end - w + 1
        if least < start:
            least = start
            for i in range(start + 1, end + 1):
                if hashes[i] <= hashes[least]:
                    least = i
        elif hashes[end] <= hashes[least]:
            least = end
        if not out or out[-1] != least:
            out.append(least)
    return out


def _prints(text: str, n: int, first: int, line: int, low: int, high: int, every: bool) -> Iterator[tuple[str, int, int, int]]:
    """hash, pos, start, end of a stretch's own winnowed k-grams, or of all its own."""
    k, w = _step(n, P.K_STEPS, P.K_LAST), _step(n, P.WINDOW_STEPS, P.WINDOW_LAST)
    tokens, lines = [], []
    for number, x in enumerate(text.split("\n"), line):
        of = _WORD.findall(x)
        tokens += of
        lines += [number] * len(of)
    kept = _kept(tokens, k, 2 if n < P.SHORT_TOKENS else 3)
    hashes = [md5(" ".join(tokens[i : i + k]).encode()).hexdigest() for i in kept]
    for j in range(len(kept)) if every else _winnowed(hashes, w):
        i = kept[j]
        if low <= first + i < high:
            yield hashes[j], first + i, lines[i], lines[i + k - 1]


def segmented(docs: DataFrame, key: str = "doc_id", chars: int = SEGMENT_CHARS, every: bool = False) -> DataFrame:
    """fingerprints() of texts of any length, or every k-gram, in stretches of about so many characters; no row holds a whole text's tokens.

    A text is cut where it is read, and what a stretch needs of its neighbours goes with it: stretches are dealt over the tasks once, and nothing
    else is moved or met. A k-gram belongs to one stretch, so a minimum comes once. Repeated rows of docs give repeated rows.
    """
    own = docs.schema[key].dataType
    cut = T.StructType([T.StructField("key", own), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n", "first", "line", "low", "high"))])
    made = T.StructType([T.StructField(key, own), T.StructField("hash", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("pos", "start", "end"))])

    def by_batch(batch: pa.RecordBatch, of: Callable[[int], Iterator[tuple]], types: T.StructType) -> Iterator[pa.RecordBatch]:
        """What each row gives, behind its key, some rows at a time."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(types)
        at, rows, size = [], [], 0
        for i in range(batch.num_rows):
            for row in of(i):
                at.append(i)
                rows.append(row)
                size += 64 + len(row[0])
                if size > BATCH_BYTES:
                    yield told(batch, at, rows, schema)
                    at, rows, size = [], [], 0
        if rows:
            yield told(batch, at, rows, schema)

    def told(batch: pa.RecordBatch, at: list[int], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], schema=schema)

    def into_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from by_batch(batch, lambda i, of=batch.column(1): _stretches(of[i].as_py(), chars), cut)  # noqa: B023

    def into_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from by_batch(batch, lambda i, of=batch.columns[1:]: _prints(*(c[i].as_py() for c in of), every), made)  # noqa: B023

    texts = docs.select(F.col(key).alias("key"), F.lower("text").alias("text")).where("text is not null")
    return spread(texts.mapInArrow(into_stretches, cut), docs).mapInArrow(into_prints, made)
