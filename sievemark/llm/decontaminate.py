"""Benchmark passages in documents, found by pigeonhole pieces and Myers' bit-parallel edit distance.

An item of n normalised characters has a budget of k = floor(ERROR_RATE * n) edits and is split into
k + 1 pieces. Where a document holds the item with k edits at most, one piece at least is whole. All pieces
are sought in one pass over each document; around each hit, a window as long as the item and twice its budget is
verified. Items of fewer than MIN_CHARS characters have no budget and count on word borders only. Items go to the tasks in blocks of bounded size, each block meets all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import arrow_schema, batch_of, bounded_chunks, clear_worker, documents, materialise, texts_of, without

#: Edits for each character of an item, and characters below which an item is too short for edits.
ERROR_RATE, MIN_CHARS = 0.08, 25
#: Bytes of items that are sent to the tasks at once.
BLOCK_BYTES = 4_000_000

_SPACE = re.compile(r"\s+")
#: Two characters of one word: none is of a script that is written without spaces (Thai to Khmer, Chinese, Japanese).
_INSIDE = re.compile(r"(?:(?![\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])\w){2}")


def normalised(text: str | None) -> str:
    """Lower case, white space as one space, trimmed."""
    return _SPACE.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of nearly equal lengths, with where they start."""
    ends = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def on_borders(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends no word in its midst."""
    return not any(0 < at < len(text) and _INSIDE.match(text, at - 1) for at in (start, end))


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance_in(found: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edit distance of an item to any part of text, and the first end of such a part."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, end = full, 0, size, size, 0
    for at, c in enumerate(text, 1):
        eq = found.get(c, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(h | plus)), plus & h
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, at
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(v | up)), up & v
    return best, end


class Matcher:
    """All items of a block: id, text and budget, with one automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = MIN_CHARS):
        self.min_chars = min_chars
        self.items = [(i, t, int(rate * len(t)) if len(t) >= min_chars else 0, masks(t)) for i, t in items]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget, _) in enumerate(self.items):
            for start, piece in pieces(text, budget):
                by_piece.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """item id, least distance and end (in the normalised text) for every item within its budget."""
        windows: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, int] = {}  # where the first one ends
        if not self.items:
            return []
        for end, (length, where) in self.automaton.iter(text):
            for n, start in where:
                _, item, budget, _ = self.items[n]
                if len(item) < self.min_chars:
                    if n not in short and on_borders(text, end + 1 - length, end + 1):
                        short[n] = end + 1
                    continue
                low = end + 1 - length - start - budget
                held = windows.setdefault(n, [])
                # hits come in order of their ends: what touches the window before lengthens it
                if held and held[-1][0] <= low <= held[-1][1]:
                    held[-1] = held[-1][0], max(held[-1][1], low + len(item) + 2 * budget)
                else:
                    held.append((low, low + len(item) + 2 * budget))
        out = [(self.items[n][0], 0, end) for n, end in short.items()]
        for n, held in windows.items():
            name, item, budget, found = self.items[n]
            best = (budget + 1, 0)
            for low, high in held:
                low = max(0, low)
                at = text.find(item, low, high)
                distance, end = (0, at + len(item) - low) if at >= 0 else distance_in(found, len(item), text[low:high])
                best = min(best, (distance, low + end))
            if best[0] <= budget:
                out.append((name, *best))
        return out


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, edits, end_char (in the normalised text).

    Items shorter than min_chars match without edits, on word borders; null and empty items match nothing, null and empty texts hold nothing.
    Repeated items and documents give rows each; a null doc_id or item_id stays null. Of equally good places the first is told.
    """
    return _found(documents(docs, "doc_id", "text").withColumn("text_hash", F.lit(None).cast("long")), benchmark, rate, min_chars).drop("text_hash")


def _found(docs: DataFrame, benchmark: DataFrame, rate: float, min_chars: int) -> DataFrame:
    """matches of docs (doc_id, text, text_hash), with the text_hash."""
    spark = docs.sparkSession
    fields = spark.createDataFrame([], "doc_id long, text_hash long, item_id long, edits int, end_char long").schema
    out_schema = arrow_schema(fields)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where("item is not null")
    total = items.agg(F.sum(F.octet_length("item").cast("long"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    rows = docs.where("text is not null")

    def against(block: int) -> DataFrame:
        # a block of bounded size (or one item, if that is longer)
        own = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block).toLocalIterator()
        texts = [(r["item_id"], t) for r in own if (t := normalised(r["item"]))]
        shared = spark.sparkContext.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clear_worker()
            matcher = Matcher(shared.value, rate, min_chars)
            for batch in batches:
                for part in bounded_chunks(batch, "text"):
                    out: list[list] = [[], [], [], [], []]
                    for doc, hashed, text in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), texts_of(part.column("text")), strict=True):
                        for name, edits, end in matcher.find(normalised(text)):
                            for c, v in zip(out, (doc, hashed, name, edits, end), strict=True):
                                c.append(v)
                    yield batch_of(out_schema, out)

        return rows.mapInArrow(run, fields)

    return reduce(DataFrame.unionByName, map(against, range(blocks)))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs that hold no item, told by doc_id (null too) and text, so that repeated ids don't take each other away."""
    keyed = documents(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    held = _found(keyed, benchmark, rate, min_chars).select("doc_id", "text_hash").distinct()
    return without(docs, materialise(held, "held"))
