"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its clauses: its paragraphs, cut further after marks that end a
clause, so that a long paragraph does not count as one piece. SHAKE-128 of a clause gives a wide vector:
LANES uniform 16-bit lanes, which make equality, and SIGNS lanes of plus or minus one, which make
likeness. A fingerprint is the sum of the vectors, lane by lane, modulo 2**16: order does
not matter, and a clause is inserted or deleted by adding or subtracting its vector.

The sign lanes of a difference of fingerprints have a mean square near the size of
the multisets' difference; likeness is one minus that over the sum of both sizes, within 0 and 1.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import arrow_schema, batch_of, documents, n_shuffle

LANES, SIGNS = 256, 256
CLAUSE_END = re.compile(r"(?<=[.!?;:,|])[ \t]+|\n")


def clauses(text: str) -> list[str]:
    return [c for c in CLAUSE_END.split(text) if c]


def expand(clause: str) -> bytes:
    return hashlib.shake_128(clause.encode("utf-8", "surrogatepass")).digest(2 * LANES + SIGNS // 8)


def total(vectors: list[bytes]) -> np.ndarray:
    """The fingerprint of clauses' expansions: LANES + SIGNS lanes, modulo 2**16."""
    if not vectors:
        return np.zeros(LANES + SIGNS, "<u2")
    raw = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)
    lanes = np.ascontiguousarray(raw[:, : 2 * LANES]).view("<u2").sum(axis=0, dtype=np.uint16)
    signs = 2 * np.unpackbits(raw[:, 2 * LANES :], axis=1).sum(axis=0, dtype=np.int64) - len(vectors)
    return np.concatenate([lanes, signs.astype(np.uint16)])


def of_text(text: str, known: dict[str, bytes] | None = None) -> np.ndarray:
    known = {} if known is None else known
    out = []
    for c in clauses(text):
        if (v := known.get(c)) is None:
            v = known[c] = expand(c)
        out.append(v)
    return total(out)


def insert(fingerprint: np.ndarray, clause: str) -> np.ndarray:
    return fingerprint + total([expand(clause)])


def delete(fingerprint: np.ndarray, clause: str) -> np.ndarray:
    return fingerprint - total([expand(clause)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[LANES:].astype(np.int16).astype(np.float64) for v in (a, b))
    size = float(x @ x + y @ y)
    return 0.0 if size == 0 else min(1.0, max(0.0, 1.0 - float((x - y) @ (x - y)) / size))


def text_of(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u2").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u2")


LEAST = -(1 << 63)


def _with_successor(docs: DataFrame, parts: int) -> DataFrame:
    """Documents dealt into ranges of doc_id, each range followed by the first document of the next lower one.

    Columns key, doc_id, text, part, tail. The ranges come from approximate quantiles of
    the identifiers; of texts, only one for each range moves twice.
    """
    spark = docs.sparkSession
    base = documents(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    quantiles = base.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts + 1000)).first()[0] or []
    splits = np.unique(np.array(quantiles, np.int64))
    shared = spark.sparkContext.broadcast(splits)

    @F.pandas_udf("int")
    def part_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(shared.value, key.to_numpy(np.int64), side="left").astype(np.int32))

    dealt = base.withColumn("part", part_of("key"))
    tops = {r["part"]: r["top"] for r in base.select("key").withColumn("part", part_of("key")).groupBy("part").agg(F.max("key").alias("top")).collect()}  # a row for each range
    if not tops:
        return dealt.withColumn("tail", F.lit(0))
    order = sorted(tops)
    follows = [(tops[order[i - 1]], order[i]) for i in range(len(order))]  # of the lowest range, the top one's first
    wanted = spark.createDataFrame(follows, "key long, to int")
    # at most a row for each range: the first of the documents with its largest identifier
    tails = base.join(F.broadcast(wanted), "key").groupBy("to").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    tails = tails.select("key", "doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("tail"))
    return dealt.withColumn("tail", F.lit(0)).unionByName(tails)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next lower doc_id (after the lowest: the highest; nulls count as lowest;
    equal identifiers follow each other in the order of their texts). In the edited text the last floor(n_chars / 2) code
    points give way to the first as many of the next document. A null text is empty: the
    fingerprint of nothing is zero, and two such are alike (1.0). A lone document is its own next.
    Repeated rows give repeated rows; no row gives no row. One shuffle of the texts.
    """
    spark = docs.sparkSession
    n = n_shuffle(spark)
    fields = spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text, clauses' vectors, fingerprint
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "tail")), strict=True)
            cols: list[list] = [[] for _ in out_schema]
            for part, doc_id, text, tail in rows:
                known: dict[str, bytes] = {}
                own = of_text(text, known)
                if held is not None and held[0] == part:
                    _, before_id, before, vectors, fp = held
                    k = len(before) // 2
                    edited = before[: len(before) - k] + text[:k]
                    changed = of_text(edited, vectors | known) if k else fp
                    values = (before_id, len(before), hashlib.sha256(edited.encode()).hexdigest(), text_of(fp), text_of(changed), likeness(fp, changed), likeness(fp, own))
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                held = None if tail else (part, doc_id, text, known, own)
            yield batch_of(out_schema, cols)

    dealt = _with_successor(docs, 4 * n).repartition(n, "part").sortWithinPartitions("part", "tail", F.desc("key"), "text")
    return dealt.mapInArrow(run, fields)
