"""Fingerprints hashed and winnowed some texts at a time are those of Spark's expressions, row by row."""

import pyarrow as pa
from pyspark.sql import functions as F

from sievemark.operators import fingerprints as FP

TEXTS = [None, "", " \n ", "one", "a a a a a a", "one two three", "one two three four", "x y\nx y\nx y\nx y", "Ünï ÇÖDE 语言 İstanbul ΣΑΣ\nδοκ 12½ 三", "the same words again " * 3, *["\n".join(f"w{i * j % 13} v{j % 5},u{j}" for j in range(n)) for i in (1, 2) for n in (9, 10, 20, 27, 66, 67, 167)], "b c " * 40, "\n\nlast line only\n\n"]


def _docs(spark):
    return spark.sparkContext.parallelize(list(enumerate(TEXTS)), 2).toDF("doc_id long, text string")


def test_places_are_those_of_the_expressions(spark):
    rows = FP.with_winnowed_grams(FP.with_grams(FP.tokenised(_docs(spark), with_lines=True)))
    want = rows.select("doc_id", "lines", "k", "minima").collect()
    want = sorted((r.doc_id, g.h, g.i, r.lines[g.i], r.lines[g.i + r.k - 1]) for r in want for g in r.minima)
    assert sorted(map(tuple, FP.fingerprints(_docs(spark)).collect())) == want


def test_some_texts_at_a_time(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["a b c d"] * 4 + [None, "", "x" * 99, "y", "z"])], ["doc_id", "text"])
    monkeypatch.setattr(FP, "BATCH_BYTES", 20)
    some = [b.column(0).to_pylist() for b in FP._some_texts(batch)]
    assert [x for s in some for x in s] == list(range(9)) and len(some) > 4
    assert FP._told(batch.slice(4, 2).column(1))[2] == []


def test_sets_are_those_of_the_expressions(spark):
    grams = FP.with_grams(FP.tokenised(_docs(spark))).select("doc_id", "w", F.transform("grams", lambda g: g["h"]).alias("hashes"))
    want = grams.select("doc_id", FP.winnowed_hashes(F.col("hashes"), F.col("w")).alias("hashes")).collect()
    assert sorted(map(tuple, FP.fingerprint_set(_docs(spark)).collect())) == sorted((r.doc_id, h) for r in want for h in r.hashes)


def test_no_expression_hashes_in_the_plan(spark):
    plan = FP.fingerprints(_docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan


def test_counts_of_units_whatever_the_way(spark):
    """Told where the text is read, or added up: an id in two rows, and texts in segments."""
    docs = _docs(spark)
    near = FP.unit_counts(docs, 5)
    assert "Exchange hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()
    tell = lambda rows: sorted(((r.doc_id, bytes(r.hash), r.unit or 0, r.m) for r in rows))
    whole = lambda rows: sorted((r.doc_id, bytes(r.hash), r.whole) for r in rows if r.whole)
    rows, far = near.collect(), FP.unit_counts(docs, 5, longest=300).collect()
    assert tell(far) == tell(rows) and whole(far) == whole(rows)
    assert sum(r.m for r in rows) == sum(r.whole or 0 for r in rows) == FP.fingerprints(docs).count()
    twice = FP.unit_counts(docs.unionAll(docs), 5).collect()
    assert tell(twice) == [(d, h, u, 2 * m) for d, h, u, m in tell(rows)] and whole(twice) == [(d, h, 2 * m) for d, h, m in whole(rows)]
