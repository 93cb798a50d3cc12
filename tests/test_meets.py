"""Pairs counted in cells: the same pairs whatever the cells and chunks, and no meeting is moved."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievemark.operators import blocks as B
from sievemark.operators import meets as M
from sievemark.operators import similarity as S
from sievemark.plans import engine


@pytest.fixture(scope="module")
def places(spark):
    rows = [(i, f"h{(i * j) % 37}", (j % 4) * 5 + 1, 1 + j % 2) for i in range(60) for j in range(9)] + [(i, "common", 1, 1) for i in range(60)]
    return spark.createDataFrame(sorted({r[:3]: r for r in rows}.values()), "doc_id long, hash string, unit int, m int")


def _expected(rows):
    at = defaultdict(list)
    for r in rows:
        at[r["hash"]].append(r)
    out = defaultdict(Counter)
    for of in at.values():
        for a in of:
            for b in of:
                if a["doc_id"] < b["doc_id"]:
                    out[a["doc_id"], b["doc_id"], a["unit"], b["unit"]].update(n=1, raw=a["m"] * b["m"])
    return {k: (v["n"], v["raw"]) for k, v in out.items()}


@pytest.mark.parametrize("cell,chunk", [(None, None), (40, 50), (7, 1)])
def test_unit_pairs_whatever_the_cells(places, cell, chunk):
    got = M.cells("doc_id", None, places, M.unit_pairs, M.UNIT_PAIRS, cell=cell, chunk=chunk).collect()
    assert len(got) == len({tuple(r[:4]) for r in got})
    assert {(r["doc_id_a"], r["doc_id_b"], r["from_a"], r["from_b"]): (r["hash_count"], r["raw_match_count"]) for r in got} == _expected(places.collect())


@pytest.mark.parametrize("cell,chunk", [(None, None), (40, 50)])
def test_choice_is_that_of_blocks(places, cell, chunk):
    every = M.cells("doc_id", None, places, M.unit_pairs, M.UNIT_PAIRS)
    want = B.one_to_one(B.strong(B.prose_blocks(every))).select("doc_id_a", "doc_id_b", "from_a", "from_b")
    got = M.cells("doc_id", None, places, M.chosen_pairs, M.CHOSEN, cell=cell, chunk=chunk)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    first = got.groupBy("doc_id_a", "doc_id_b").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n"))
    assert first.where("low <> 1 or high <> n").count() == 0


def test_text_keys_and_references(spark):
    rows = [("é", "x", False), ("z", "x", True), ("_ref_b", "x", True), ("z", "y", True), ("_ref_b", "y", True)]
    got = S.candidate_pairs(spark.createDataFrame(rows, "doc_id string, hash string, is_ref boolean"), is_ref="is_ref").collect()
    assert sorted(map(tuple, got)) == [("_ref_b", "é", 1), ("z", "é", 1)]


def test_no_row_is_a_meeting(places):
    """The plan joins no two sides by hash and moves no pairs: rows go to cells, and pairs leave them."""
    plan = S.weighted_jaccard(places.select("doc_id", "hash").distinct())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_matches_of_no_two_references(spark):
    unit = {"file": "text", "start": 1, "end": 1, "unit_type": "METHOD", "unit_start": 1, "unit_end": 5}
    prints = spark.createDataFrame([(1, "h", True), (2, "h", True), (3, "h", False)], "doc_id long, hash string, ref boolean")
    for c in B.UNIT:
        prints = prints.withColumn(c, F.lit(unit.get(c)))
    found = B.matches(prints, is_ref="ref")
    assert sorted((r["doc_id_a"], r["doc_id_b"]) for r in found.collect()) == [(1, 3), (2, 3)]


def test_a_list_goes_to_the_blocks_that_have_it(spark):
    """A list of two owners goes to one block of each, a common one to all: not every list to every block."""
    rows = [(i, f"h{i // 2}") for i in range(400)] + [(i, "common") for i in range(400)]
    posted = M._posted(spark.createDataFrame(rows, "doc_id long, hash string"), "doc_id", ())
    owners = M._by_owner(posted, "doc_id", "sets", M.SETS, 16).collect()
    assert len(owners) == 400
    for o in owners:
        assert sorted(len(e["others"]) for e in o["sets"]) == [1, 16]
        assert o["n"] == 2 and o["w"] == sum(e["w"] for e in o["sets"])


def test_totals_beyond_64_bits_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "LONE", 8 * 10**18)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "doc_id long, hash string")
    with pytest.raises(Exception, match="more hashes than weights"):
        S.weighted_jaccard(rows).collect()


@pytest.mark.parametrize("marks", ["doc_id % 5 = 0", "doc_id <> 99"])
def test_prose_run_is_that_of_all_meetings(spark, marks):
    """The report of cells equals that of meetings as rows; document 99 has no prints, so with "doc_id <> 99" all others are references."""
    rows = [(i, f"h{(i * j) % 29}", (j * 7) % 23 + 1 + i % 3, (j * 7) % 23 + 1 + i % 3 + j % 2) for i in range(30) for j in range(14)]
    rows += [(i, f"copy{j}", j + i % 2, j + i % 2) for i in (40, 41, 42, 45) for j in range(1, 40)]
    prints = B.prose_units(spark.createDataFrame(rows, "doc_id long, hash string, start int, end int"))
    everyone = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    taken = spark.createDataFrame([("t",)], "hash string")
    got = engine.compare_prose(prints, everyone, taken, is_ref=F.expr(marks), key="doc_id")
    want = engine.compare(prints, everyone, taken, is_ref=F.expr(marks), key="doc_id")
    shown = ["doc_id_a", "doc_id_b", "block_id", "type", "from_a", "to_a", "from_b", "to_b", "length_a", "length_b", "file_a", "file_b", "name_a", "name_b", "density", "confidence"]
    assert sorted(got.blocks.select(shown).collect(), key=repr) == sorted(want.blocks.select(shown).collect(), key=repr)
    for part in ("scores", "pairs", "highlights", "metadata"):
        of = getattr(want, part)
        assert sorted(getattr(got, part).select(of.columns).collect(), key=repr) == sorted(of.collect(), key=repr), part
    assert "Join" not in got.pairs._jdf.queryExecution().executedPlan().toString()
