"""Distance and matching against the plain recurrence."""

import random

from sievemark.llm import decontaminate as D
from sievemark.llm.decontaminate import ERROR_RATE, Matcher, distance_in, masks, normalised


def plain(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_distance():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 30)))
        assert distance_in(masks(p), len(p), t) == plain(p, t)


def test_matches_are_those_within_the_budget():
    rng = random.Random(2)
    items = [(i, "".join(rng.choices("abcd ", k=60)).strip()) for i in range(5)]
    for _ in range(60):
        _, item = rng.choice(items)
        edited = list(item)
        for _ in range(rng.randint(0, 8)):
            edited[rng.randrange(len(edited))] = rng.choice("abcdx")
        text = normalised("".join(rng.choices("abcd", k=40)) + "".join(edited) + "".join(rng.choices("abcd", k=40)))
        want = {(i, plain(t, text)[0]) for i, t in items if plain(t, text)[0] <= int(ERROR_RATE * len(t))}
        assert {(i, d) for i, d, _ in Matcher(items, ERROR_RATE).find(text)} == want


def test_edge_texts(spark):
    from sievemark.llm.decontaminate import clean, matches

    item = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " + item + " y", 0), (None, item, 0), (3, item, 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in matches(docs, bench).collect()) == [(0, 7, 0), (3, 7, 0), (3, 7, 0)]
    # rows with a null doc_id are judged like others
    assert sorted(r["doc_id"] or 0 for r in clean(docs, bench).collect()) == [1, 2]
    assert matches(docs.limit(0), bench).count() == 0


def least_edits(item, text):
    """The least edit distance of an item to any part of a text, by the plain recurrence, a row at a time."""
    import numpy as np

    codes = np.array([ord(c) for c in text], np.int64)
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for c in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def test_the_query_against_the_plain_recurrence(spark):
    """Every document against every item of the smallest tables, and some changed on purpose."""
    import os

    from sievemark.llm import queries

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    texts = {r["doc_id"]: D.normalised(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: D.normalised(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {}
    for doc, text in texts.items():
        for name, item in items.items():
            n = least_edits(item, text)
            if n <= int(D.ERROR_RATE * len(item)):
                want[doc, name] = n
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.QUERIES["op4_decontaminate"](spark, sf).collect()}
    assert got == want and len(want) > 0
