"""The pipeline's stages against brute force, on the small tables and with null and repeated identifiers."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_contracts import shingles  # noqa: E402

from sievemark.llm import decontaminate as D  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def one_row_of_each(docs):
    """Brute force: components of rows by similarity of shingle sets, one row of each; rows without words all stay."""
    sets = [shingles(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            same = docs[i]["doc_id"] is not None and docs[i]["doc_id"] == docs[j]["doc_id"]
            if x and sets[j] and (same or 100 * len(x & sets[j]) >= 80 * len(x | sets[j])):
                root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(sets):
        groups.setdefault(find(i) if x else ("none", i), []).append(i)
    return groups


def test_near_copies_small(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    want = sorted(min(rows[i]["doc_id"] for i in g) for g in one_row_of_each(rows).values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()) == want


def test_near_copies_odd_rows(spark):
    one, two = "a b c d e f g h", "p q r s t u v w x y z"
    rows = [(1, one), (1, one), (2, one), (None, one), (None, two), (None, two), (3, "q w e"), (3, "u i o"), (None, None), (None, ""), (4, ""), (5, " ")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()), key=repr)
    assert (1, one) in got and got.count((1, one)) == 1 and (2, one) not in got and (None, one) not in got
    assert got.count((None, two)) == 1 and len([g for g in got if g[0] == 3]) == 1
    assert [g for g in got if not (g[1] or "").strip()] == sorted([(None, None), (None, ""), (4, ""), (5, " ")], key=repr)


def test_decontamination_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, f"before {item} behind"), (1, "clean"), (None, item.upper()), (None, "clean too"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.without_benchmark(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(1, "clean"), (None, "clean too"), (2, None), (3, "")], key=repr)


def test_decontamination_small(spark):
    """Every document against every item by the plain recurrence where a piece is shared, else by none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [D.normalised(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for r in docs.collect():
        text = D.normalised(r["text"])
        held = False
        for item in items:
            budget = int(D.ERROR_RATE * len(item))
            if any(p in text for _, p in D.pieces(item, budget)) and D.distance_in(D.masks(item), len(item), text)[0] <= budget:
                held = True
        if not held:
            want.append(r["doc_id"])
    got = corpus_pipeline.without_benchmark(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_quality_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    clean = next(r for r in docs.collect() if r["doc_id"] in good and r["lang"] == "en" and 800 < len(r["text"]) < 4000)
    junk = "zq9 xx7 " * 200 + "".join(chr(0x4E00 + i * 7 % 900) for i in range(600))
    more = spark.createDataFrame([(10**9, clean["text"], "en", "s", 0), (10**9, junk, "en", "s", 0), (None, clean["text"], None, "s", 0), (None, junk, None, "s", 0), (None, None, None, "s", 0)], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_quality(spark, docs.unionByName(more), SF).collect()]
    assert (10**9, clean["text"]) in got and (None, clean["text"]) in got and (None, None) in got
    assert (10**9, junk) not in got and (None, junk) not in got


def test_chain(spark, tmp_path):
    """run() is the stages one after the other; empty tables give no row."""
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    same = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.select(same).collect())) == sorted(map(tuple, docs.select(same).collect()))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_of_any_name_go_through(spark, tmp_path):
    """Columns that are called as inner ones are keep their values through all stages."""
    names = ["found", "new", "kinds", "n_replaced", "_private", "_PRIVATE_", "p", "m", "i", "n", "row", "tag", "bits", "keep", "said", "text_hash", "part", "hash", "token", "gone", "_gone_id", "all", "secrets", "item", "block", "component_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    wide = docs.select("*", *[(docs["doc_id"] * (i + 3)).alias(f"`{n}`".strip("`")) for i, n in enumerate(names)])
    private = spark.createDataFrame([(10**6, "write to me: ann.b@example.org, 10.1.2.3", "en", "s", 1, *[7] * len(names))], wide.schema)
    before = {r["doc_id"]: tuple(r[n] for n in names) for r in wide.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, SF)
        rows = wide.collect()
        assert rows and wide.columns == [*docs.columns, *names], name
        assert all(tuple(r[n] for n in names) == before[r["doc_id"]] for r in rows), name
    last = corpus_pipeline.without_personal_data(spark, private, SF).first()
    assert tuple(last[n] for n in names) == (7,) * len(names)
    assert "ann.b@example.org" not in last["text"] and "10.1.2.3" not in last["text"] and last["n_chars"] == len(last["text"])
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == len(rows)


def test_the_session_names_the_key(spark):
    docs = spark.createDataFrame([(1, "card 4111 1111 1111 1111", "en", "s", 0)], SCHEMA)
    plain = corpus_pipeline.without_personal_data(spark, docs, SF).first()["text"]
    spark.conf.set("spark.sievemark.pii.key", "another")
    try:
        other = corpus_pipeline.without_personal_data(spark, docs, SF).first()["text"]
    finally:
        spark.conf.unset("spark.sievemark.pii.key")
    assert plain != other and len({plain, other, docs.first()["text"]}) == 3
