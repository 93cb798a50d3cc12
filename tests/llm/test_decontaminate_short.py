"""Items too short for edits are found whole, on word borders."""


def test_short_items(spark):
    from sievemark.llm.decontaminate import clean, matches

    texts = ["the cat  Sat down", "concat sat", "cat sats", "cat sat", "cat, sat", "(cat sat) cat sat", "これは漢字です"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Cat sat"), (8, "漢字"), (9, " ")], "item_id long, text string")
    got = sorted(tuple(r) for r in matches(docs, bench).select("doc_id", "item_id", "edits", "end_char").collect())
    assert got == [(0, 7, 0, 11), (3, 7, 0, 7), (5, 7, 0, 8), (6, 8, 0, 5)]
    assert sorted(r["doc_id"] for r in clean(docs, bench).collect()) == [1, 2, 4]
