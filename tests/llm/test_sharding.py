"""Links that stay on one shard, by the size of their group."""

from collections import Counter, defaultdict

import pytest

from sievemark.llm.sharding import claims, shard_documents


def uncut(rows):
    """Per group size: pairs of equal texts on one shard and all pairs, from (text, shard) rows."""
    groups = defaultdict(Counter)
    for text, shard in rows:
        groups[text][shard] += 1
    out = defaultdict(lambda: [0, 0])
    for held in groups.values():
        n = sum(held.values())
        out[n][0] += sum(c * (c - 1) // 2 for c in held.values())
        out[n][1] += n * (n - 1) // 2
    return out


def test_claims_hold_all_rows_whole_where_they_fit():
    free = [10] * 5
    pieces = claims([("a", 25), ("b", 9), ("c", 6), ("d", 4)], free)
    assert sum(high - low for *_, low, high in pieces) == 44 and sum(free) == 6 and min(free) >= 0
    held = defaultdict(list)
    for link, shard, low, high in pieces:
        held[link].append((low, high, shard))
    assert {k: len(v) for k, v in held.items()} == {"a": 3, "b": 1, "c": 1, "d": 1}
    assert [p[:2] for p in sorted(held["a"])] == [(0, 10), (10, 20), (20, 25)]


@pytest.mark.parametrize("alone", [0, 4000])
def test_uncut_edges_by_group_size(spark, alone):
    sizes = [2] * 800 + [7] * 200 + [40] * 30 + [150] * 10 + [450] * 4 + [2500]
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"alone {i}" for i in range(alone)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = shard_documents(docs, shards=12).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    load = Counter(r["shard"] for r in got)
    assert len(load) == 12 and max(load.values()) - min(load.values()) <= 1
    found = uncut((texts[r["doc_id"]], r["shard"]) for r in got)
    for n in (2, 7, 40, 150, 450):
        assert found[n][0] >= 0.9 * found[n][1], (n, found[n])
    share = len(texts) // 12  # the one group that no shard holds: as many whole shards as it fills
    whole, rest = divmod(2500, share)
    assert found[2500][0] >= 0.98 * (whole * share * (share - 1) + rest * (rest - 1)) // 2
