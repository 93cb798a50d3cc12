"""The operators' queries against brute force on the smallest tables, and on rows at the edges."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievemark.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EDGE_TEXTS = [None, "", " \n\t ", "one two", "One  TWO", "a b c d e f g h", "a b c d e f g h", "ünï çödé 漢字 \U0001f600 x\x00y", "w " * 3000, "a b c d e f g h i"]


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    """Tables with null and repeated rows, odd texts and columns whose names clash with inner ones."""
    root = tmp_path_factory.mktemp("edge")
    clash = "part string, block string, link string, shard string, n string, tokens string, component string, key string"
    more = ("?",) * 8
    docs = [(i, t, "en", "s", 0, *more) for i, t in enumerate(EDGE_TEXTS)] + [(3, "one two", "en", "s", 0, *more), (None, "a b c d e f g h", None, None, None, *more)]
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {clash}").write.parquet(f"{root}/documents.parquet")
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>x"), (4, "u", "<p>x"), (5, "u", "<"), (6, "u", "<div>" * 500)]
    spark.createDataFrame([(*p, "?", "?") for p in pages], "page_id long, url string, html string, text string, digest string").write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


def table(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def run(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]


def only(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("where", ["small", "edge"])
def test_op1(spark, edge_dir, where):
    sf = SF if where == "small" else edge_dir
    docs = table(spark, sf, "documents")
    sets = [(d["doc_id"], shingles(d["text"])) for d in docs]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    want = sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)
    assert only(run(spark, sf, "op1_ngram_join"), "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize("where", ["small", "edge"])
def test_op5(spark, edge_dir, where):
    sf = SF if where == "small" else edge_dir
    raw = [(d["doc_id"], (d["text"] or "").encode()) for d in table(spark, sf, "documents")]
    got = run(spark, sf, "op5_sharding")
    assert only(got, "doc_id", "size", "text_crc32") == sorted(((i, len(t) + 8, zlib.crc32(t)) for i, t in raw), key=repr)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(24)) and {r["law"] for r in got} == {"rows"}
    full = [counts.get(s, 0) for s in range(24)]
    assert max(full) - min(full) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


@pytest.mark.parametrize("where", ["small", "edge"])
def test_op7(spark, edge_dir, where):
    sf = SF if where == "small" else edge_dir
    pages = [(p["page_id"], (p["html"] or "").encode()) for p in table(spark, sf, "pages")]
    first = {}
    for i, t in sorted(pages):
        first.setdefault(t, i)
    want = [(i, len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), "response" if first[t] == i else "revisit", None if first[t] == i else first[t]) for i, t in pages]
    assert only(run(spark, sf, "op7_warc"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)


@pytest.mark.parametrize("where", ["small", "edge"])
def test_op8(spark, edge_dir, where):
    sf = SF if where == "small" else edge_dir
    least = -(1 << 63)
    docs = [(d["doc_id"], d["text"] or "") for d in table(spark, sf, "documents")]
    docs.sort(key=lambda d: (-(least if d[0] is None else d[0]), d[1]))
    want = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = run(spark, sf, "op8_fingerprint")
    assert only(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
    by_text = {}
    texts = {i: t for i, t in docs}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_op8_insert_and_delete():
    from sievemark.llm import fingerprint as f

    whole, less = f.of_text("a one\nb two\nc three"), f.of_text("c three\na one")
    assert np.array_equal(f.insert(less, "b two"), whole) and np.array_equal(f.delete(whole, "b two"), less)
    assert np.array_equal(f.from_text(f.text_of(whole)), whole)


@pytest.mark.parametrize("where", ["small", "edge"])
def test_op9(spark, edge_dir, where):
    sf = SF if where == "small" else edge_dir
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in table(spark, sf, "documents"):
        ids = enc.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    assert only(run(spark, sf, "op9_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("where", ["small", "edge"])
def test_op10(spark, edge_dir, where):
    sf = SF if where == "small" else edge_dir
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(d["doc_id"], d["text"] or "") for d in table(spark, sf, "documents")]
    want, start = [], 0
    for i, t in sorted(docs, key=lambda d: -(1 << 63) if d[0] is None else d[0]):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert only(run(spark, sf, "op10_sstable"), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_op3_edges(spark, edge_dir):
    got = run(spark, edge_dir, "op3_html_text")
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[1] == ""


@pytest.mark.parametrize("name", ["op2_pii"])
def test_op2_edges(spark, edge_dir, name):
    got = run(spark, edge_dir, name)
    want = [(i, t) for i, t in [*enumerate(EDGE_TEXTS), (3, "one two"), (None, "a b c d e f g h")]]
    assert only(got, "doc_id", "text") == sorted(want, key=repr)


def test_op2_values(spark):
    from sievemark.llm.pii import pseudonymise

    text = "card 4111 1111 1111 1111, 4111111111111111; 2021-02-28; 10.1.2.3; GB82 WEST 1234 5698 7654 32; ssn 123-45-6789; not 4111 1111 1111 1112 nor 2021-02-30"
    rows = pseudonymise(spark.createDataFrame([(1, text), (2, "4111111111111111")], "doc_id long, text string")).orderBy("doc_id").collect()
    out = rows[0]["text"]
    assert re.sub(r"[0-9]+", "0", out) == re.sub(r"[0-9]+", "0", text)
    a, b = re.match(r"card ([0-9 ]{19}), ([0-9]{16});", out).groups()
    assert a.replace(" ", "") == b == rows[1]["text"] != "4111111111111111"
    assert sum(d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, b))) % 10 == 0
    assert out.endswith("not 4111 1111 1111 1112 nor 2021-02-30")
    assert "10.1.2.3;" not in out and "123-45-6789" not in out and "2021-02-28" not in out
