"""Operators beyond their queries: models, round trips and laws, against plain versions."""

import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievemark.llm import bpe, fingerprint, html_text, ngram_join, pii, quality, queries, sstable, warc
from sievemark.llm.common import new_path

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# --- n-gram join
def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: rng.integers(0, len(a) + 1)]]))
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in ngram_join.sketch_of(a) ^ ngram_join.sketch_of(b))
        assert differ <= len(np.setxor1d(a, b))


def test_pairs_are_all_links(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    known = [(r["doc_id"], {x for x in zip(*(re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())[i:] for i in range(5)))}) for r in docs.collect()]
    first = {}
    for i, s in sorted(known):
        first.setdefault(frozenset(s), i)
    sets = [(i, s) for s, i in first.items() if s]
    want = {(min(a, b), max(a, b), len(x & y), len(x | y)) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    got = {(r["a"], r["b"], r["shared"], r["united"]) for r in ngram_join.join_pairs(docs).collect()}
    assert {g for g in got if min(g[2:]) > 1} == {w for w in want if min(w[2:]) > 1}


def test_many_near_copies_of_one_text(spark):
    """A group whose members often differ from the smallest one by too much still becomes one component where links say so."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(120)] = f"x{d}_{rng.random()}"
        rows.append((d, " ".join(words)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(116)} for d, t in rows for w in [t.split()]}
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: find(d) for d in sets}


# --- personal data
def planted(n):
    rng = random.Random(3)

    def luhn(d):
        s = sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
        return str((10 - s % 10) % 10)

    out = set()
    while len(out) < n:
        k = rng.randrange(5)
        if k == 0:
            d = "4" + "".join(rng.choices("0123456789", k=14))
            out.add(("card", d + luhn(d)))
        elif k == 1:
            out.add(("date", f"{rng.randrange(1950, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"))
        elif k == 2:
            out.add(("social", f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"))
        elif k == 3:
            out.add(("address", ".".join(str(rng.randrange(256)) for _ in range(4))))
        else:
            out.add(("phone", f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(10000):04d}"))
    return sorted(out)


def test_pseudonyms_are_one_to_one_and_keep_their_format(spark):
    values = planted(3000)
    rows = [(i, f"note {v} end") for i, (_, v) in enumerate(values)] + [(len(values) + i, f"again: {v}.") for i, (_, v) in enumerate(values) if i % 7 == 0]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = [got[i][5:-4] for i in range(len(values))]
    for (_, v), w in zip(values, new, strict=True):
        assert re.sub("[0-9]+" if "." in v else "[0-9]", "0", v) == re.sub("[0-9]+" if "." in v else "[0-9]", "0", w)
    for kind in {k for k, _ in values}:
        mine = [w for (k, _), w in zip(values, new, strict=True) if k == kind]
        assert len(set(mine)) == len(mine)
        assert sum(w == v for (k, v), w in zip(values, new, strict=True) if k == kind) <= 2
    for (k, _), w in zip(values, new, strict=True):
        if k == "card":
            assert sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(w)))) % 10 == 0
    for i in range(0, len(values), 7):
        assert got[len(values) + i] == f"again: {new[i]}."


@pytest.mark.parametrize("left", ["31/02/2021", "2021-02-30", "4111 1111 1111 1112", "999-12-3456", "300.1.2.3"])
def test_failed_checks_stay(spark, left):
    assert pii.pseudonymise(spark.createDataFrame([(1, f"x {left} y")], "doc_id long, text string")).first()["text"] == f"x {left} y"


@pytest.mark.parametrize("text", ["password=p@ssw0rd1", "password=12345678", "token=abcd@efgh1234", "call 555-123-4567", "on 12/31/2021", 'token = "a b@c.d 12345"'])
def test_nothing_leaks(spark, text):
    row = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_replaced"] == 1 and row["text"] != text and text.split("=")[-1].split()[-1].strip('"') not in row["text"]


# --- html
@pytest.mark.parametrize("page", ["<a " * 20000, '<a "' * 20000, "<div>" * 20000 + "</span>" * 20000, "<!--" * 20000, "<a " * 20000 + "<!--", '<a "' * 20001 + ">", "&" * 200000])
def test_hostile_pages_are_quick(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 2


def test_distribution_against_plain_windows():
    rng = random.Random(2)
    for _ in range(500):
        w = [rng.choice([0, 0, 0, 5, 40]) for _ in range(rng.randrange(30))]
        kept = {i for a, b in html_text.stretches(w) for i in range(a, b)}
        text = [i for i, x in enumerate(w) if x]
        want = {i for i in range(len(w)) if w[i] or any(a < i < b and b - a <= html_text.WINDOW for a, b in zip(text, text[1:]))}
        assert kept == want


# --- quality
def plain_kneser_ney(texts, order=5):
    """Probabilities of a byte after four, from dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        raw = b"\x02" * (order - 1) + t
        counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(k[1:] for k in counts[o + 1])
    d = {o: quality.discounts(*(float(sum(c == n for c in counts[o].values())) for n in (1, 2, 3, 4))) for o in counts}
    by_context = {o: {} for o in counts}
    for o in counts:
        for k, c in counts[o].items():
            by_context[o].setdefault(k[:-1], []).append(c)

    def p(gram):
        o = len(gram)
        below = p(gram[1:]) if o > 1 else 1 / 256
        seen = by_context[o].get(gram[:-1])
        if not seen:
            return below
        c = counts[o].get(gram, 0)
        return ((c - d[o][min(c, 3)]) if c else 0.0) / sum(seen) + sum(d[o][min(x, 3)] for x in seen) / sum(seen) * below

    return p


def words_bytes(text):
    ws = text.split()
    return ("".join(("\x01" if i and w == ws[i - 1] else "") + w + " " for i, w in enumerate(ws))).encode()


def test_perplexity_against_plain_model(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) < 1500").limit(40).collect()]
    model_texts, asked = docs[:25], [*docs[25:], "a", "x x x x", "déjà vu \U0001f600 q", "  b\tb  b ", ""]
    p = plain_kneser_ney([words_bytes(t) for t in model_texts])
    model = quality.train(spark.createDataFrame([("en", t) for t in model_texts], "lang string, text string"))
    rows = spark.createDataFrame([(i, "t", "en", t) for i, t in enumerate(asked)], "doc_id long, tag string, lang string, text string")
    got = {r["doc_id"]: r for r in quality.bits_per_byte(rows, model).collect()}
    for i, t in enumerate(asked):
        raw = words_bytes(t)
        if not raw:
            assert got[i]["bits"] is None
            continue
        full = b"\x02" * 4 + raw
        want = -sum(math.log2(p(full[k : k + 5])) for k in range(len(raw))) / len(raw)
        assert got[i]["n_bytes"] == len(raw) and abs(got[i]["bits"] - want) < 1e-4


def test_held_out_accuracy(spark):
    """Half of the labels train and set limits, the other half judges. The bounds were set after measuring, a little below the figures.

    On this table; on a tenth of it the limits rest on a few texts a language, and one half kept only 87.6 % of the clean ones.
    """
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.hash("doc_id"), F.lit(2)) == 0
    judged = quality.classify(docs, labels.where(half)).select("doc_id", "keep").join(labels.where(~half), "doc_id").collect()
    good, bad = [r["keep"] for r in judged if r["quality"] == 1], [r["keep"] for r in judged if r["quality"] == 0]
    assert len(bad) > 100 and sum(good) / len(good) >= 0.97 and 1 - sum(bad) / len(bad) >= 0.95


# --- archive
def test_records_are_rebuilt(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 50), (2, "http://b", "x" * 50), (3, None, None), (4, "u\r\nv", "<p>é\r\n\r\n")], "page_id long, url string, html string")
    root = new_path(spark, "test-warc")
    warc.write_archive(pages, root)
    whole = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(spark, root, full=True).collect()}
    short = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(spark, root).collect()}
    assert whole[2].endswith(b"x" * 50 + b"\r\n\r\n") and short[2].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    for page in pages.collect():
        ((header, body),) = warc.parse_warc(short[page["page_id"]])
        payload = (page["html"] or "").encode()
        assert body == (b"" if page["page_id"] == 2 else payload) and header.startswith(b"WARC/1.1\r\n")
    for name, data in (("all.warc", b"".join(short[i] for i in sorted(short))), ("cut.warc", short[1] + short[4][:-9])):
        (tmp_path / name).write_bytes(data)
    read = warc.read_warc_files(spark, f"file://{tmp_path}").collect()
    assert Counter(os.path.basename(r["path"]) for r in read) == {"all.warc": 4, "cut.warc": 1}


def test_damage_is_seen(spark):
    pages = spark.createDataFrame([(1, "http://a", "x" * 50), (2, "http://b", "x" * 50), (3, "http://c", "y")], "page_id long, url string, html string")

    def archive(change_heads=lambda h: h, change_payloads=lambda p: p):
        root, broken = new_path(spark, "test-warc"), new_path(spark, "test-warc")
        warc.write_archive(pages, root)
        change_heads(spark.read.parquet(f"{root}/headers")).write.parquet(f"{broken}/headers")
        change_payloads(spark.read.parquet(f"{root}/payloads")).write.parquet(f"{broken}/payloads")
        return broken

    assert warc.read_records(spark, archive()).count() == 3
    header = F.decode("header", "UTF-8")
    for root, says in (
        (archive(change_payloads=lambda p: p.where("payload_bytes > 1")), "missing payload"),
        (archive(change_payloads=lambda p: p.withColumn("payload", F.encode(F.lit("z" * 50), "UTF-8"))), "damaged payload"),
        (archive(lambda h: h.withColumn("header", F.encode(F.regexp_replace(header, "Content-Length: 50", "Content-Length: 51"), "UTF-8"))), "length does not fit"),
        (archive(lambda h: h.withColumn("header", F.encode(F.regexp_replace(header, "sha1:.", "sha1:7"), "UTF-8"))), "another digest"),
        (archive(lambda h: h.where("page_id <> 1")), "response is missing"),
    ):
        with pytest.raises(Exception, match=says):
            warc.read_records(spark, root).collect()


# --- sharding
def test_equal_texts_share_a_shard(spark):
    got = queries.op5_sharding(spark, SF).withColumnRenamed("shard", "s").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.md5("text").alias("m")), "doc_id").collect()
    shards, sizes = {}, Counter(r["m"] for r in got)
    for r in got:
        shards.setdefault(r["m"], set()).add(r["s"])
    share = len(got) // 24
    together = [m for m, n in sizes.items() if 1 < n <= max(2, share // 2)]
    assert not together or sum(len(shards[m]) == 1 for m in together) / len(together) >= 0.9


# --- fingerprints
def test_fingerprints_and_likeness_in_the_query(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    after = {d: docs[(i + 1) % len(docs)][1] for i, (d, _) in enumerate(docs)}
    text = dict(docs)
    for r in queries.op8_fingerprint(spark, SF).collect():
        own, other = text[r["doc_id"]], after[r["doc_id"]]
        k = len(own) // 2
        edited = own[: len(own) - k] + other[:k]
        assert r["fingerprint"] == fingerprint.text_of(fingerprint.of_text(own)) and r["edited_fingerprint"] == fingerprint.text_of(fingerprint.of_text(edited))
        a, b = Counter(fingerprint.clauses(own)), Counter(fingerprint.clauses(other))
        size = sum(v * v for v in a.values()) + sum(v * v for v in b.values())
        gap = sum((a[c] - b[c]) ** 2 for c in a | b)
        assert abs(r["near_next"] - (1.0 if a == b else max(0.0, 1 - gap / size))) < 0.35


# --- token ids
def test_lookup(spark):
    docs = spark.createDataFrame([(i // 2 if i < 4 else i, f"word number {i}") for i in range(300)] + [(None, "nothing")], "doc_id long, text string")
    manifest = sstable.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "test-sst"), shards=3)
    asked = [0, 1, 77, 299, 5000, -1]
    found = Counter(r["doc_id"] for r in sstable.lookup(manifest, asked).collect())
    assert found == {0: 2, 1: 2, 77: 1, 299: 1}
    ids = {r["doc_id"]: r["ids"] for r in sstable.read_shards(spark, manifest, keep_ids=True).collect()}
    assert next(r["ids"] for r in sstable.lookup(manifest, [77]).collect()) == ids[77]
    assert sum(r["n_docs"] for r in manifest.collect()) == 301


def test_words_encoder_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        mine = sstable.WordEncoder(f.read())
    texts = ["", None, " ", "a  b\n\nc", "it's d'x 'll", "é,é, क़x", "x1y22(z)", "ΑΣ. ΑΣΑ", "\t\x0b　q", "A" * 300, "don't.can't,'s", "<|endoftext|> x", "a<|startoftext|>b, c", "<|ENDOFTEXT|>"]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in mine.encode(pa.array(texts, pa.string()))] == want


def test_decode_round_trip(spark):
    texts = ["", "plain words here", " lead and trail ", "é\U0001f600\x1fx\t\ty", "a\nb\n\nc", None]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, keep_ids=True)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded, path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["decoded_sha256"] for r in coded.collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
