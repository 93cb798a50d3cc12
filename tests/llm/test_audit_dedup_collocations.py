"""Exact copies, filter audit and collocations: against plain versions, at the edges and on hot groups."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.llm import collocations as C
from sievemark.llm import exact_dedup, filter_audit

CLASHING = "hash string, row string, kept string, n string, part string, mask string, keep_id string, words string, id string, carry string, cells string, step string"


def documents(spark, rows):
    """doc_id, text, lang, and columns with the names of inner ones."""
    return spark.createDataFrame([(*r, *["?"] * 12) for r in rows], f"doc_id long, text string, lang string, {CLASHING}").repartition(3)


# exact copies

COPIES = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "a"), (None, "c"), (None, "c"), (7, "d"), (7, "d"), (9, "a "), (10, "A"), (11, "é"), (12, "é"), (13, "x" * 300_000), (14, "x" * 300_000), (15, "x" * 299_999)]


def plain_copies(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (max if keep == "largest" else min)(known) if known else None
        out += [(i, stays, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("content", ["md5", "length"])
def test_copies(spark, keep, content):
    """By a good hash, and by one that collides for most texts."""
    weak = {"content": lambda t: F.unhex(F.hex(F.length(t) % 2))} if content == "length" else {}
    docs = documents(spark, [(i, t, "en") for i, t in COPIES])
    rows = exact_dedup.deduplicate(docs, keep, **weak).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr) == plain_copies(COPIES, keep)
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in rows}  # one of each group
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_copies_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 1)
    rows = exact_dedup.deduplicate(documents(spark, [(i, t, "en") for i, t in COPIES]), "smallest").collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr) == plain_copies(COPIES, "smallest")


def test_copies_carry_columns_and_refuse_other_rules(spark):
    docs = documents(spark, [(1, "a", "en"), (2, "a", None)])
    rows = exact_dedup.deduplicate(docs, "smallest", carry={"lang": docs["lang"], "hash": docs["hash"], "double": docs["doc_id"] * 2}).collect()
    assert sorted((r["doc_id"], r["lang"], r["hash"], r["double"], r["kept"]) for r in rows) == [(1, "en", "?", 2, True), (2, None, "?", 4, False)]
    with pytest.raises(ValueError):
        exact_dedup.deduplicate(docs, "any")


def test_a_third_of_all_rows_is_one_group(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.deduplicate(docs, "largest")
    assert found.where("group_size = 10000 and keep_id = 29997").count() == 10_000
    assert found.where("kept").count() == 20_001
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


# filter audit


def plain_mask(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))


LONG = " ".join(f"w{i}" for i in range(200))
TEXTS = [None, "", LONG, LONG, LONG.upper(), LONG + " #", "w " * 200, " ".join(["a", "b"] * 50 + [f"c{i}" for i in range(98)]), " ".join([f"c{i}" for i in range(100)] + ["d"] * 100), "\x0b\x0cA\x1c\x85b", "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "W " * 60_000 + "|", "Ünï ÇÖDÉ Ā"]
LANGS = ["en", None, "", "de"]


@pytest.fixture(scope="module")
def audit_rows():
    rows = [(i, t, LANGS[i % 4]) for i, t in enumerate(TEXTS * 3)]
    return rows + [(None, LONG, "en"), (2, LONG, "en"), (50, LONG, "fr")]


def plain_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    docs = [(lang or "", plain_mask(t) + 16 * (i is not None and i > first[t or ""]), i in good, i in toxic) for i, t, lang in rows]
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed_by = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                removed_by[letter] += len(gone)
                fails = sum(bool(d[1] & bit) for d in own)
                lines.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(d[1] == bit for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), letter))
        out += [(*x[:-1], removed_by[x[-1]]) for x in lines]
    return sorted(out)


def test_audit(spark, audit_rows):
    labels = [(i, i % 2, (i + 1) % 3) for i in range(40)] + [(3, None, None), (4, 1, 1), (None, 1, 1), (2, 1, 0), (999, 1, 1)]
    table = spark.createDataFrame([(*x, "?", "?") for x in labels], "doc_id long, quality int, toxic int, part string, mask string")
    found = filter_audit.audit(documents(spark, audit_rows), table)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found.columns == columns
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(audit_rows, labels)


def test_masks(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").select("i", "text", filter_audit.text_masks(F.col("text")).alias("m")).collect()
    assert [r["m"] for r in sorted(rows, key=lambda r: r["i"])] == [plain_mask(t) for t in TEXTS]


def test_audit_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(documents(spark, [(1, "a", "en")]), none).collect()
    assert len(rows) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)
    assert {(r["filter_order"][r["step"] - 1], r["shapley"]) for r in rows} == {("A", 120), ("B", 0), ("C", 0), ("D", 0), ("E", 0)}


# collocations


def plain_collocations(rows, most, least, percent=100):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, *w[i : i + s]) for s in range(1, 6) for i in range(len(w) - s + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), f in candidates.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                longer[lang, *w[i : i + s]] = max(longer[lang, *w[i : i + s]], f)
    out = {}
    for (lang, *w), a in candidates.items():
        if 100 * longer[lang, *w] >= percent * a and longer[lang, *w]:
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), counts[lang, *w[:k]], counts[lang, *w[k:]], total[lang]))
    return sorted((lang, n, p.decode(), -a, left, right, t, -s) for lang, rows in out.items() for n, (s, a, p, left, right, t) in enumerate(sorted(rows)[:most], 1))


def odd_texts():
    rng = np.random.default_rng(5)
    words = ["The", "of", "a", "É", "é", "x y", "b\u0085", "-", "漢字", "…", "w\x1cw"]
    texts = []
    for _ in range(300):
        text = "".join(words[i] + [" ", "  ", "\t", ". ", ",", "\n", "\x0b", ";"][j] for i, j in zip(rng.zipf(1.6, 30) % 11, rng.zipf(1.5, 30) % 8, strict=True))
        texts.append(text)
    langs = ["en", "de", None, "und", ""]
    rows = [(langs[i % 5], t) for i, t in enumerate(texts)]
    return rows + [("en", None), (None, ""), ("en", " . , "), ("en", "a a a a a a a a a a a a " * 40), ("en", "The of a É é The of a É é"), ("fr", "w" * 500_000 + " z")]


@pytest.mark.parametrize(("most", "least", "percent"), [(2000, 5, 100), (7, 20, 100), (2000, 5, 60), (2000, 100_000, 100)])
def test_collocations(spark, most, least, percent):
    rows = odd_texts()
    docs = documents(spark, [(i // 2, t, lang) for i, (lang, t) in enumerate(rows)])
    found = C.mine(docs, most, least, percent)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, most, least, percent)


def test_hot_prefixes_are_dealt_and_summed(spark, monkeypatch):
    """Every pair counts as hot: all prefixes are dealt over tasks, and their parts are summed."""
    monkeypatch.setattr(C, "HOT", 1_000_000)
    rows = odd_texts()
    found = C.mine(documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]), 2000, 5)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 2000, 5)


def test_full_filters_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(C, "bitmap", lambda keys, name, bits=7: np.full(1 << (bits - 6), -1, np.int64))
    rows = odd_texts()
    found = C.mine(documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]), 2000, 5)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 2000, 5)


def test_rare_threes_are_not_projected(spark, monkeypatch):
    """Random words have frequent pairs and rare threes, of which no row is made; full slots change no result."""
    rng = np.random.default_rng(8)
    rows = [("en", " ".join(f"w{i}" for i in rng.integers(0, 30, 400)) + " , one two three four") for _ in range(60)]
    docs, made = documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]), []
    project = C.project
    monkeypatch.setattr(C, "project", lambda *args: made.append(project(*args)) or made[-1])
    want = plain_collocations(rows, 2000, 15)
    assert len(want) > 500
    assert sorted(tuple(r) for r in C.mine(docs, 2000, 15).collect()) == want
    assert {tuple(r)[:5].count(0) for r in made[0].select(*C.WINDOW).collect()} <= {1, 2}
    assert made[0].agg(F.sum("n")).first()[0] == 120
    monkeypatch.setattr(C.count_threes, "__defaults__", (0, 8))
    assert sorted(tuple(r) for r in C.mine(docs, 2000, 15).collect()) == want
    assert made[1].agg(F.sum("n")).first()[0] > 20_000


def test_long_texts_are_told_in_slices(monkeypatch):
    """The windows of a text are the same whether it comes whole or in slices that are cut anywhere."""
    text = (" ".join(f"{a} {b}, the end" for a, b in zip("abcdefghij" * 30, "klmnopqrst" * 30, strict=True)) + " ").encode()

    def windows(size):
        monkeypatch.setattr(C, "SLICE", size)
        monkeypatch.setattr(C.slices, "__defaults__", (size,))
        full = np.full(2, -1, np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.decode()])], names=["lang", "text"])
        out = [C.windows_of(ids, starts, full) for ids, starts in C._chains(iter([batch]), 0, full)]
        return Counter(map(tuple, np.concatenate(out).tolist())), sum(starts for _, starts in C._chains(iter([batch]), 0, full))

    whole = windows(1 << 20)
    for size in (1, 3, 7, 50, 1000):
        assert windows(size)[0] == whole[0]


def test_growth_goes_on_over_batches():
    rng = np.random.default_rng(3)
    windows = rng.integers(1, 4, (400, 5)).astype(np.uint64)
    for row in windows:
        row[3 + rng.integers(0, 3) :] = 0
    windows = windows[np.lexsort(windows.T[::-1])]
    counts, salts = rng.integers(1, 9, 400), np.zeros(400, np.int32)
    want = Counter()
    for w, n in zip(windows.tolist(), counts.tolist(), strict=True):
        for d in range(3, 6):
            if w[d - 1]:
                want[tuple(w[:d]) + (0,) * (5 - d)] += n
    for size in (1, 7, 400):
        got = Counter()
        for prefixes, f in C.grown(((windows[i : i + size], salts[i : i + size], counts[i : i + size]) for i in range(0, 400, size)), 30):
            for p, n in zip(prefixes.tolist(), f.tolist(), strict=True):
                assert tuple(p) not in got
                got[tuple(p)] = n
        assert got == Counter({p: n for p, n in want.items() if n >= 30})


def test_scores_beyond_64_bits(spark):
    row = spark.range(1).select(C.score(F.lit(10**14), F.lit(10**15), F.lit(10**14), F.lit(10**14 + 1)).alias("s")).first()
    assert row["s"] == 1000 * 10**14 * 10**15 // (10**14 * (10**14 + 1))


# counts of the quality model


def test_counts_are_the_same_however_many_parts_come(spark, monkeypatch):
    from sievemark.llm import quality

    texts = spark.range(60).select(F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.concat(F.lit("the word "), F.col("id").cast("string"), F.lit(" and the same again")).alias("text"))

    def counts(df):
        rows = quality.train(df).shards.collect()
        return {(r["lang"], r["r"]): (quality._unpacked(r["keys"]).tolist(), quality._unsized(r["counts"], len(r["keys"]) // 5).tolist()) for r in rows}

    one = counts(texts.coalesce(1))
    assert counts(texts.repartition(40)) == one and len(one) > 50
    assert sum(map(sum, (c for _, c in one.values()))) > 60 * 25


def test_large_counts_take_eight_bytes():
    from sievemark.llm import quality

    for counts in ([], [1, 2, 3], [1, 1 << 40]):
        values = np.array(counts, np.int64)
        assert quality._unsized(quality._sized(values), len(counts)).tolist() == counts
