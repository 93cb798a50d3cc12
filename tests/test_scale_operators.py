"""Operators that are built for hot keys and long texts, against plain versions."""

import itertools
import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievemark.operators import blocks as B
from sievemark.operators import explore as X
from sievemark.operators import fingerprints as FP
from sievemark.operators import set_join as J
from sievemark.operators import similarity as S

WORDS = "Alpha beta,  gamma\ndelta\n\nepsilon zeta. eta Straße ÉTÉ 漢字 x1 ́a İs".split(" ")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    made = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 20, 29, 30, 31, 59, 60, 61, 120, 199, 200, 230, 499, 500, 700, 1500)]
    made += ["a " * 700, "a " * 300 + "b c d e f g h i j k l m " + "a " * 300, "x y " * 400, "w" * 3000, "\n" * 500 + "one two three four", "", " .,; ", "a b c " * 7 + "\n\n" + "q r s t u " * 200]
    return spark.createDataFrame([(i, t) for i, t in enumerate(made)] + [(99, None)], "doc_id long, text string")


@pytest.mark.parametrize("chars", [1, 7, 50, 5000])
def test_segments_of_any_size_give_the_same_prints(spark, texts, chars):
    want = rows(FP.fingerprints(texts, longest=1 << 30))
    assert len(want) > 500
    assert rows(FP.segmented(texts, chars=chars)) == want


def test_long_texts_go_in_segments(spark, texts):
    assert rows(FP.fingerprints(texts, longest=100)) == rows(FP.fingerprints(texts, longest=1 << 30))
    assert rows(FP.fingerprint_set(texts, longest=100)) == rows(FP.fingerprint_set(texts, longest=1 << 30))
    assert rows(FP.all_hashes(texts, longest=100)) == rows(FP.all_hashes(texts, longest=1 << 30))


def test_repeated_rows_repeat(spark):
    text = "one two three four five six seven eight " * 30
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert rows(FP.segmented(docs, chars=60)) == rows(FP.fingerprints(docs, longest=1 << 30))


def test_stretches_are_moved_once_and_whole(spark, texts):
    """No join, no window and no distinct: texts are dealt once. A run of one word is not cut, what is cut belongs to one stretch."""
    plan = FP.segmented(texts, chars=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert not any(word in plan for word in ("Join", "Window", "Aggregate"))
    text = "one two three four five six seven eight nine ten " * 100 + "a " * 2000 + "b c d e f g h i j " * 100
    cut = list(FP._stretches(text, 60))
    assert len(cut) > 20
    assert [c[4] for c in cut[1:]] == [c[5] for c in cut[:-1]] and cut[0][4] == 0 and cut[-1][5] == 3900
    assert rows(FP.segmented(spark.createDataFrame([(1, text)], "doc_id long, text string"), chars=60)) == rows(FP.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string"), longest=1 << 30))


# --- weighted set join


def plain_pairs(sets, threshold):
    """All pairs of different sets with the exact weighted similarity, by the weights' rounded decimals."""
    df = Counter(h for s in sets.values() for h in s)
    weight = {h: Decimal(repr(round(1 / math.log(1 + n), 12))).quantize(Decimal("1e-12")) for h, n in df.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    out = {}
    for (x, a), (y, b) in itertools.combinations(sorted(first.items(), key=lambda k: k[1]), 2):
        shared = sum((weight[h] for h in x & y), Decimal(0))
        union = sum((weight[h] for h in x | y), Decimal(0))
        if x & y and shared >= Decimal(str(threshold)) * union:
            out[a, b] = (len(x & y), round(float(shared) / float(union), 4))
    return out, {i: first[frozenset(s)] for i, s in sets.items()}


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(3)
    out = {}
    for i in range(120):
        base = set(rng.sample(range(60), rng.randrange(1, 12)))
        out[i] = {"hot"} | {f"h{x}" for x in base} if i % 2 else {f"h{x}" for x in base}  # half of all hold one hash
    for i in range(120, 150):
        out[i] = set(out[i - 120])
        if i % 3 == 0 and len(out[i]) > 1:
            out[i].discard(sorted(out[i])[0])
    out[150] = {"hot"}
    out[151] = {"hot"}
    return out


@pytest.mark.parametrize("threshold", [0, 0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("block", [3, 2000])
def test_set_join(spark, sets, threshold, block):
    prints = spark.createDataFrame([(i, h) for i, s in sets.items() for h in s], "doc_id long, hash string")
    pairs, member = J.pairs_over(prints, threshold, block=block)
    want, classes = plain_pairs(sets, threshold)
    assert {r["doc_id"]: r["class_id"] for r in member.collect()} == classes
    assert {(r["class_a"], r["class_b"]): (r["n_shared"], r["similarity"]) for r in J.similarity(pairs).collect()} == want


def test_set_join_expanded_is_the_plain_one(spark, sets):
    prints = spark.createDataFrame([(i, h) for i, s in sets.items() for h in s], "doc_id long, hash string")
    every = rows(S.weighted_jaccard(prints))
    assert rows(J.expanded(*J.pairs_over(prints, 0))) == every
    some = {(a, b): s for a, b, _, s in every if s >= 0.6}
    assert {(r[0], r[1]): r[3] for r in rows(J.expanded(*J.pairs_over(prints, 0.6)))} == some


@pytest.mark.parametrize("most", [1, 20, 400, 100_000])
def test_top_is_that_of_all_pairs(spark, sets, most):
    copies = {i: {"only", "of", "copies"} for i in range(1000, 1030)}  # one class with more pairs than asked for
    prints = spark.createDataFrame([(i, h) for i, s in (sets | copies).items() for h in s], "doc_id long, hash string")
    want = sorted(map(tuple, S.weighted_jaccard(prints).collect()), key=lambda r: (-r[3], r[0], r[1]))[:most]
    assert list(map(tuple, J.top(prints, most).collect())) == want


def test_hashes_of_one_set_go_no_further_than_their_count(spark):
    prints = spark.createDataFrame([(i, f"own{i}-{j}") for i in range(6) for j in range(50)] + [(i, "both") for i in range(6)], "doc_id long, hash string")
    _, sets = J._weighed(prints, "doc_id")
    assert sets.count() == 6
    pairs = rows(J.similarity(J.pairs_over(prints, 0)[0]))
    assert [r[:2] + r[3:] for r in pairs] == [r[:2] + r[3:] for r in rows(S.weighted_jaccard(prints))]


def test_a_hot_hash_is_in_no_single_task(spark):
    """2,000 sets share a hash and nothing else: with a threshold they never meet; without one, no task of the join sees them all."""
    prints = spark.range(4000).select((F.col("id") % 2000).alias("doc_id"), F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("hash"))
    pairs, _ = J.pairs_over(prints, 0.5)
    assert pairs.count() == 0
    left = prints.where("hash = 'hot'").withColumn("blocks", F.lit(20)).withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(20)))
    assert left.groupBy("b").count().agg(F.max("count")).first()[0] < 200


def test_thresholds_are_checked(spark):
    with pytest.raises(ValueError):
        J.pairs_over(spark.createDataFrame([], "doc_id long, hash string"), 1.5)
    assert J.pairs_over(spark.createDataFrame([], "doc_id long, hash string"), 0.5)[0].collect() == []


# --- frequencies of blocks


def plain_frequency(blocks):
    by = defaultdict(list)
    for pair, _, file, a, b in blocks:
        if file is not None:
            by[file.rsplit("/", 1)[-1].lower()].append((pair, a, b))
    return {(p, i): len({q for q, x, y in by[f.rsplit("/", 1)[-1].lower()] if q != p and x <= b and a <= y}) if f is not None else 0 for p, i, f, a, b in blocks}


@pytest.mark.parametrize(("names", "lines"), [(1, 30), (3, 400), (1, 20_000)])
def test_block_frequency(spark, names, lines):
    rng = random.Random(lines)
    blocks, n = [], 0
    for pair in range(70):
        for _ in range(rng.randrange(0, 7)):
            a = rng.randrange(1, lines)
            n += 1
            blocks.append((f"p{pair}", n, rng.choice(["src/", "lib/"]) + rng.choice(["Main", "MAIN", "main"])[: 4 + 0] + f"{rng.randrange(names)}.java", a, a + rng.choice([0, 1, 2, 10, lines // 3])))
    blocks.append(("p1", n + 1, None, 1, 5))
    df = spark.createDataFrame(blocks, "pair string, block_id int, file_a string, start_a int, end_a int")
    assert {(r["pair"], r["block_id"]): r["others"] for r in X.block_frequency(df).collect()} == plain_frequency(blocks)


def test_no_blocks(spark):
    assert X.block_frequency(spark.createDataFrame([], "pair string, block_id int, file_a string, start_a int, end_a int")).collect() == []


# --- files and blocks


def test_the_first_namesake_counts_whether_it_shares_or_not(spark):
    prints = spark.createDataFrame([("s1", "F", "h1"), ("s1", "F", "h2"), ("s2", "a/F", "h9"), ("s2", "b/f", "h1"), ("s2", "b/f", "h2"), ("s1", "G", "h3")], "doc_id string, file string, hash string")
    pairs = spark.createDataFrame([("s1", "s2")], "doc_id_a string, doc_id_b string")
    assert rows(B.file_similarity(prints, pairs)) == [("s1", "s2", "F", "a/F", 0.0)]


def test_labels_of_prints_are_those_of_a_look_at_all_spans(spark):
    rng = random.Random(9)
    files = []
    for i in range(40):
        spans = [(rng.choice(["LOOP", "METHOD", "IF", "SWITCH", "CLASS"]), a, a + rng.randrange(0, 20), f"n{a}", None) for a in (rng.randrange(1, 40) for _ in range(8))]
        prints = [(f"h{j}", a, a + rng.randrange(0, 4)) for j, a in enumerate(rng.randrange(1, 50) for _ in range(10))]
        files.append((i, f"F{i}", prints, [(k, a, b, n, "for" if k == "LOOP" else s) for k, a, b, n, s in spans]))
    files.append((98, "empty", [], []))
    files.append((99, "nothing", None, None))
    df = spark.createDataFrame(files, "doc_id int, file string, prints array<struct<hash:string,start:int,end:int>>, spans array<struct<type:string,start:int,end:int,name:string,loop_subtype:string>>")
    plain = B.with_units(df.select("doc_id", "file", F.explode("prints").alias("p"), "spans").select("doc_id", "file", "p.*", "spans"))
    columns = ["doc_id", "file", "hash", "start", "end", "unit_type", "unit_start", "unit_end", "loop_start", "loop_end", "method_start", "method_end", "loop_subtype"]
    assert rows(B.labelled(df).select(columns)) == rows(plain.select(columns))


def test_weak_blocks_stand_in_where_no_strong_one_is(spark):
    schema = "doc_id_a string, doc_id_b string, file_a string, file_b string, density double, hash_count long, from_a int, from_b int"
    blocks = spark.createDataFrame([("a", "b", "F", "F", 0.1 * i, i, i, i) for i in range(1, 12)] + [("a", "c", "F", "F", 0.9, 1, 1, 1)], schema)
    chosen = spark.createDataFrame([("a", "c")], "doc_id_a string, doc_id_b string")
    got = B.weak_fallback(blocks, chosen).orderBy("place").collect()
    assert [r["from_a"] for r in got] == [11, 10, 9, 8, 7, 6, 5, 4] and {r["doc_id_b"] for r in got} == {"b"}


# --- reports of runs


def _runs(spark):
    value = lambda n: (F.col("id") * 7919 % n).cast("double")
    rows = spark.range(400).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("line"), *[F.when(F.col("id") % 11 != i, value(i + 2)).alias(k) for i, k in enumerate(X.RANKED)])
    name = lambda n, by: F.when(F.col("line") % 13 == 0, "").when(F.col("line") % 17 == 0, None).when(F.col("line") % by == 0, F.concat(F.lit("_ref_"), (F.col("line") % n).cast("string"))).otherwise((F.col("line") % n).cast("string"))
    return rows.withColumns({"student_1": name(31, 5), "student_2": name(29, 7)})


def test_both_places_come_from_one_sort(spark):
    out = X.rankings(_runs(spark), ["run_id"], "line")
    place = lambda order: F.row_number().over(Window.partitionBy("run_id").orderBy(order, "line"))
    want = _runs(spark).withColumns({f"{k}_{way}": place(getattr(F, way)(k)) for k in X.RANKED for way in ("desc", "asc")})
    assert rows(out.select(want.columns)) == rows(want)
    plan = X.rankings(_runs(spark), ["run_id"], "line")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= len(X.RANKED)


def test_labels_by_first_appearance_without_a_join(spark):
    numbered = X.numbered(_runs(spark), "run_id", "line").cache()
    got = X.anonymised(numbered, "run_id")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    seen, want = {}, []
    for r in sorted(numbered.collect(), key=lambda r: (r["run_id"], r["pair_index"])):
        names = []
        for c in ("student_1", "student_2"):
            s = r[c]
            if s:
                of = seen.setdefault((r["run_id"], s.startswith("_ref_")), {})
                n = of.setdefault(s, len(of))
                s = f"Ref {chr(65 + n % 26)}" if s.startswith("_ref_") else f"Student {chr(65 + n) if n < 26 else chr(64 + n // 26) + chr(65 + n % 26)}"
            names.append(s)
        want.append((r["run_id"], r["pair_id"], *names, r["severity_score"]))
    assert got.columns == numbered.columns
    assert rows(got.select("run_id", "pair_id", "student_1", "student_2", "severity_score")) == sorted(want, key=repr)


def test_runs_are_dealt_by_the_size_of_the_table(spark, tmp_path):
    spark.range(3_000_000).select((F.col("id") % 10).alias("run_id"), F.rand(1).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert X.dealt(table, "run_id", table).rdd.getNumPartitions() > 16


@pytest.mark.parametrize("whole", [64, 3])
def test_files_of_all_pairs(spark, whole):
    made = [(i % 40, f"d{i % 2}/{'fFgh'[i % 4]}", f"h{(i * 31) % 53}") for i in range(240)] + [(50, None, "h1"), (51, "x/f", None), (51, "x/f", "h2"), (52, "y/f", "h2")]
    prints = spark.createDataFrame(made, "doc_id long, file string, hash string")
    pairs = S.candidate_pairs(prints.select("doc_id", "hash").where("hash is not null").distinct())
    got = B.file_similarity_of_all(prints, whole=whole)
    assert rows(got) == rows(B.file_similarity(prints, pairs))
    assert got.count() > 50
