"""Source code: tokens, archives, a whole run, sinks and the stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sievemark.functions import code_tokens as T
from sievemark.functions.scalars import strip_comments
from sievemark.operators import blocks as B
from sievemark.plans import engine
from sievemark.sources import archives as A
from sievemark.sources import sinks
from sievemark.streaming import ingest

ONE = """public class Store {
    public int sumOf(int[] items, int count) {
        int total = 0;
        for (int i = 0; i < count; i++) {
            if (items[i] > 3) {
                total += items[i];
            }
        }
        return total;
    }
    public int scaled(int base, int times) {
        int out = 1;
        while (times > 0) {
            out = out * base;
            times--;
        }
        System.out.println(out);
        return out;
    }
}
"""
TWO = ONE.replace("Store", "Shop").replace("sumOf", "adding").replace("items", "goods").replace("count", "n").replace("total", "acc").replace("scaled", "powered").replace("base", "b").replace("times", "e").replace("out", "res").replace("System.res", "System.out")
OTHER = """public class Words {
    public boolean same(String s) {
        StringBuilder sb = new StringBuilder();
        sb.append(s).reverse();
        return sb.toString().equals(s.toLowerCase());
    }
    public String cut(String s, String t) {
        try { return s.substring(0, s.length() - t.length()); } catch (Exception e) { throw e; }
    }
}
"""


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def names(source, java=True):
    return [t for t, _ in T.parse(source, java)[0]]


def test_names_do_not_show():
    assert names(ONE) == names(TWO) != names(OTHER)


def test_headers_give_nothing_and_bodies_are_bracketed():
    tokens, spans = T.parse("class A {\n void f(int a, String b) {\n  for (int i = 0; i < a; i++) {\n   g(i);\n  }\n }\n}\n", True)
    assert tokens == [("ID", 1), ("FUNC_DEF", 2), ("LOOP_START", 3), ("CALL", 4), ("ID", 4), ("ID", 4), ("LOOP_END", 5), ("FUNC_END", 6)]
    assert spans == [("METHOD", 2, 6, "f", None), ("LOOP", 3, 5, None, "for")]


@pytest.mark.parametrize(("code", "kinds"), [("for (auto x : v) f(x);", "range_for"), ("while (a) b();", "while"), ("do { b(); } while (a);", "do_while"), ("for (;;) ;", "for")])
def test_kinds_of_loops(code, kinds):
    assert [s[4] for s in T.parse("int main() { " + code + " }", False)[1] if s[0] == "LOOP"] == [kinds]


def test_c_declarations_count_twice_with_a_value():
    assert names("int f() { int x = 0; }", False) == ["FUNC_DEF", "VAR_DECL", "INIT_ZERO", "TYPE", "VAR_DECL", "INIT_ZERO", "ID", "NUM", "FUNC_END"]


def test_calls_and_forms():
    got = names("void f() { s.append(c.charAt(i)); a[i] == b; x -= 2; y--; throw e; }")
    for t in ("ACCUM_APPEND", "CHAR_ACCESS", "EQ_TEST", "ARRAY_READ", "ACCUM_SUB", "DECREMENT", "THROW"):
        assert t in got


@pytest.mark.parametrize("bad", ["", "{" * 5000, "(" * 20000, "a<" * 10000, "if(x)" * 5000, "int x = " + "1+" * 9000 + "1;", "/*" * 9000, '"' * 999, "int a = {" + "1," * 9000 + "1};", "}" * 999])
def test_any_text_ends(bad):
    T.parse(bad, True)
    T.parse(bad, False)


def test_comments(spark):
    source = 'a // x\n/* y\n z */ b "//no"\n// only\nc'
    assert T.visible_lines(source) == [(1, "a"), (3, ' b "//no"'), (5, "c")]
    got = spark.createDataFrame([(source,), ("/**/a/*\n\n*/b",), (None,)], "s string").select(strip_comments(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in got] == ['a \n\n b "\n\nc', "a\n\nb", None]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("zips")
    nested = zipped({"project.zip": zipped({"Main.java": TWO}), "__MACOSX/._Main.java": b"x", "notes.txt": "no"})
    for name, data in {"s1": zipped({"src/Main.java": ONE}), "s2": nested, "s3": zipped({"Main.java": OTHER}), "s4": b"no archive", "s5": zipped({}), "_ref_r1": zipped({"Main.java": ONE})}.items():
        place = root / "refs" if name.startswith("_ref_") else root
        place.mkdir(exist_ok=True)
        (place / f"{name.removeprefix('_ref_')}.zip").write_bytes(data)
    return str(root)


def everything(spark, folder):
    return A.files_of(A.archives(spark, folder).unionByName(A.archives(spark, f"{folder}/refs", A.REF)))


def test_archives(spark, folder):
    files = everything(spark, folder)
    got = {(r["submission_id"], r["path"], r["damaged"]) for r in files.collect()}
    assert got == {("s1", "src/Main.java", False), ("s2", "project/Main.java", False), ("s2", "notes.txt", False), ("s3", "Main.java", False), ("s4", None, True), ("s5", None, False), ("_ref_r1", "Main.java", False)}
    assert {r["submission_id"]: r["has_source"] for r in A.has_source_files(files).collect()} == {"s1": True, "s2": True, "s3": True, "s4": False, "s5": False, "_ref_r1": True}
    assert {r["submission_id"] for r in A.sources(files).collect()} == {"s1", "s2", "s3", "_ref_r1"}
    wanted = spark.createDataFrame([("s1", "Main.java"), ("s1", "src/Main.java"), ("s1", "No.java")], "submission_id string, path string")
    assert {r["path"]: r["text"] for r in A.lookup_source(wanted, A.sources(files)).collect()} == {"Main.java": ONE, "src/Main.java": ONE, "No.java": ""}
    assert {r["name"] for r in A.listing(spark, folder).collect()} >= {"s1.zip", "s4.zip"}


def test_depth_guard():
    data = zipped({"A.java": "x"})
    for i in range(4):
        data = zipped({f"l{i}.zip": data})
    assert [p for p, _ in A.unpacked(data)] == ["l3/l2/l1/l0/A.java"] and A.unpacked(data, 1) == []


def test_reference_trees(spark):
    uploads = {
        "root": zipped({"A.java": "a", "read.me": "b"}), "folders": zipped({"x/A.java": "a", "y/deep/B.cpp": "b", "z/no.txt": "c", "Root.java": "d"}), "inner": zipped({"batch/one.zip": zipped({"A.java": "a"}), "batch/B.java": "b", "two.zip": zipped({"t.txt": "n"})}),
        "mac": zipped({"__MACOSX/._A.java": "a", ".hidden/A.java": "b"}), "deep": zipped({"all.zip": zipped({"p.zip": zipped({"P.c": "p"}), "q/Q.h": "q"})}), "bad": b"no",
    }
    rows = spark.createDataFrame(list(uploads.items()), "submission_id string, content binary")
    got = sorted((r["submission_id"], r["path"]) for r in A.reference_trees(rows).collect())
    assert got == [("_ref_one", "A.java"), ("_ref_p", "P.c"), ("_ref_q", "Q.h"), ("_ref_root", "A.java"), ("_ref_root", "read.me"), ("_ref_x", "A.java"), ("_ref_y", "deep/B.cpp")]
    assert {r["submission_id"]: r["student_count"] for r in A.student_count(A.files_of(rows)).collect()}["folders"] == 4


def submitted(spark, files):
    rows = spark.createDataFrame([(s, "Main.java", True, t) for s, t in files.items()], "submission_id string, path string, java boolean, text string")
    return A.tokenised_sources(rows)


def test_run_finds_renamed_copies(spark, folder):
    report = engine.run(A.tokenised_sources(A.sources(everything(spark, folder))))
    pairs = {(r["submission_id_a"], r["submission_id_b"]): r for r in report.pairs.collect()}
    assert set(pairs) >= {("_ref_r1", "s1"), ("_ref_r1", "s2"), ("s1", "s2")}
    assert pairs["s1", "s2"]["similarity"] == 1.0 and pairs["s1", "s2"]["severity"] == "HIGH"
    meta = report.metadata.first()
    assert (meta["students"], meta["references"], meta["possible_pairs"]) == (3, 1, 6)
    blocks = [r for r in report.blocks.collect() if (r["submission_id_a"], r["submission_id_b"]) == ("s1", "s2")]
    assert [b["type"] for b in blocks] == ["FILE"] and blocks[0]["confidence"] == "HIGH"
    shown = [r for r in report.highlights.collect() if r["owner"] == "s2"]
    assert all("project/Main.java" in r["files"] for r in shown)


def test_reference_policy(spark):
    only = engine.run(submitted(spark, {"_ref_a": ONE, "_ref_b": TWO})).metadata.first()
    assert (only["students"], only["references"], only["flagged"]) == (2, 0, 1)
    mixed = engine.run(submitted(spark, {"s": ONE, "_ref_a": TWO, "_ref_b": ONE}))
    assert {(r["submission_id_a"], r["submission_id_b"]) for r in mixed.scores.collect()} == {("_ref_a", "s"), ("_ref_b", "s")}
    assert engine.run(submitted(spark, {"s": ONE})).metadata.first()["flagged"] == 0


def test_boilerplate_and_other_code(spark):
    templates = submitted(spark, {"t": ONE})
    assert engine.run(submitted(spark, {"a": ONE, "b": TWO}), templates).metadata.first()["candidates"] == 0
    far = engine.run(submitted(spark, {"a": ONE, "b": OTHER})).scores.collect()
    assert all(r["similarity"] < 0.8 for r in far)


def block(a, b, type_, hashes, matches=1, kinds=((), ())):
    return ("p", "q", "F", "F", type_, *a, *b, hashes, matches, None, None, None, None, list(kinds[0]), list(kinds[1]))


BLOCKS = "doc_id_a string, doc_id_b string, file_a string, file_b string, type string, from_a int, to_a int, from_b int, to_b int, hash_count long, raw_match_count long, name_a string, name_b string, parent_a string, parent_b string, kinds_a array<string>, kinds_b array<string>"


def test_loops_are_absorbed(spark):
    rows = [block((1, 10), (1, 12), "METHOD", 4), block((3, 6), (4, 8), "LOOP", 2, 3, (("for",), ("while",))), block((20, 25), (4, 8), "LOOP", 5)]
    got = sorted((r["type"], r["from_a"], r["hash_count"], r["raw_match_count"], tuple(r["kinds_a"]), tuple(r["kinds_b"])) for r in B.absorb_loops(spark.createDataFrame(rows, BLOCKS)).collect())
    assert got == [("LOOP", 20, 5, 1, (), ()), ("METHOD", 1, 6, 4, ("for",), ("while",))]
    whole = B.with_confidence(B._lengths(B.absorb_loops(spark.createDataFrame(rows, BLOCKS)))).where("type = 'METHOD'").first()
    assert whole["confidence"] == "MEDIUM"  # dense enough for HIGH, but loops of different kinds


def test_greedy_choice_is_that_of_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = {}
    for _ in range(60):
        a, b = rng.randrange(0, 60, 6), rng.randrange(0, 60, 6)
        rows[a, b] = block((a, a + 5), (b, b + 4 + a % 3), "METHOD", rng.randrange(2, 7))
    strong = B.strong(B._lengths(spark.createDataFrame(list(rows.values()), BLOCKS)))
    all_of = [r.asDict() for r in strong.collect()]
    best = {}
    for r in all_of:
        for u in (("a", r["from_a"], r["to_a"]), ("b", r["from_b"], r["to_b"])):
            best[u] = max(best.get(u, -9), r["score"])
    used, want = set(), []
    for r in sorted(all_of, key=lambda r: (-r["score"], -r["hash_count"], abs(r["length_a"] - r["length_b"]), r["from_a"], r["from_b"], r["to_a"], r["to_b"])):
        units = (("a", r["from_a"], r["to_a"]), ("b", r["from_b"], r["to_b"]))
        if not any(u in used for u in units) and all(r["score"] >= best[u] - 0.08 for u in units):
            used.update(units)
            want.append((r["from_a"], r["from_b"], r["to_b"]))
    assert sorted((r["from_a"], r["from_b"], r["to_b"]) for r in B.one_to_one(strong).collect()) == sorted(want)


def test_compatible_units(spark):
    kinds = ["METHOD", "LOOP", "IF", "SWITCH", "CLASS", None]
    rows = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "a string, b string")
    no = {(r["a"], r["b"]) for r in rows.where(~B.compatible(F.col("a"), F.col("b"))).collect()}
    assert no == {(a, b) for a in kinds[:5] for b in kinds[:5] if a != b and ("CLASS" in (a, b) or {a, b} == {"IF", "SWITCH"})}


def test_sinks(spark, tmp_path):
    good = engine.run(submitted(spark, {"a": ONE, "b": TWO}))
    assert sinks.persist(spark, str(tmp_path), "r1", "a1", "c1", lambda: good) == "completed"
    assert sinks.persist(spark, str(tmp_path), "r2", "a1", "c1", lambda: 1 / 0) == "failed"
    runs = {r["run_id"]: r for r in sinks.runs(spark, str(tmp_path)).collect()}
    assert runs["r1"]["error"] is None and "division" in runs["r2"]["error"]
    assert [r["run_id"] for r in sinks.part(spark, str(tmp_path), "pairs").collect()] == ["r1"]
    subs = spark.createDataFrame([("x", 1, "s1"), ("x", 3, "s2"), ("x", 2, "s3")], "assignment string, at int, id string")
    files = spark.createDataFrame([("s1", "A.java", b"1"), ("s2", "B.java", b"2")], "id string, path string, content binary")
    sinks.export(sinks.numbered_folders(subs, files, "assignment", "at", "id"), f"{tmp_path}/out")
    assert {(r["folder"], r["path"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("Submission_01", "B.java"), ("Submission_03", "A.java")}
    assert [r["id"] for r in sinks.rewritten(subs, subs.where("at > 1"), ["id"]).collect()] == ["s1"]


def test_stream(spark, tmp_path):
    schema = "student string, at int, id int"
    for i, rows in enumerate([[("a", 1, 1), ("b", 5, 2)], [("a", 3, 3), ("b", 4, 4), ("a", 3, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = ingest.latest(stream, ["student"], "at", "id").writeStream.outputMode("complete").format("memory").queryName("latest_rows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r["student"], r["id"]) for r in spark.table("latest_rows").collect()} == {("a", 5), ("b", 2)}
    ingest.append_prints(stream, lambda b: b.selectExpr("student", "id * 2 as print"), f"{tmp_path}/prints", f"{tmp_path}/ck").awaitTermination(60)
    assert sorted(r["print"] for r in spark.read.parquet(f"{tmp_path}/prints").collect()) == [2, 4, 6, 8, 10]


def test_code_queries(spark):
    """What is read back from the archives on disk is what the conversations' texts give."""
    import hashlib

    from sievemark.plans import code_queries as Q

    sf = "/root/testdata/sf0.001"
    got = {n: f(spark, sf).collect() for n, f in Q.QUERIES.items()}
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append(r["text"])
    want, damaged = {}, set()
    for key, texts in turns.items():
        if key % 97 == 0:
            damaged.add(f"c{key}")
            continue
        java = key % 3 != 2
        parts = "\n".join(Q.function(f"f{i}", t or "", java) for i, t in enumerate(texts))
        source = f"public class C{key} {{\n{parts}\n}}\n" if java else f"#include <string>\n{parts}\n"
        tokens, spans = T.parse(source, java)
        path = ("project/" if key % 5 == 0 else "") + ("src/Main.java" if java else "main.cpp")
        want[f"c{key}", path] = (len(tokens), len(spans), hashlib.md5(" ".join(t for t, _ in tokens).encode()).hexdigest())
        assert sum(s[0] == "METHOD" for s in spans) == len(texts)
    assert {(r["submission_id"], r["path"]): (r["n_tokens"], r["n_spans"], r["tokens_md5"]) for r in got["code_tokens"]} == want
    assert {r["submission_id"] for r in got["zip_ingest"] if r["damaged"]} == damaged and {r["submission_id"] for r in got["zip_ingest"]} == {f"c{k}" for k in turns}
    assert {p for _, p in want} == {"src/Main.java", "main.cpp", "project/src/Main.java", "project/main.cpp"} and len({v[2] for v in want.values()}) > len(want) / 2
    assert {r["submission_id"] for r in got["code_fingerprints"]} <= {s for s, _ in want} and all(r["start"] <= r["end"] for r in got["code_fingerprints"])


def test_intermediates_are_removed(spark):
    import os

    from sievemark.sources import stored as X

    X.release(spark)
    kept = X.stored(spark.range(3), "some")
    place = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 3 and os.path.isdir(place)
    assert X.release(spark) == 1 and not os.path.exists(place) and X.release(spark) == 0
