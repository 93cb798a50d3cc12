"""Reading a report: filters, rankings, anonymous labels, tabs, frequencies and line maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark import params as P
from sievemark.functions.scalars import anon_label, basename
from sievemark.operators.blocks import level

RANKED = ("severity_score", "similarity", "total_blocks", "high_blocks", "avg_density")
#: Bytes of a table's files for each task that sorts the pairs of runs; a row is there some ten times as wide.
RUN_BYTES = 1 << 20
CONFIDENCE_RANK = {"FILE": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def severity_tab(pairs: DataFrame, tab: str) -> DataFrame:
    """Pairs of one tab: ALL, HIGH, MEDIUM or LOW, by severity."""
    return pairs if tab == "ALL" else pairs.where(level(F.col("severity_score")) == tab)


def dashboard_filter(pairs: DataFrame, choice: str = "ALL") -> DataFrame:
    """Pairs similar enough for the dashboard; HIGH and LOW go by similarity too."""
    value = F.col("similarity")
    extra = {"HIGH": value >= P.SEVERITY_HIGH, "LOW": (value >= P.SEVERITY_MEDIUM) & (value < P.SEVERITY_HIGH)}.get(choice, F.lit(True))
    return pairs.where((value >= P.DASHBOARD_SIMILARITY) & extra)


def dealt(rows: DataFrame, run: str, source: DataFrame) -> DataFrame:
    """rows dealt once by run, over a part for each RUN_BYTES of the source table's files, so that a task's sorts do not grow with the input."""
    expected = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(source.sparkSession.sparkContext.defaultParallelism, -(-expected // RUN_BYTES)), run)


def rankings(pairs: DataFrame, within: list[str], tie: str) -> DataFrame:
    """pairs with the place of each by every key of RANKED, from the top (key_desc) and the bottom (key_asc); nulls are the least.

    Both places come from one sort: from the top, a pair stands behind those above its value and the equal ones with a smaller tie.
    """
    of = Window.partitionBy(*within)
    out = pairs
    for k in RANKED:
        equal = of.orderBy(k)  # rows that are sorted by value and tie are in this order too
        upto = F.count("*").over(equal.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn(f"{k}_asc", F.row_number().over(of.orderBy(k, tie))).withColumns({f"_upto_{k}": upto, f"_least_{k}": F.rank().over(equal)})
    out = out.withColumn("_n", F.count("*").over(of))
    top = {f"{k}_desc": (F.col("_n") - F.col(f"_upto_{k}") + F.col(f"{k}_asc") - F.col(f"_least_{k}") + 1).cast("int") for k in RANKED}
    return out.withColumns(top).drop("_n", *[f"_{x}_{k}" for x in ("upto", "least") for k in RANKED])


def numbered(pairs: DataFrame, run: str, tie: str) -> DataFrame:
    """pairs with pair_index (from 0, most severe first) and pair_id."""
    index = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("severity_score"), tie)) - 1
    return pairs.withColumn("pair_index", index).withColumn("pair_id", F.concat(F.lit("pair_"), F.col("pair_index").cast("string")))


def anonymised(pairs: DataFrame, run: str) -> DataFrame:
    """numbered pairs with labels in place of students: by first appearance Student A, B, ... and, for references, Ref A to Z over again.

    Each pair has a row for each side; all steps go by run, so rows that are dealt by run are not moved again. A side without a name keeps it.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("side"), (F.col("pair_index") * 2 + i).alias("at"), F.col(c).alias("student")) for i, c in enumerate(("student_1", "student_2"))])
    others = [c for c in pairs.columns if c not in (run, "pair_index", "student_1", "student_2")]
    rows = pairs.select(run, "pair_index", F.struct(*others).alias("_others"), F.explode(sides).alias("x")).select(run, "pair_index", "_others", "x.*")
    named = F.coalesce(F.col("student") != "", F.lit(False))
    rows = rows.withColumns({"_kind": F.when(named, F.startswith("student", F.lit("_ref_")).cast("int")).otherwise(2), "_others": F.when(F.col("side") == 0, F.col("_others"))})
    rows = rows.withColumn("_first", F.min("at").over(Window.partitionBy(run, "student")))
    rank = F.dense_rank().over(Window.partitionBy(run, "_kind").orderBy("_first")) - 1  # a student has one first place, which no other has
    rows = rows.withColumn("_rank", rank)
    label = F.when(F.col("_kind") == 1, F.concat(F.lit("Ref "), F.chr(65 + F.pmod(F.col("_rank"), F.lit(26))))).when(F.col("_kind") == 0, anon_label(F.col("_rank"))).otherwise(F.col("student"))
    back = rows.withColumn("_label", label)
    both = Window.partitionBy(run, "pair_index").orderBy("side")
    back = back.withColumn("_second", F.lead("_label").over(both)).where("side = 0")
    return back.select(*[F.col("_label").alias(c) if c == "student_1" else F.col("_second").alias(c) if c == "student_2" else F.col(f"_others.{c}").alias(c) if c in others else F.col(c) for c in pairs.columns])


#: Slices of a file's lines, and the least lines of one.
SLICES, SLICE_LINES = 32, 64
#: What lies before every line and behind every line.
BEFORE, BEHIND = -(1 << 31), 1 << 31


def _gaps(spans: DataFrame) -> DataFrame:
    """name, x, y: for each pair and name the stretches without a block of it, after line x and before line y."""
    within = Window.partitionBy("pair", "name").orderBy("start_a", "end_a")
    reached = F.coalesce(F.max("end_a").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(BEFORE))
    inner = spans.select("pair", "name", "start_a", reached.cast("long").alias("x")).where("start_a > x + 1").select("name", "x", F.col("start_a").cast("long").alias("y"))
    last = spans.groupBy("pair", "name").agg(F.max("end_a").cast("long").alias("x")).select("name", "x", F.lit(BEHIND).cast("long").alias("y"))
    return inner.unionByName(last)


def _held_within(batch: pa.Table) -> pa.Table:
    """For the questions (kind 2) of one slice of a name: how many gaps (kind 1, and 0 for those that begin before the slice) hold lines x to y."""
    kind, x, y, n = (batch.column(c).to_numpy() for c in ("kind", "x", "y", "n"))
    ends, at = np.unique(y[kind != 2], return_inverse=True)
    gaps_x, gaps_n = x[kind != 2], n[kind != 2]
    gaps_x = np.where(kind[kind != 2] == 0, np.iinfo(np.int64).min, gaps_x)
    order = np.argsort(gaps_x, kind="stable")
    gaps_x, gaps_n, at = gaps_x[order], gaps_n[order], at[order]
    asked_x, asked_y = x[kind == 2], y[kind == 2]
    out, so_far, done = np.zeros(len(asked_x), np.int64), np.zeros(len(ends) + 1, np.int64), 0
    for start in np.unique(asked_x):  # the lines of a slice
        upto = np.searchsorted(gaps_x, start)
        np.add.at(so_far, at[done:upto], gaps_n[done:upto])
        done = upto
        here = asked_x == start
        longer = so_far[::-1].cumsum()[::-1]
        out[here] = longer[np.searchsorted(ends, asked_y[here], side="right")]
    name = pa.array([batch.column("name")[0].as_py()] * len(out), pa.string())
    return pa.table({"name": name, "x": pa.array(asked_x, pa.int64()), "y": pa.array(asked_y, pa.int64()), "held": pa.array(out, pa.int64())})


def block_frequency(blocks: DataFrame) -> DataFrame:
    """blocks (pair, block_id, file_a, start_a, end_a) with the number of other pairs that have a block over the same lines of an equally named file.

    Pairs are not joined with pairs. A pair has no block over lines s to e where a gap between its blocks holds them all, so the
    others are all pairs of that name but one, less the gaps with x < s and y > e. Equal gaps and equal questions (name, s, e) are counted
    first, and a name's lines are cut into SLICES: a slice gets the gaps that begin in it, those before it by
    their ends only, and its questions. What moves grows with the blocks, and a group with the lines of a file, however many pairs share it.
    """
    spans = blocks.select("pair", basename(F.col("file_a")).alias("name"), "start_a", "end_a").where("name is not null")
    gaps = _gaps(spans).groupBy("name", "x", "y").agg(F.count("*").alias("n"))
    asked = spans.groupBy("name", F.col("start_a").cast("long").alias("x"), F.col("end_a").cast("long").alias("y")).agg(F.count("*").alias("n"))
    of_name = spans.groupBy("name").agg(F.max("start_a").cast("long").alias("lines"))
    pairs = spans.select("pair", "name").distinct().groupBy("name").agg(F.count("*").alias("pairs"))
    width = F.greatest(F.lit(SLICE_LINES), F.ceil((F.col("lines") + 1) / SLICES))
    sliced = lambda df: df.join(of_name, "name").withColumn("slice", F.greatest(F.lit(0), F.floor(F.col("x") / width)))
    gaps, asked = sliced(gaps).where("x < lines").drop("lines"), sliced(asked).drop("lines")  # a gap behind all questions holds none
    later = asked.select("name", F.col("slice").alias("to")).distinct()  # SLICES for each name at most
    before = gaps.groupBy("name", "slice", "y").agg(F.sum("n").alias("n")).join(later, "name").where("slice < to")
    before = before.groupBy("name", F.col("to").alias("slice"), "y").agg(F.sum("n").alias("n"))
    row = lambda df, kind, x: df.select("name", "slice", F.lit(kind).alias("kind"), x.cast("long").alias("x"), "y", F.col("n").cast("long").alias("n"))
    every = row(before, 0, F.lit(0)).unionByName(row(gaps, 1, F.col("x"))).unionByName(row(asked, 2, F.col("x")))
    held = every.groupBy("name", "slice").applyInArrow(_held_within, "name string, x long, y long, held long")
    counts = held.join(pairs, "name").select("name", "x", "y", (F.col("pairs") - 1 - F.col("held")).alias("others"))
    keyed = blocks.withColumns({"name": basename(F.col("file_a")), "x": F.col("start_a").cast("long"), "y": F.col("end_a").cast("long")})
    return keyed.join(counts, ["name", "x", "y"], "left").select(*blocks.columns, F.coalesce("others", F.lit(0)).alias("others"))  # a block without a file meets none


def file_pairs(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Per pair the tabs (file_a, file_b, place): each file_b with the file_a of its first block; of files (pair, side, file, nth)
    the second side's others with the equally named, else the first file of the first side. Same names first, then by file_b.
    """
    known = blocks.where("file_b <> ''").groupBy("pair", "file_b").agg(F.min_by("file_a", "block_id").alias("file_a"))
    first, second = files.where("side = 1"), files.where("side = 2")
    rest = second.select("pair", F.col("file").alias("file_b")).distinct().join(known.select("pair", "file_b"), ["pair", "file_b"], "left_anti")
    same = first.select("pair", F.col("file").alias("file_b"), F.col("file").alias("same")).distinct()
    top = first.groupBy("pair").agg(F.min_by("file", "nth").alias("top"))
    rest = rest.join(same, ["pair", "file_b"], "left").join(top, "pair", "left").select("pair", "file_b", F.coalesce("same", "top", F.lit("")).alias("file_a"))
    every = known.unionByName(rest)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy(F.when(F.col("file_a") == F.col("file_b"), 0).otherwise(1), "file_b")))


def course_filter(courses: DataFrame, term: str = "all", search: str = "") -> DataFrame:
    """Courses of one term, or of all, whose code or title holds what is searched, whatever its case."""
    found = F.lower("code").contains(search.lower()) | F.lower("title").contains(search.lower())
    return courses.where((F.col("term") == term if term != "all" else F.lit(True)) & (found if search else F.lit(True)))


def with_term_order(terms: DataFrame) -> DataFrame:
    """terms with year and place: newer years come first, within one Spring, Summer, Fall, Winter and others in this order; a term without a year has year 0."""
    words = F.split("term", " ")
    season = F.lower(words[0])
    place = F.when(season == "spring", 1).when(season == "summer", 2).when(season == "fall", 3).when(season == "winter", 4).otherwise(5)
    year = F.coalesce(F.regexp_extract(F.coalesce(F.get(words, F.lit(1)), F.lit("")), "^[0-9]+", 0).try_cast("int"), F.lit(0))
    return terms.withColumns({"year": year, "place": place})


def active_blocks(of_a: Column, of_b: Column) -> Column:
    """The block ids of a tab: those on both sides, or where there are none those on either."""
    both = F.array_intersect(of_a, of_b)
    return F.array_sort(F.when(F.size(both) > 0, both).otherwise(F.array_union(of_a, of_b)))


def line_map(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Per line the block that shows there: that of the highest confidence, the first of several."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv]), F.col("confidence"))
    lines = blocks.select(*keys, "block_id", rank.alias("rank"), F.explode(F.sequence("start", "end")).alias("line"))
    return lines.groupBy(*keys, "line").agg(F.max_by("block_id", F.struct("rank", (-F.col("block_id")).alias("first"))).alias("block_id"))


def revealed(requests: DataFrame, students: DataFrame) -> DataFrame:
    """Requests with names and addresses of both students; an unknown one keeps its id and has no address."""
    for i in (1, 2):
        one = students.select(F.col("student_number").alias(f"student_{i}"), F.col("full_name").alias("_name"), F.col("email").alias("_email"))
        requests = requests.join(one, f"student_{i}", "left").withColumns({f"name_{i}": F.coalesce("_name", f"student_{i}"), f"email_{i}": F.coalesce("_email", F.lit(""))}).drop("_name", "_email")
    return requests
