"""Queries of reports and their exploration, over orders as runs and line items as pairs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.functions import scalars
from sievemark.operators import blocks as B
from sievemark.operators import explore as X

#: The moment that stands for now.
NOW = "1998-06-01 12:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A number for each line item: its line, part, supplier and quantity.
_LINE = "((cast(l_linenumber as bigint) * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + cast(l_quantity as bigint)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    done = F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 48 as int), 0, 0)")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 200).alias("assignment_id"), (F.col("o_custkey") % 25).alias("course_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), done.alias("completed_at"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("_ref_"), F.col("l_suppkey").cast("string"))).otherwise(F.col("l_suppkey").cast("string"))
    blocks = F.col("l_quantity").cast("long")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.expr(_LINE).alias("line"), first.alias("student_1"), F.col("l_partkey").cast("string").alias("student_2"),
        (F.col("l_discount") * 10).alias("similarity"), F.round(F.col("l_tax") * 12, 4).alias("severity_score"), blocks.alias("total_blocks"), (blocks % 5).alias("high_blocks"), F.round(F.col("l_discount") * 7, 3).alias("avg_density"),
    )


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 3
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pair"), F.expr(_LINE).alias("block_id"), F.concat(F.lit("src/F"), (F.col("l_suppkey") % 40).cast("string")).alias("file_a"), F.concat(F.lit("f"), (F.col("l_partkey") % 40).cast("string")).alias("file_b"),
        start.alias("start_a"), (start + F.col("l_quantity").cast("int") % 7).alias("end_a"), F.when(F.col("l_discount") >= 0.08, "FILE").when(F.col("l_discount") >= 0.05, "HIGH").when(F.col("l_discount") >= 0.02, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


def _latest(runs: DataFrame, by: str, at: str) -> DataFrame:
    others = [c for c in runs.columns if c != by]
    return runs.groupBy(by).agg(F.max_by(F.struct(*others), F.struct(at, "run_id")).alias("r")).select(by, *[F.col(f"r.{c}").alias(c) for c in others])


def _flagged_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("run_id").agg(F.count("*").alias("pairs_flagged"), F.max("severity_score").alias("top"))


def _recent(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    runs = _runs(spark, sf_dir).orderBy(F.desc("started_at"), "run_id").limit(n)  # a top-n report
    pairs = _pairs(spark, sf_dir).join(F.broadcast(runs.select("run_id")), "run_id", "left_semi")
    return F.broadcast(runs).join(_flagged_of(pairs), "run_id", "left").withColumns({"pairs_flagged": F.coalesce("pairs_flagged", F.lit(0)), "top_severity": F.round(F.coalesce("top", F.lit(0.0)), 2)})


def recent_five_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _runs(spark, sf_dir).groupBy("assignment_id").agg(F.count("*").alias("submission_count"))
    return _recent(spark, sf_dir, 5).join(counts, "assignment_id").select("run_id", "assignment_id", "status", "pairs_flagged", "top_severity", "submission_count")


def recent_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recent(spark, sf_dir, 20).select("run_id", "status", "pairs_flagged", "top_severity")


def latest_completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(_runs(spark, sf_dir).where("status = 'completed'"), "assignment_id", "completed_at").select("assignment_id", "course_id", "run_id")


def _latest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the latest completed runs; one run for each assignment is broadcast, so that no other pair is moved."""
    return _pairs(spark, sf_dir).join(F.broadcast(latest_completed_runs(spark, sf_dir)), "run_id")


def _dealt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dealt(_pairs(spark, sf_dir), "run_id", _table(spark, sf_dir, "lineitem"))


def _dashboard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.anonymised(X.numbered(_latest_pairs(spark, sf_dir), "run_id", "line"), "run_id")  # numbers and labels are those of a run


def dashboard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard_pairs(spark, sf_dir).select("assignment_id", "pair_id", "student_1", "student_2", "similarity", "severity_score").orderBy(F.desc("severity_score"), "assignment_id", "pair_id")


def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _latest_pairs(spark, sf_dir)
    return pairs.agg(F.count("*").alias("flagged"), F.count_distinct("course_id").alias("courses"), F.count_distinct("assignment_id").alias("assignments"), *[F.count_if(B.level(F.col("severity_score")) == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")])


def course_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per course: pairs by level, the similarities of HIGH and MEDIUM pairs from the top, and whether the course is clean."""
    pairs = _latest_pairs(spark, sf_dir).withColumn("level", B.level(F.col("severity_score")))
    # whole hundredths: one entry for each distinct value, so a course's list is bounded
    tops = lambda x: F.sort_array(F.collect_set(F.when(F.col("level") == x, F.round(F.col("similarity") * 100).cast("int"))), asc=False)
    of = pairs.groupBy("course_id").agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")], F.count("*").alias("total"), *[F.array_join(tops(x).cast("array<string>"), ",").alias(f"{x.lower()}_tops") for x in ("HIGH", "MEDIUM")])
    courses = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("course_id"), "n_name")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = courses.join(of, "course_id", "left")
    return out.select("course_id", "n_name", zero("high"), zero("medium"), zero("low"), zero("total"), F.coalesce("high_tops", F.lit("")).alias("high_tops"), F.coalesce("medium_tops", F.lit("")).alias("medium_tops"), F.col("total").isNull().alias("clean"))


def course_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assignment with its submissions, none included, and the course's total."""
    assignments = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("assignment_id"), (F.col("p_partkey") % 25).alias("course_id"))
    counts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("assignment_id")).agg(F.count("*").alias("n"))
    rows = assignments.join(counts, "assignment_id", "left").withColumn("submissions", F.coalesce("n", F.lit(0)))
    totals = rows.groupBy("course_id").agg(F.sum("submissions").alias("course_total"))
    return rows.join(totals, "course_id").select("course_id", "assignment_id", "submissions", "course_total")


def role_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("role"), (F.col("c_acctbal") >= 0).alias("active"))
    tenants = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return users.join(tenants, "n_nationkey").groupBy("n_regionkey", "role").agg(F.count("*").alias("users"), F.count_if("active").alias("active_users"))


def largest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _pairs(spark, sf_dir).groupBy("run_id").agg(F.sum("total_blocks").alias("size"))
    return size.orderBy(F.desc("size"), "run_id").limit(10)


def stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where((F.col("status") == "running") & (F.col("started_at") < F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 1 hour"))).select("run_id", "assignment_id")


def severity_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    tabs = ("ALL", "HIGH", "MEDIUM", "LOW")
    counts = pairs.agg(*[F.count_if((B.level(F.col("severity_score")) == t) if t != "ALL" else F.lit(True)).alias(t) for t in tabs])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.col(t).alias("n_pairs")) for t in tabs])).alias("x")).select("x.tab", "x.n_pairs")


def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.severity_tab(_pairs(spark, sf_dir), "HIGH").select("run_id", "line", "severity_score")


def dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dashboard_filter(_pairs(spark, sf_dir), "LOW").select("run_id", "line", "similarity")


def threshold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("run_id").agg(F.count_if(F.col("similarity") >= 0.5).alias("above"), F.count_if(F.col("similarity") < 0.5).alias("clear"))


def ranking_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _dealt_pairs(spark, sf_dir).select("run_id", "line", *X.RANKED)
    out = X.rankings(pairs, ["run_id"], "line")
    return out.select("run_id", "line", *[f"{k}_{way}" for k in X.RANKED for way in ("desc", "asc")])


def pair_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.numbered(_pairs(spark, sf_dir), "run_id", "line").select("run_id", "line", "pair_id")


def anonymised_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _dealt_pairs(spark, sf_dir).select("run_id", "line", "student_1", "student_2", "severity_score")
    return X.anonymised(X.numbered(pairs, "run_id", "line"), "run_id").select("run_id", "pair_id", "student_1", "student_2")


def block_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).withColumn("file_a", F.concat("file_a", F.lit("/G"), (F.col("pair") % 97).cast("string")))
    return X.block_frequency(spans).select("pair", "block_id", "others")


def file_pair_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    side = lambda i, mod: rows.select(F.col("l_orderkey").alias("pair"), F.lit(i).alias("side"), F.concat(F.lit("f"), (F.col("l_partkey") % mod).cast("string")).alias("file"), F.expr(_LINE).alias("nth"))
    return X.file_pairs(_spans(spark, sf_dir), side(1, 13).unionByName(side(2, 11))).select("pair", "file_a", "file_b", "place")


def active_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda c: F.collect_list(F.when(F.expr(c), F.col("l_linenumber")))  # noqa: E731  seven lines at most
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair")).agg(X.active_blocks(on("l_returnflag = 'R'"), on("l_discount > 0.05")).alias("ids"))
    return rows.select("pair", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def line_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.line_map(_spans(spark, sf_dir).withColumnsRenamed({"start_a": "start", "end_a": "end"}), ["pair"]).select("pair", "line", "block_id")


def reveal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (orders) with the names of two students; every third customer has no record."""
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    requests = orders.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").cast("string").alias("student_1"), (F.col("o_custkey") + 1).cast("string").alias("student_2"))
    students = customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("student_number"), F.col("c_name").alias("full_name"), F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("email"))
    return X.revealed(requests, students).select("o_orderkey", "name_1", "email_1", "name_2", "email_2")


def submission_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission_01 and so on, by assignment, the latest first; a missing one keeps its number."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("assignment_id"), "o_orderdate", (F.col("o_orderpriority") != "5-LOW").alias("present"))
    number = F.row_number().over(Window.partitionBy("assignment_id").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return rows.withColumn("folder", F.concat(F.lit("Submission_"), F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")))).where("present").select("assignment_id", "o_orderkey", "folder")


def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    rows = _table(spark, sf_dir, "nation").join(gone.withColumn("_gone", F.lit(True)), "n_nationkey", "left")
    return rows.select("n_nationkey", F.when(F.col("_gone"), "inactive").otherwise("active").alias("status"))


def expiry_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses after a sweep: those over 30 days past their end are stamped; the runs that go are counted."""
    runs = _runs(spark, sf_dir)
    ends = runs.groupBy("course_id").agg((F.max("started_at") - F.expr("make_dt_interval(cast(course_id * 20 as int), 0, 0, 0)")).alias("end_date"))
    swept = F.col("end_date") < F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 30 days")
    courses = ends.select("course_id", swept.alias("data_deleted"))
    left = runs.join(courses, "course_id").groupBy("course_id", "data_deleted").agg(F.count("*").alias("runs_before"))
    return left.select("course_id", "data_deleted", "runs_before", F.when(F.col("data_deleted"), 0).otherwise(F.col("runs_before")).alias("runs_after"))


def resolved_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pending requests are approved or denied."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("denied")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", status.alias("before"), (F.col("o_orderkey") % 2 == 0).alias("approve"))
    return rows.select("o_orderkey", "before", F.when(F.col("before") == "pending", F.when(F.col("approve"), "approved").otherwise("denied")).otherwise(F.col("before")).alias("after"))


def local_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)")
    start = scalars.local_time(at)
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalars.term(start, F.date_add(start, 100)).alias("term"))


def local_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)")
    now = scalars.local_time(F.lit(NOW).cast("timestamp"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalars.expiry_status(scalars.local_time(at), now).alias("status"))


def noon_end_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(scalars.noon_of_day(at)).alias("noon"))


def token_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(scalars.token_expiry(due, F.lit(NOW).cast("timestamp"))).alias("expires"))


def encrypted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after encryption and decryption; a damaged value gives null."""
    key = F.lit("0123456789abcdef")
    sealed = F.aes_encrypt(F.col("c_name"), key, F.lit("GCM"))
    opened = lambda c: F.try_aes_decrypt(c, key, F.lit("GCM")).cast("string")
    damaged = F.concat(sealed, F.lit(b"x"))
    return _table(spark, sf_dir, "customer").select("c_custkey", opened(sealed).alias("name"), opened(damaged).isNull().alias("damage_seen"))


def text_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")))
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.readable_on(colour).alias("colour"))


def size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.size_text(F.col("p_partkey") * F.col("p_partkey") * 13).alias("size"))


def source_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Main.java", "a.CPP", "x.h", "readme", "run.py", "lib/b.hh", "c.exe")])
    languages = F.array(*[F.lit(x) for x in ("java", "cpp", "c", "python", "rust")])
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")).alias("name"), F.element_at(languages, (F.col("p_size") % 5 + 1).cast("int")).alias("language"))
    return rows.select("p_partkey", "name", "language", scalars.extension_allowed(F.col("name"), F.col("language")).alias("allowed"))


def file_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("d"), (F.col("l_linenumber") % 2).cast("string"), F.lit("/F"), (F.col("l_linenumber") % 3).cast("string")).alias("file"), F.col("l_partkey").cast("string").alias("hash"))
    return B.file_similarity_of_all(prints)


def hash_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.collect_set(F.when(F.expr(c), F.col("l_partkey")))  # noqa: E731  seven lines at most
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of("l_linenumber <= 4").alias("x"), of("l_linenumber >= 3").alias("y"))
    return rows.select("l_orderkey", F.size(F.array_intersect("x", "y")).cast("long").alias("n_both"), F.size(F.array_union("x", "y")).cast("long").alias("n_any"), F.size(F.array_except("x", "y")).cast("long").alias("n_only_x"))


def unit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation's turns as lines: the unit around turn 2, of spans made from its length."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").cast("int").alias("n"))
    span = lambda t, a, b: F.struct(F.lit(t).alias("type"), F.lit(a).cast("int").alias("start"), b.cast("int").alias("end"), F.lit(None).cast("string").alias("name"), F.lit("for" if t == "LOOP" else None).cast("string").alias("loop_subtype"))
    spans = F.array(span("METHOD", 0, F.col("n")), span("IF", 1, F.col("n") - 1), span("LOOP", 2, F.col("n") - 2), span("LOOP", 1, F.col("n") - 2))
    unit = B.enclosing_unit(F.lit(2), F.lit(3), spans)
    inner = B.enclosing_unit(F.lit(2), F.lit(3), spans, ("METHOD",))
    return turns.select("conv_id", unit["type"].alias("unit_type"), unit["start"].alias("unit_start"), inner["end"].alias("method_end"))


QUERIES = {
    f.__name__: f
    for f in (
        recent_five_runs, recent_analyses, latest_completed_runs, dashboard_pairs, dashboard_counts, course_insights, course_details, role_dashboard, largest_runs, stuck_runs, severity_tabs, severity_filter,
        dashboard_filter, threshold_split, ranking_table, pair_numbers, anonymised_pairs, block_frequency, file_pair_tabs, active_blocks, line_map, reveal_lookup, submission_folders, soft_delete, expiry_stamps,
        resolved_requests, local_terms, local_expiry, noon_end_date, token_expiry, encrypted_names, text_colour, size_text, source_extensions, file_similarity, hash_set_operations, unit_lookup,
    )
}

_LEVEL = "CASE WHEN severity_score >= 0.7 THEN 'HIGH' WHEN severity_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
_RUNS = """ru AS (SELECT o_orderkey AS run_id, o_custkey % 200 AS assignment_id, o_custkey % 25 AS course_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_orderdate AS started_at, o_orderdate + to_hours(o_orderkey % 48) AS completed_at FROM orders)"""
_PAIRS = f"""pr AS (SELECT l_orderkey AS run_id, {_LINE} AS line, CASE WHEN l_linenumber = 3 THEN '_ref_' || l_suppkey ELSE CAST(l_suppkey AS VARCHAR) END AS student_1, CAST(l_partkey AS VARCHAR) AS student_2,
  l_discount * 10 AS similarity, round(l_tax * 12, 4) AS severity_score, CAST(l_quantity AS BIGINT) AS total_blocks, CAST(l_quantity AS BIGINT) % 5 AS high_blocks, round(l_discount * 7, 3) AS avg_density FROM lineitem)"""
_FLAGGED = _PAIRS + ", fl AS (SELECT run_id, count(*) AS n, max(severity_score) AS top FROM pr GROUP BY 1)"
_LATEST = "lc AS (SELECT assignment_id, course_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY assignment_id ORDER BY completed_at DESC, run_id DESC) AS rn FROM ru WHERE status = 'completed') WHERE rn = 1)"
_NAMED = """ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY severity_score DESC, line) - 1 AS idx FROM pr),
se AS MATERIALIZED (SELECT run_id, student, min(spot) AS spot FROM (SELECT run_id, student_1 AS student, idx * 2 AS spot FROM ix UNION ALL SELECT run_id, student_2, idx * 2 + 1 FROM ix) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, starts_with(student, '_ref_') ORDER BY spot) - 1 AS rk FROM se),
la AS MATERIALIZED (SELECT run_id, student, CASE WHEN starts_with(student, '_ref_') THEN 'Ref ' ELSE 'Student ' END || CASE WHEN rk < 26 THEN chr(CAST(65 + rk AS INT)) WHEN starts_with(student, '_ref_') THEN chr(CAST(65 + rk % 26 AS INT)) ELSE chr(CAST(65 + (rk - 26) // 26 AS INT)) || chr(CAST(65 + rk % 26 AS INT)) END AS label FROM rk),
an AS (SELECT ix.*, 'pair_' || idx AS pair_id, a.label AS label_1, b.label AS label_2 FROM ix JOIN la a ON a.run_id = ix.run_id AND a.student = student_1 JOIN la b ON b.run_id = ix.run_id AND b.student = student_2)"""
_SPANS = f"""sp AS (SELECT l_orderkey AS pair, {_LINE} AS block_id, 'src/F' || (l_suppkey % 40) AS file_a, 'f' || (l_partkey % 40) AS file_b, l_linenumber * 3 AS start_a, l_linenumber * 3 + CAST(l_quantity AS INT) % 7 AS end_a,
  CASE WHEN l_discount >= 0.08 THEN 4 WHEN l_discount >= 0.05 THEN 3 WHEN l_discount >= 0.02 THEN 2 ELSE 1 END AS rank FROM lineitem)"""
_ZONED = "z AS (SELECT o_orderkey, ((o_orderdate + to_hours(o_orderkey % 24)) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto' AS s FROM orders)"
_SEASON = "CASE WHEN month({0}) <= 4 THEN 'Winter' WHEN month({0}) <= 7 THEN 'Summer' ELSE 'Fall' END"
_RANKS = ", ".join(f"CAST(row_number() OVER (PARTITION BY run_id ORDER BY {k} {way.upper()}, line) AS INT) AS {k}_{way}" for k in X.RANKED for way in ("desc", "asc"))

SQL = {
    "recent_five_runs": f"""WITH {_RUNS}, {_FLAGGED}, t AS (SELECT * FROM ru ORDER BY started_at DESC, run_id LIMIT 5), c AS (SELECT assignment_id, count(*) AS k FROM ru GROUP BY 1)
SELECT t.run_id, t.assignment_id, status, coalesce(n, 0) AS pairs_flagged, round(coalesce(top, 0), 2) AS top_severity, k AS submission_count FROM t LEFT JOIN fl USING (run_id) JOIN c USING (assignment_id)""",
    "recent_analyses": f"WITH {_RUNS}, {_FLAGGED}, t AS (SELECT * FROM ru ORDER BY started_at DESC, run_id LIMIT 20) SELECT t.run_id, status, coalesce(n, 0) AS pairs_flagged, round(coalesce(top, 0), 2) AS top_severity FROM t LEFT JOIN fl USING (run_id)",
    "latest_completed_runs": f"WITH {_RUNS}, {_LATEST} SELECT assignment_id, course_id, run_id FROM lc",
    "dashboard_pairs": f"WITH {_RUNS}, {_LATEST}, {_PAIRS.replace('FROM lineitem)', 'FROM lineitem SEMI JOIN lc ON lc.run_id = l_orderkey)')}, {_NAMED} SELECT assignment_id, pair_id, label_1 AS student_1, label_2 AS student_2, similarity, severity_score FROM an JOIN lc USING (run_id)",
    "dashboard_counts": f"""WITH {_RUNS}, {_LATEST}, {_PAIRS} SELECT count(*) AS flagged, count(DISTINCT course_id) AS courses, count(DISTINCT assignment_id) AS assignments, count(*) FILTER ({_LEVEL} = 'HIGH') AS high,
  count(*) FILTER ({_LEVEL} = 'MEDIUM') AS medium, count(*) FILTER ({_LEVEL} = 'LOW') AS low FROM pr JOIN lc USING (run_id)""",
    "course_insights": f"""WITH {_RUNS}, {_LATEST}, {_PAIRS}, x AS (SELECT course_id, {_LEVEL} AS lv, CAST(round(similarity * 100) AS INT) AS s FROM pr JOIN lc USING (run_id)),
g AS (SELECT course_id, count(*) FILTER (lv = 'HIGH') AS high, count(*) FILTER (lv = 'MEDIUM') AS medium, count(*) FILTER (lv = 'LOW') AS low, count(*) AS total,
  array_to_string(list_reverse_sort(list(DISTINCT s) FILTER (lv = 'HIGH')), ',') AS high_tops, array_to_string(list_reverse_sort(list(DISTINCT s) FILTER (lv = 'MEDIUM')), ',') AS medium_tops FROM x GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS course_id, n_name, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(total, 0) AS total, coalesce(high_tops, '') AS high_tops, coalesce(medium_tops, '') AS medium_tops,
  total IS NULL AS clean FROM nation LEFT JOIN g ON course_id = n_nationkey""",
    "course_details": """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey % 25 AS course_id, p_partkey AS assignment_id, coalesce(n, 0) AS submissions, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY p_partkey % 25) AS BIGINT) AS course_total FROM part LEFT JOIN c ON l_partkey = p_partkey""",
    "role_dashboard": "SELECT n_regionkey, c_mktsegment AS role, count(*) AS users, count(*) FILTER (c_acctbal >= 0) AS active_users FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "largest_runs": f"WITH {_PAIRS} SELECT run_id, CAST(sum(total_blocks) AS BIGINT) AS size FROM pr GROUP BY 1 ORDER BY size DESC, run_id LIMIT 10",
    "stuck_runs": f"WITH {_RUNS} SELECT run_id, assignment_id FROM ru WHERE status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR",
    "severity_tabs": f"WITH {_PAIRS} SELECT 'ALL' AS tab, count(*) AS n_pairs FROM pr UNION ALL SELECT t, count(*) FILTER ({_LEVEL} = t) FROM pr CROSS JOIN (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) v(t) GROUP BY t",
    "severity_filter": f"WITH {_PAIRS} SELECT run_id, line, severity_score FROM pr WHERE severity_score >= 0.7",
    "dashboard_filter": f"WITH {_PAIRS} SELECT run_id, line, similarity FROM pr WHERE similarity >= 0.4 AND similarity < 0.7",
    "threshold_split": f"WITH {_PAIRS} SELECT run_id, count(*) FILTER (similarity >= 0.5) AS above, count(*) FILTER (similarity < 0.5) AS clear FROM pr GROUP BY 1",
    "ranking_table": f"WITH {_PAIRS} SELECT run_id, line, {_RANKS} FROM pr",
    "pair_numbers": f"WITH {_PAIRS}, {_NAMED} SELECT run_id, line, 'pair_' || idx AS pair_id FROM ix",
    "anonymised_pairs": f"WITH {_PAIRS}, {_NAMED} SELECT run_id, pair_id, label_1 AS student_1, label_2 AS student_2 FROM an",
    "block_frequency": f"""WITH {_SPANS}, q AS (SELECT *, 'g' || (pair % 97) AS name FROM sp)
SELECT a.pair, a.block_id, count(DISTINCT b.pair) AS others FROM q a LEFT JOIN q b ON a.name = b.name AND a.pair <> b.pair AND b.start_a <= a.end_a AND a.start_a <= b.end_a GROUP BY ALL""",
    "file_pair_tabs": f"""WITH {_SPANS}, f1 AS (SELECT l_orderkey AS pair, 'f' || (l_partkey % 13) AS f, {_LINE} AS n FROM lineitem), f2 AS (SELECT DISTINCT l_orderkey AS pair, 'f' || (l_partkey % 11) AS f FROM lineitem),
k AS (SELECT pair, file_b, arg_min(file_a, block_id) AS file_a FROM sp GROUP BY ALL), top AS (SELECT pair, arg_min(f, n) AS f FROM f1 GROUP BY 1),
r AS (SELECT f2.pair, f2.f AS file_b, CASE WHEN EXISTS (SELECT 1 FROM f1 WHERE f1.pair = f2.pair AND f1.f = f2.f) THEN f2.f ELSE top.f END AS file_a FROM f2 ANTI JOIN k ON k.pair = f2.pair AND k.file_b = f2.f JOIN top ON top.pair = f2.pair),
e AS (SELECT pair, file_a, file_b FROM k UNION ALL SELECT pair, file_a, file_b FROM r)
SELECT pair, file_a, file_b, CAST(row_number() OVER (PARTITION BY pair ORDER BY CASE WHEN file_a = file_b THEN 0 ELSE 1 END, file_b) AS INT) AS place FROM e""",
    "active_blocks": """WITH g AS (SELECT l_orderkey AS pair, coalesce(list(l_linenumber) FILTER (l_returnflag = 'R'), []) AS a, coalesce(list(l_linenumber) FILTER (l_discount > 0.05), []) AS b FROM lineitem GROUP BY 1)
SELECT pair, array_to_string(list_sort(CASE WHEN len(list_intersect(a, b)) > 0 THEN list_intersect(a, b) ELSE list_distinct(list_concat(a, b)) END), ',') AS ids FROM g""",
    "line_map": f"WITH {_SPANS}, x AS (SELECT pair, block_id, rank, unnest(range(start_a, end_a + 1)) AS line FROM sp) SELECT pair, CAST(line AS INT) AS line, block_id FROM x QUALIFY row_number() OVER (PARTITION BY pair, line ORDER BY rank DESC, block_id) = 1",
    "reveal_lookup": """WITH s AS (SELECT c_custkey, c_name, lower(c_mktsegment) || '@example.org' AS email FROM customer WHERE c_custkey % 3 <> 0)
SELECT o_orderkey, coalesce(a.c_name, CAST(o_custkey AS VARCHAR)) AS name_1, coalesce(a.email, '') AS email_1, coalesce(b.c_name, CAST(o_custkey + 1 AS VARCHAR)) AS name_2, coalesce(b.email, '') AS email_2
FROM orders LEFT JOIN s a ON a.c_custkey = o_custkey LEFT JOIN s b ON b.c_custkey = o_custkey + 1 WHERE o_orderstatus = 'P'""",
    "submission_folders": """WITH r AS (SELECT o_custkey % 200 AS assignment_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
SELECT assignment_id, o_orderkey, 'Submission_' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 2, '0') ELSE CAST(n AS VARCHAR) END AS folder FROM r WHERE o_orderpriority <> '5-LOW'""",
    "soft_delete": "SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN 'inactive' ELSE 'active' END AS status FROM nation",
    "expiry_stamps": f"""WITH {_RUNS}, e AS (SELECT course_id, max(started_at) - to_days(CAST(course_id * 20 AS INT)) < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS data_deleted, count(*) AS n FROM ru GROUP BY 1)
SELECT course_id, data_deleted, n AS runs_before, CASE WHEN data_deleted THEN 0 ELSE n END AS runs_after FROM e""",
    "resolved_requests": """WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'denied' END AS before FROM orders)
SELECT o_orderkey, before, CASE WHEN before = 'pending' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'denied' END ELSE before END AS after FROM r""",
    "local_terms": f"""WITH {_ZONED}, d AS (SELECT o_orderkey, s, CAST(s AS DATE) + 100 AS e FROM z), t AS (SELECT o_orderkey, {_SEASON.format("s")} AS a, {_SEASON.format("e")} AS b, CAST(year(s) AS VARCHAR) AS y, CAST(year(e) AS VARCHAR) AS z FROM d)
SELECT o_orderkey, CASE WHEN a = b AND y = z THEN a || ' ' || y WHEN y = z THEN a || '/' || b || ' ' || y ELSE a || '/' || b || ' ' || y || '-' || z END AS term FROM t""",
    "local_expiry": f"""WITH {_ZONED}, x AS (SELECT o_orderkey, epoch(date_trunc('day', s)::TIMESTAMP) + 86399 - epoch((TIMESTAMP '{NOW}' AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto') AS d FROM z)
SELECT o_orderkey, CASE WHEN d >= 0 THEN CASE WHEN floor(d / 86400) <= 15 THEN 'expiring_soon' END WHEN floor(-d / 86400) <= 30 THEN 'grace_period' ELSE 'data_deleted' END AS status FROM x""",
    "noon_end_date": f"WITH {_ZONED} SELECT o_orderkey, CAST(epoch((date_trunc('day', s)::TIMESTAMP + INTERVAL 12 HOUR) AT TIME ZONE 'America/Toronto') AS BIGINT) AS noon FROM z",
    "token_expiry": f"SELECT o_orderkey, CAST(epoch(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '{NOW}' + INTERVAL 30 DAY END) AS BIGINT) AS expires FROM orders",
    "encrypted_names": "SELECT c_custkey, c_name AS name, true AS damage_seen FROM customer",
    "text_colour": "WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part) SELECT p_partkey, CASE WHEN 0.299::DOUBLE * (v // 65536) + 0.587::DOUBLE * (v // 256 % 256) + 0.114::DOUBLE * (v % 256) < 140 THEN '#ffffff' ELSE '#000000' END AS colour FROM c",
    "size_text": """WITH s AS (SELECT p_partkey, p_partkey * p_partkey * 13 AS v FROM part)
SELECT p_partkey, CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1048576 THEN CAST(round(v / 1024, 1) AS DECIMAL(18, 1)) || ' KB' ELSE CAST(round(v / 1048576, 1) AS DECIMAL(18, 1)) || ' MB' END AS size FROM s""",
    "source_extensions": """WITH x AS (SELECT p_partkey, ['Main.java', 'a.CPP', 'x.h', 'readme', 'run.py', 'lib/b.hh', 'c.exe'][p_partkey % 7 + 1] AS name, ['java', 'cpp', 'c', 'python', 'rust'][p_size % 5 + 1] AS language FROM part),
y AS (SELECT *, lower(regexp_extract(name, '[.][^.]*$')) AS e FROM x)
SELECT p_partkey, name, language, e = '' OR CASE language WHEN 'java' THEN e = '.java' WHEN 'cpp' THEN e IN ('.cpp', '.cc', '.cxx', '.h', '.hpp', '.hh', '.hxx') WHEN 'c' THEN e IN ('.c', '.h') WHEN 'python' THEN e = '.py' ELSE false END AS allowed FROM y""",
    "file_similarity": """WITH p AS MATERIALIZED (SELECT DISTINCT l_orderkey AS doc_id, 'd' || (l_linenumber % 2) || '/F' || (l_linenumber % 3) AS file, 'f' || (l_linenumber % 3) AS name, l_partkey AS hash FROM lineitem),
z AS (SELECT doc_id, file, name, count(*) AS n FROM p GROUP BY ALL),
f AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY file) = 1),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM p a JOIN p b ON a.hash = b.hash AND a.doc_id < b.doc_id),
s AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, a.file AS file_a, b.file AS file_b, count(*) AS shared FROM p a JOIN p b ON a.hash = b.hash AND a.name = b.name AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT c.doc_id_a, c.doc_id_b, x.file AS file_a, y.file AS file_b, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 3) AS similarity FROM c JOIN z x ON x.doc_id = c.doc_id_a JOIN f y ON y.doc_id = c.doc_id_b AND x.name = y.name
LEFT JOIN s ON s.doc_id_a = c.doc_id_a AND s.doc_id_b = c.doc_id_b AND s.file_a = x.file AND s.file_b = y.file""",
    "hash_set_operations": """WITH g AS (SELECT l_orderkey, list_distinct(coalesce(list(l_partkey) FILTER (l_linenumber <= 4), [])) AS x, list_distinct(coalesce(list(l_partkey) FILTER (l_linenumber >= 3), [])) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(list_intersect(x, y)) AS BIGINT) AS n_both, CAST(len(list_distinct(list_concat(x, y))) AS BIGINT) AS n_any, CAST(len(x) - len(list_intersect(x, y)) AS BIGINT) AS n_only_x FROM g""",
    "unit_lookup": """WITH t AS (SELECT conv_id, CAST(max(turn) AS INT) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n >= 5 THEN 'LOOP' WHEN n >= 3 THEN 'METHOD' END AS unit_type, CASE WHEN n >= 5 THEN 2 WHEN n >= 3 THEN 0 END AS unit_start, CASE WHEN n >= 3 THEN n END AS method_end FROM t""",
}
