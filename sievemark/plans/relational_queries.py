"""Queries around the analysis: latest rows, dashboards, terms, expiry and text rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.functions import scalars
from sievemark.operators import explore as X
from sievemark.operators.blocks import level

#: The moment that stands for now.
NOW = "1998-06-01 12:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key: an aggregate that combines before its shuffle, so hot keys cost little."""
    others = [c for c in rows.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.struct(at, tie))
    return rows.groupBy(*keys).agg(row.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def latest_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return latest(rows, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


def submissions_per_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_partkey").alias("assignment_id")).agg(F.count("*").alias("n_submissions"), F.count_distinct("l_orderkey").alias("n_students"))


def instructor_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    score = F.col("o_totalprice") / 500000
    runs = orders.select(F.col("o_custkey").alias("c_custkey"), level(score).alias("level"))
    counts = runs.groupBy("c_custkey").agg(F.count("*").alias("n"), *[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")])
    joined = customer.select("c_custkey", "c_mktsegment").join(counts, "c_custkey", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("courses"), zero("n").alias("submissions"), zero("high").alias("high"), zero("medium").alias("medium"), zero("low").alias("low"))


def course_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer.select("c_custkey", "c_nationkey"), orders["o_custkey"] == customer["c_custkey"])
    counts = rows.groupBy("c_nationkey").agg(F.count_if(level(F.col("o_totalprice") / 500000) == "HIGH").alias("high"), F.count("*").alias("total"))
    out = nation.join(counts, nation["n_nationkey"] == counts["c_nationkey"], "left")
    return out.select("n_name", F.coalesce("high", F.lit(0)).alias("high"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.col("high") > 0, F.lit(False)).alias("flagged"))


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    top = rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return top.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("max_severity"))


def submission_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n_files"), F.sum(F.col("l_quantity").cast("long")).alias("total_size"))


def severity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy(level(F.col("l_discount") * 10).alias("level")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return rows.select("level", "n", F.round(F.col("n") / total, 4).alias("share"))


def tenant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    counts = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("admins"))
    rows = nation.join(counts, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("universities"), F.coalesce(F.sum("admins"), F.lit(0)).alias("admins"))
    return region.join(rows, "r_regionkey").select("r_name", "universities", "admins")


def instructor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("assignments"), F.count("*").alias("submissions"))


def course_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.where(F.lower("p_name").contains("re") | F.lower("p_brand").contains("#1")).select("p_partkey", "p_name", "p_brand")


def _courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as courses, with terms of which some span two seasons or have no year."""
    kind, year = F.col("p_size") % 7, (2018 + F.col("p_partkey") % 6).cast("string")
    term = F.when(kind == 0, "Continuous").when(kind == 1, F.concat(F.lit("Fall/Winter "), year, F.lit("-"), (2019 + F.col("p_partkey") % 6).cast("string")))
    for n, season in enumerate(("Spring", "Summer", "Fall", "Winter"), 2):
        term = term.when(kind == n, F.concat(F.lit(f"{season} "), year))
    return _table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"), F.col("p_name").alias("title"), term.otherwise(F.concat(F.lit("winter "), year)).alias("term"))


def course_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.course_filter(_courses(spark, sf_dir), "Fall 2020", "RE").select("p_partkey", "code", "title")


def term_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_term_order(_courses(spark, sf_dir).select("term").distinct()).orderBy(F.desc("year"), "place", "term")


def upload_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as file names, of which some end as archives do."""
    ending = F.when(F.col("page_id") % 3 == 0, ".ZIP").when(F.col("page_id") % 3 == 1, ".zip").otherwise("")
    language = F.when(F.col("page_id") % 4 == 0, "Java").when(F.col("page_id") % 4 == 1, "rust").when(F.col("page_id") % 4 == 2, "cpp")
    rows = _table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("name"), language.alias("language"))
    return rows.select("page_id", scalars.upload_allowed(F.col("name"), F.col("language")).alias("allowed"))


def course_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalars.term(start, F.date_add(start, 120)).alias("term"))


def term_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    terms = _table(spark, sf_dir, "orders").select(F.year(day).alias("year"), scalars.season(day).alias("season")).distinct()
    order = F.when(F.col("season") == "Summer", 2).when(F.col("season") == "Fall", 3).when(F.col("season") == "Winter", 4).otherwise(5)
    return terms.select("year", "season", order.alias("place")).orderBy(F.desc("year"), "place")


def expiry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, day = F.lit(NOW).cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalars.expiry_status(day, now).alias("status"))


def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    gone = orders.where(F.col("o_orderdate") < F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 30 days")).select(F.col("o_orderkey").alias("l_orderkey"))
    return items.join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


def submission_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer")
    return rows.select("c_custkey", scalars.submission_id("secret", F.col("c_name"), F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("submission_id"))


def slug_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.regexp_replace(F.lower("p_name"), " ", "-")
    return _table(spark, sf_dir, "part").select("p_partkey", slug.alias("slug"), scalars.slug_valid(slug).alias("valid"))


def extension_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = scalars.basename(F.split("url", "[?#]")[0])
    extension = F.regexp_extract(name, "[.]([a-z0-9]+)$", 1)
    return _table(spark, sf_dir, "pages").select("page_id", extension.alias("extension"), extension.isin("", "html", "htm").alias("allowed"))


def strip_html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text.cast("binary")).alias("text_md5"))


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("user_turns"))


def flag_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_submission, submissions_per_assignment, instructor_dashboard, course_health, recent_runs, submission_size, severity_share, tenant_rollup, instructor_groups, course_search, course_filter, term_order, upload_policy,
        course_term, term_sort, expiry_status, retention_sweep, submission_id, slug_valid, extension_policy, strip_html_comments, conversation_units, flag_quality,
    )
}

_LEVEL = "CASE WHEN {0} >= 0.7 THEN 'HIGH' WHEN {0} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
_SEASON = "CASE WHEN month({0}) <= 4 THEN 'Winter' WHEN month({0}) <= 7 THEN 'Summer' ELSE 'Fall' END"
_RUNS = f"SELECT o_custkey, {_LEVEL.format('o_totalprice / 500000')} AS level FROM orders"
_KEY = "secret".encode().ljust(64, b"\0")
_INNER, _OUTER = ("".join(f"\\x{b ^ p:02X}" for b in _KEY) for p in (0x36, 0x5C))

_COURSES = """WITH c AS (SELECT p_partkey, p_brand AS code, p_name AS title, CASE p_size % 7 WHEN 0 THEN 'Continuous' WHEN 1 THEN 'Fall/Winter ' || (2018 + p_partkey % 6) || '-' || (2019 + p_partkey % 6)
  WHEN 2 THEN 'Spring ' || (2018 + p_partkey % 6) WHEN 3 THEN 'Summer ' || (2018 + p_partkey % 6) WHEN 4 THEN 'Fall ' || (2018 + p_partkey % 6) WHEN 5 THEN 'Winter ' || (2018 + p_partkey % 6) ELSE 'winter ' || (2018 + p_partkey % 6) END AS term FROM part)"""

SQL = {
    "latest_submission": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "submissions_per_assignment": "SELECT l_partkey AS assignment_id, count(*) AS n_submissions, count(DISTINCT l_orderkey) AS n_students FROM lineitem GROUP BY 1",
    "instructor_dashboard": f"""WITH r AS ({_RUNS}), c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'MEDIUM') AS medium, count(*) FILTER (level = 'LOW') AS low FROM r GROUP BY 1)
SELECT c_mktsegment, count(*) AS courses, CAST(coalesce(sum(n), 0) AS BIGINT) AS submissions, CAST(coalesce(sum(high), 0) AS BIGINT) AS high, CAST(coalesce(sum(medium), 0) AS BIGINT) AS medium, CAST(coalesce(sum(low), 0) AS BIGINT) AS low FROM customer LEFT JOIN c ON o_custkey = c_custkey GROUP BY 1""",
    "course_health": f"""WITH r AS ({_RUNS}), c AS (SELECT c_nationkey, count(*) FILTER (level = 'HIGH') AS high, count(*) AS total FROM r JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT n_name, coalesce(high, 0) AS high, coalesce(total, 0) AS total, coalesce(high > 0, false) AS flagged FROM nation LEFT JOIN c ON n_nationkey = c_nationkey""",
    "recent_runs": "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS max_severity FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "submission_size": "SELECT l_orderkey, count(*) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_size FROM lineitem GROUP BY 1",
    "severity_share": f"WITH r AS (SELECT {_LEVEL.format('l_discount * 10')} AS level, count(*) AS n FROM lineitem GROUP BY 1) SELECT level, n, round(n / sum(n) OVER (), 4) AS share FROM r",
    "tenant_rollup": """WITH c AS (SELECT s_nationkey, count(*) AS admins FROM supplier GROUP BY 1)
SELECT r_name, count(*) AS universities, CAST(coalesce(sum(admins), 0) AS BIGINT) AS admins FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN c ON s_nationkey = n_nationkey GROUP BY 1""",
    "instructor_groups": "SELECT l_suppkey, count(DISTINCT l_partkey) AS assignments, count(*) AS submissions FROM lineitem GROUP BY 1",
    "course_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_brand), '#1')",
    "course_filter": f"{_COURSES} SELECT p_partkey, code, title FROM c WHERE term = 'Fall 2020' AND (contains(lower(code), 're') OR contains(lower(title), 're'))",
    "term_order": f"""{_COURSES}, t AS (SELECT DISTINCT term, lower(string_split(term, ' ')[1]) AS s, coalesce(TRY_CAST(regexp_extract(coalesce(string_split(term, ' ')[2], ''), '^[0-9]+') AS INT), 0) AS year FROM c)
SELECT term, year, CASE s WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 WHEN 'fall' THEN 3 WHEN 'winter' THEN 4 ELSE 5 END AS place FROM t ORDER BY year DESC, place, term""",
    "upload_policy": "SELECT page_id, page_id % 4 NOT IN (0, 2) OR page_id % 3 < 2 OR lower(url) LIKE '%.zip' AS allowed FROM pages",
    "course_term": f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 120 AS e FROM orders),
t AS (SELECT o_orderkey, {_SEASON.format('s')} AS a, {_SEASON.format('e')} AS b, CAST(year(s) AS VARCHAR) AS y, CAST(year(e) AS VARCHAR) AS z FROM d)
SELECT o_orderkey, CASE WHEN a = b AND y = z THEN a || ' ' || y WHEN y = z THEN a || '/' || b || ' ' || y ELSE a || '/' || b || ' ' || y || '-' || z END AS term FROM t""",
    "term_sort": f"""WITH t AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, {_SEASON.format('o_orderdate')} AS season FROM orders)
SELECT year, season, CASE season WHEN 'Summer' THEN 2 WHEN 'Fall' THEN 3 WHEN 'Winter' THEN 4 ELSE 5 END AS place FROM t ORDER BY year DESC, place""",
    "expiry_status": f"""WITH x AS (SELECT o_orderkey, epoch(date_trunc('day', o_orderdate)::TIMESTAMP) + 86399 - epoch(TIMESTAMP '{NOW}') AS d FROM orders)
SELECT o_orderkey, CASE WHEN d >= 0 THEN CASE WHEN floor(d / 86400) <= 15 THEN 'expiring_soon' END WHEN floor(-d / 86400) <= 30 THEN 'grace_period' ELSE 'data_deleted' END AS status FROM x""",
    "retention_sweep": f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 30 DAY)",
    "submission_id": f"SELECT c_custkey, substr(sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(c_custkey || ':' || c_name || ':' || c_mktsegment)))), 1, 16) AS submission_id FROM customer",
    "slug_valid": "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug, regexp_full_match(replace(lower(p_name), ' ', '-'), '[a-z0-9]+(?:-[a-z0-9]+)*') AS valid FROM part",
    "extension_policy": r"""WITH e AS (SELECT page_id, regexp_extract(lower(string_split(regexp_split_to_array(url, '[?#]')[1], '/')[-1]), '[.]([a-z0-9]+)$', 1) AS extension FROM pages)
SELECT page_id, extension, extension IN ('', 'html', 'htm') AS allowed FROM e""",
    "strip_html_comments": "SELECT page_id, md5(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS text_md5 FROM pages",
    "conversation_units": "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY 1",
    "flag_quality": "SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1",
}
