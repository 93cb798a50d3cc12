"""Writing what a run found: reports, failures, submissions, anonymised exports; deletions as rewrites."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = "run_id string, assignment_id string, course_id string, status string, error string, started_at timestamp, completed_at timestamp, similarity_threshold double"
#: The parts of a report, each below a folder of its name, by run.
PARTS = ("metadata", "pairs", "blocks", "highlights", "scores")


def persist(spark: SparkSession, root: str, run_id: str, assignment_id: str, course_id: str, make: Callable[[], object], threshold: float = 0.15) -> str:
    """Note the run as running, write the parts of the report that make gives, and note it as completed; where make or a write fails, as failed with the error. Returns the status.

    Notes are appended; the last one of a run counts (runs()). Parts lie by run_id, so that a run is read or dropped by its folder, and
    count only when their run is completed (part()), so a write that broke off shows nothing; a run that is repeated replaces its parts.
    """
    started = time.time_ns() // 1000

    def note(status: str, error: str | None, done: bool) -> None:
        row = spark.createDataFrame([(run_id, assignment_id, course_id, status, error, None, None, threshold)], RUN)
        row = row.withColumns({"started_at": F.timestamp_micros(F.lit(started)), "completed_at": F.current_timestamp() if done else F.lit(None).cast("timestamp")})
        row.write.mode("append").parquet(f"{root}/runs")

    note("running", None, False)
    try:
        report = make()
        for name in PARTS:
            if getattr(report, name, None) is not None:
                getattr(report, name).write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
    except Exception as e:  # the failure is the record
        note("failed", str(e)[:2000], True)
        return "failed"
    note("completed", None, True)
    return "completed"


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The last note of each run: that with the later start, and of one start the later end."""
    notes = spark.read.schema(RUN).parquet(f"{root}/runs")
    others = [c for c in notes.columns if c != "run_id"]
    last = notes.groupBy("run_id").agg(F.max_by(F.struct(*others), F.struct("started_at", F.col("completed_at").isNotNull(), "completed_at")).alias("r"))
    return last.select("run_id", *[F.col(f"r.{c}").alias(c) for c in others])


def part(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A part of the reports of completed runs, with their run_id."""
    done = runs(spark, root).where("status = 'completed'").select("run_id")
    return spark.read.parquet(f"{root}/{name}").withColumn("run_id", F.col("run_id").cast("string")).join(done, "run_id", "left_semi")


def append(rows: DataFrame, root: str, name: str, by: list[str] | None = None) -> None:
    out = rows.write.mode("append")
    (out.partitionBy(*by) if by else out).parquet(f"{root}/{name}")


def rewritten(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those of gone, to be written to a new place: Parquet files don't change."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def numbered_folders(submissions: DataFrame, files: DataFrame, assignment: str, at: str, key: str) -> DataFrame:
    """files with the folder Submission_01 and so on of their submission, the latest first; a submission without files keeps its number."""
    number = F.row_number().over(Window.partitionBy(assignment).orderBy(F.desc(at), key)).cast("string")
    named = submissions.select(assignment, key, F.concat(F.lit("Submission_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)).alias("folder"))
    return files.join(named, key)


def export(folders: DataFrame, root: str) -> None:
    """Write files by folder; nothing but the number tells whose they are."""
    folders.select("folder", "path", "content").write.mode("overwrite").partitionBy("folder").parquet(root)
