"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Folders made for each session's application, for release().
_MADE: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir. Only on one machine may the setting be absent."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "sievemark-stored")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read back: computed once, and safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the folders that this application made so far; returns their number. To be called when results that read them are written."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        system, place = pyarrow.fs.FileSystem.from_uri(path)
        if system.get_file_info(place).type == pyarrow.fs.FileType.Directory:
            system.delete_dir(place)
    return len(paths)
