"""Shared folder, materialisation and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests, one machine) is one made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "sievemark-shared")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage with copies that survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove the shuffle files of plans that nobody holds any more: it waits for a collection in the driver's JVM."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def of_worker(key: object, build: Callable[[], object], _kept: dict = {}) -> object:  # noqa: B006
    """What build makes, kept for the next tasks of this Python worker. One object at a time: that of another operator goes."""
    if key not in _kept:
        clear_worker()
        _kept[key] = build()
    return _kept[key]


def clear_worker() -> None:
    """Let go what an earlier operator has kept in this Python worker, and give free memory back to the system."""
    kept = of_worker.__defaults__[0]
    kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch, where the session leaves Spark's 64 MB: both sides of each task hold some of them.
BATCH_BYTES, _BATCHES = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names do no harm; Arrow batches become small ones."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES, None) == "67108864b":
        conf.set(_BATCHES, BATCH_BYTES)
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Rows of two numbers that a broadcast takes at most: about 90 MB.
BROADCAST_ROWS = 1_000_000


def bounded(keys: DataFrame) -> DataFrame:
    """keys with the hint to broadcast, if they are few enough."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id (null is a value) and hash of the text are not in gone (doc_id, text_hash).

    gone is a written table: up to BROADCAST_ROWS (some 90 bytes each) it is broadcast, beyond both sides are shuffled.
    """
    gone = bounded(gone)
    keys = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(keys["_gone_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["_gone_hash"])
    return docs.join(keys, same, "left_anti")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The column's texts, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def bounded_chunks(batch: pa.RecordBatch, column: str, chars: int = 4_000_000):
    """Slices of a batch with about so many bytes of text at most (one row at least)."""
    sizes = [0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
