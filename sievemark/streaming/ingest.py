"""Submissions as a stream: the latest of each student, repeated and late ones, and fingerprints as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievemark.functions.scalars import submission_id


def submissions(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def latest(stream: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key so far: an aggregate whose state is one row for each key, to be written in update or complete mode."""
    others = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


class Latest(StatefulProcessor):
    """Holds the last row of a key until its due date; then tells it once more, as final, and lets it go."""

    def __init__(self, state: T.StructType, keys: list[str], at: str, tie: str):
        self.fields, self.state_type, self.keys, self.order = state.names, state, keys, (state.names.index(at), state.names.index(tie))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state_type)

    def _row(self, key: tuple, values: tuple, final: bool) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), **{f: v for f, v in zip(self.fields, values, strict=True) if f != "_due"}, final=final)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.last.get()) if self.last.exists() else None
        # moments from the state know their zone, those of new rows don't
        value = lambda x: x.timestamp() if isinstance(x, datetime) else x
        best, place = held, lambda v: tuple((v[i] is not None, value(v[i])) for i in self.order)
        for row in rows:
            one = tuple(row[f] for f in self.fields)
            if best is None or place(one) > place(best):
                best = one
        if best is held or best is None:
            return
        due = self.fields.index("_due")
        if held is not None and held[due] is not None and held[due] != best[due]:
            self.handle.deleteTimer(held[due])
        self.last.update(best)
        if best[due] is not None:
            self.handle.registerTimer(best[due])
        yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.last.exists():
            values = tuple(self.last.get())
            self.last.clear()
            yield self._row(key, values, True)

    def close(self) -> None:
        pass


def latest_until_due(stream: DataFrame, keys: list[str], at: str, tie: str, due: str, late: str) -> DataFrame:
    """The last row of each key whenever it changes (final false), and once more when the watermark has passed its due date (final true).

    The rows that are final are those of a full run over what came in time, whatever its order. State is one row for each key that is not due
    yet; keys without a due date stay. Rows older than the watermark are let go by Spark; late_rows() keeps them. Write in update mode; needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = stream.withColumn("_due", F.unix_millis(F.col(due))).withWatermark(at, late)
    others = [f for f in timed.schema if f.name not in keys]
    bare = T.StructType([T.StructField(f.name, f.dataType, True) for f in others])
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for k in keys for f in timed.schema if f.name == k], *[f for f in bare if f.name != "_due"], T.StructField("final", T.BooleanType())])
    return timed.groupBy(*keys).transformWithState(Latest(bare, keys, at, tie), out, "update", "eventTime")


def once(stream: DataFrame, key: str, name: Column, number: Column, email: Column, at: str, late: str) -> DataFrame:
    """Submissions with their submission_id (keyed by name, number and address), each id once within the watermark's reach."""
    return stream.withColumn("submission_id", submission_id(key, name, number, email)).withWatermark(at, late).dropDuplicatesWithinWatermark(["submission_id"])


def late_rows(stream: DataFrame, at: str, late_seconds: int, root: str, checkpoint: str) -> StreamingQuery:
    """Rows that come behind the watermark, written to root/late by batch: those older than the newest moment of all batches before, less late_seconds.

    The newest moment of each batch lies in root/marks; a batch that is run again replaces what it wrote. Spark's own watermark follows a batch
    later, so what once() lets go of is here, and a row of that batch may be in both.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], "newest long").write.mode("ignore").parquet(f"{root}/marks/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        marks = batch.sparkSession.read.schema("newest long, batch long").parquet(f"{root}/marks").where(F.col("batch") < number)
        newest = marks.agg(F.max("newest")).first()[0]
        moment = F.unix_micros(F.col(at))
        behind = moment < F.lit(None if newest is None else newest - late_seconds * 1_000_000).cast("long")
        batch.where(behind).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        batch.agg(F.max(moment).alias("newest")).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_prints(stream: DataFrame, prints: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Fingerprints of each batch appended below root, by batch, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        prints(batch).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
