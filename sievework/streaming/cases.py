"""Streams of cases: the batch transforms over a file source, repost removal, and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.sources.files import enqueue


def case_stream(spark: SparkSession, folder: str, schema: str, format: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(folder)


def without_reposts(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key has not come within the watermark; state is dropped behind it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))


def to_queue(stream: DataFrame, queue: str, key_columns: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each batch goes through the transform into a queue keyed by content, so a batch run again adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: enqueue(transform(batch), queue, key_columns)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(events: DataFrame, run: str, step: str, at: str, state: str, stopped: str = "stopped") -> DataFrame:
    """Last state of each step; when a run has stopped, what was running warns and what waited is skipped."""
    last = events.groupBy(run, step).agg(F.max_by(state, at).alias("state"))
    ended = events.where(F.col(state) == stopped).select(run).distinct().withColumn("ended", F.lit(True))
    joined = last.join(ended, run, "left")
    return joined.select(run, step, F.when(F.col("ended") & (F.col("state") == "running"), "warning").when(F.col("ended") & (F.col("state") == "waiting"), "skipped").otherwise(F.col("state")).alias("state"))
