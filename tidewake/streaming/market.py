"""Market data as streams: bars and idempotent fills.

Watermarks bound the state: a bar is written once, when its window has passed, and
rows that come later than the watermark allows aren't in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.streaming.replay import Run, named


def events(spark: SparkSession, sf_dir: str, files_a_batch: int = 8) -> DataFrame:
    """The events table as a stream, at most so many files a batch: backpressure instead of dropped messages."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/event[s].parquet")


def bars(stream: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(instrument, start, open, high, low, close, n) of tumbling windows, closed once the watermark has passed."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).where(named("event_type", "at"))
    order = F.struct("at", "event_id")
    return (
        timed.groupBy(F.col("event_type").alias("instrument"), F.window("at", every).alias("w"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))
        .select("instrument", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
    )


def first_fills(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Fills without repeats of an order's fill id that arrive within the watermark; the stream has ``at``."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["cloid", "fill_id"])


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared checkpoint folder.

    In complete mode every batch holds the whole result, so only the last one is read.
    """
    return Run(stream.sparkSession).drain(stream, mode).rows(stream.schema, mode == "complete")
