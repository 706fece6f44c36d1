"""Training and test splits as ranges of places: rows meet them by buckets, never one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.sources.config import StudyConfig

#: Places of a bucket, and of the pieces in which ranges are written out as rows.
BUCKET = 1 << 16

Interval = tuple[int, str, int, int]


def walk_forward(n: int, splits: int, embargo: int) -> list[Interval]:
    """(fold, role, low, high): expanding training rows less an embargo, then a test fold of n // (splits + 1); high is past the end."""
    size = n // (splits + 1)
    if splits < 2 or embargo < 0 or size < 1:
        raise ValueError("walk_forward needs 2 splits or more, no negative embargo and a row a fold")
    out: list[Interval] = []
    for k in range(1, splits + 1):
        out += [(k, "train", 0, k * size - embargo), (k, "test", k * size, (k + 1) * size)]
    return _held(out)


def purged_kfold(n: int, splits: int, embargo: int) -> list[Interval]:
    """The same of folds that are tested once each; rows within the embargo before or behind a fold train nothing."""
    if splits < 2 or embargo < 0 or n < splits:
        raise ValueError("purged_kfold needs 2 splits or more, no negative embargo and a row a fold")
    size, rest = divmod(n, splits)
    out: list[Interval] = []
    for k in range(splits):
        low = k * size + min(k, rest)
        high = low + size + (k < rest)
        out += [(k + 1, "train", 0, low - embargo), (k + 1, "test", low, high), (k + 1, "train", high + embargo, n)]
    return _held(out)


def _held(intervals: list[Interval]) -> list[Interval]:
    return [x for x in intervals if x[2] < x[3]]


SCHEMES = {"walk_forward": walk_forward, "purged_kfold": purged_kfold}


def of_config(config: StudyConfig, n: int) -> list[Interval]:
    """A study's splits of n rows, by its scheme."""
    return SCHEMES[config.scheme](n, config.n_splits, config.embargo)


def relation(spark: SparkSession, intervals: list[Interval]) -> DataFrame:
    """(fold, role, low, high): three rows a fold at most."""
    return spark.createDataFrame(intervals, "fold long, role string, low long, high long")


def _bucketed(spark: SparkSession, intervals: list[Interval], bucket: int) -> DataFrame:
    ranges = relation(spark, intervals)
    return ranges.withColumn("_bucket", F.explode(F.sequence(F.expr(f"low div {bucket}"), F.expr(f"(high - 1) div {bucket}"))))


def places(spark: SparkSession, intervals: list[Interval], bucket: int = BUCKET) -> DataFrame:
    """(fold, role, idx) of all places, written out a bucket at a time."""
    parts = _bucketed(spark, intervals, bucket).repartition("fold", "_bucket")
    inside = F.sequence(F.greatest("low", F.col("_bucket") * bucket), F.least(F.col("high"), (F.col("_bucket") + 1) * bucket) - 1)
    return parts.select("fold", "role", F.explode(inside).alias("idx"))


def rows(df: DataFrame, place: str, intervals: list[Interval], bucket: int = BUCKET) -> DataFrame:
    """The frame's rows by fold and role, by their place: an equal join of buckets, a row once for each split that holds it."""
    ranges = _bucketed(df.sparkSession, intervals, bucket)
    met = df.withColumn("_bucket", F.expr(f"`{place}` div {bucket}")).join(ranges, "_bucket")
    return met.where((F.col(place) >= F.col("low")) & (F.col(place) < F.col("high"))).select("fold", "role", *(F.col(f"`{c}`") for c in df.columns))
