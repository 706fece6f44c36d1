"""Splits, leakage checks, overfitting diagnostics and bootstraps as relations."""

from __future__ import annotations

import hashlib
import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions.normal import even
from tidewake.operators import splits as ranges
from tidewake.shared import folder


def walk_forward(spark: SparkSession, n: int, splits: int, embargo: int) -> DataFrame:
    """(fold, role, idx): expanding training rows less an embargo, then a test fold of n // (splits + 1)."""
    return ranges.places(spark, ranges.walk_forward(n, splits, embargo))


def purged_kfold(spark: SparkSession, n: int, splits: int, embargo: int) -> DataFrame:
    """(fold, role, idx): each fold tested once; rows within the embargo behind or before it train nothing."""
    return ranges.places(spark, ranges.purged_kfold(n, splits, embargo))


def leaks(splits: DataFrame, span: int, causal: bool) -> DataFrame:
    """(fold, idx) of training rows whose label span of so many rows meets the fold's test rows, or that stand behind them."""
    tests = splits.where("role = 'test'").groupBy("fold").agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    train = splits.where("role = 'train'").join(F.broadcast(tests), "fold")
    bad = (F.col("idx") + span > F.col("low")) & (F.col("idx") <= F.col("high"))
    if causal:
        bad = bad | (F.col("idx") > F.col("low"))
    return train.where(bad).select("fold", "idx")


def block_sums(panel: DataFrame, blocks: int, length: int) -> DataFrame:
    """(block, cfg, n, s, q): counts, sums and sums of squares of returns; rows past blocks * length go."""
    per = length // blocks
    rows = panel.where(F.col("t") < per * blocks).withColumn("block", F.floor(F.col("t") / per))
    return rows.groupBy("block", "cfg").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))


def cscv(panel: DataFrame, blocks: int, length: int) -> DataFrame:
    """(split, best, omega, logit, oos) of every way to take half of the blocks as in-sample.

    Sharpe ratios of both halves come from additive block sums, so returns are
    read once, whatever the number of splits.
    """
    spark = panel.sparkSession
    halves = [(k, b, b in half) for k, half in enumerate(map(set, combinations(range(blocks), blocks // 2))) for b in range(blocks)]
    splits = spark.createDataFrame(halves, "split long, block long, inside boolean")
    side = block_sums(panel, blocks, length).join(F.broadcast(splits), "block").groupBy("split", "cfg", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    sharpe = F.round(F.when(variance > 1e-18, F.col("s") / F.col("n") / F.sqrt(variance)).otherwise(0.0), 9)
    rated = side.withColumn("sharpe", sharpe).groupBy("split", "cfg").agg(F.max(F.when(F.col("inside"), F.col("sharpe"))).alias("ins"), F.max(F.when(~F.col("inside"), F.col("sharpe"))).alias("oos"))
    one = Window.partitionBy("split")
    best_first = one.orderBy(F.desc("ins"), "cfg")
    below, equal = F.rank().over(one.orderBy("oos")), F.count("*").over(Window.partitionBy("split", "oos"))
    ranked = rated.select("split", "cfg", "oos", F.row_number().over(best_first).alias("place"), (below + (equal - 1) / 2).alias("rank"), F.count("*").over(one).alias("k"))
    omega = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("rank") / (F.col("k") + 1)))
    return ranked.where("place = 1").select("split", F.col("cfg").alias("best"), omega.alias("omega"), F.ln(omega / (1 - omega)).alias("logit"), "oos")


def bootstrap_path(draws: DataFrame, length: int, block: float) -> DataFrame:
    """(rep, t, idx) of stationary bootstraps; ``draws`` are rows (rep, t, u, v) of even numbers in [0, 1).

    A path jumps to floor(v * length) at t = 0 and where u < 1 / block, and goes
    on to the next row otherwise: the last jump and the steps since give the row.
    """
    path = Window.partitionBy("rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    jump = (F.col("t") == 0) | (F.col("u") < 1.0 / block)
    last = lambda x: F.last(F.when(jump, x), ignorenulls=True).over(path)
    start, since = last(F.floor(F.col("v") * length)), F.col("t") - last(F.col("t"))
    return draws.select("rep", "t", ((start + since) % length).alias("idx"))


def reality_check(panel: DataFrame, length: int, reps: int, block: float, seed: int) -> DataFrame:
    """One row (stat, rc_p, spa_stat, spa_p, k_kept): White's reality check and the simplified SPA test.

    Panel rows (t, cfg, r) are excess returns. Replicates' means come from one
    join of paths with the panel and one aggregation.
    """
    import math

    spark = panel.sparkSession
    draws = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    draws = draws.select("rep", "t", even("rep", "t", seed=seed).alias("u"), even("rep", "t", seed=seed + 1).alias("v"))
    weights = bootstrap_path(draws, length, block).groupBy("rep", "idx").agg(F.count("*").alias("n"))
    boot = weights.join(panel.withColumnRenamed("t", "idx"), "idx").groupBy("rep", "cfg").agg((F.sum(F.col("n") * F.col("r")) / length).alias("m"))
    mean = panel.groupBy("cfg").agg((F.sum("r") / length).alias("mean"))
    off = boot.join(mean, "cfg").withColumn("d", F.col("m") - F.col("mean"))
    omega = off.groupBy("cfg", "mean").agg(F.sqrt(F.avg(F.col("d") * F.col("d")) * length).alias("omega"))
    rated = omega.select("cfg", "omega", F.when(F.col("omega") > 0, math.sqrt(length) * F.col("mean") / F.col("omega")).otherwise(0.0).alias("z"))
    bar = -math.sqrt(2 * math.log(math.log(length)))
    rated = rated.withColumn("kept", F.col("z") >= bar)
    tops = rated.agg(F.greatest(F.max("z"), F.lit(0.0)).alias("stat"), F.greatest(F.coalesce(F.max(F.when(F.col("kept"), F.col("z"))), F.lit(0.0)), F.lit(0.0)).alias("spa_stat"), F.sum(F.col("kept").cast("long")).alias("k_kept"))
    w = F.when(F.col("omega") > 0, math.sqrt(length) * F.col("d") / F.col("omega")).otherwise(0.0)
    maxima = off.join(rated, "cfg").groupBy("rep").agg(F.greatest(F.max(w), F.lit(0.0)).alias("top"), F.greatest(F.coalesce(F.max(F.when(F.col("kept"), w)), F.lit(0.0)), F.lit(0.0)).alias("kept_top"))
    return maxima.crossJoin(F.broadcast(tops)).groupBy("stat", "spa_stat", "k_kept").agg(F.avg((F.col("top") >= F.col("stat")).cast("double")).alias("rc_p"), F.avg((F.col("kept_top") >= F.col("spa_stat")).cast("double")).alias("spa_p"))


#: What must be typed to look at a holdout.
REVEAL = "I will look at the holdout once"


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``_i``, their places from 0 in the whole order, numbered in many tasks.

    Rows are dealt by ranges of the order and written; each range's rows are
    numbered by themselves, behind the numbers of the ranges before it.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    # A row a range.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_p").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return rows.withColumn("_i", place).join(F.broadcast(starts), "_p").withColumn("_i", F.col("_i") + F.col("_start")).drop("_p", "_start")


def research_rows(df: DataFrame, order: list[str], manifest: dict) -> DataFrame:
    """The rows before a holdout's boundary; another number of rows than the manifest's is an error."""
    if df.count() != manifest["n_total"]:
        raise ValueError("the rows aren't those that the manifest seals")
    return numbered(df, order).where(F.col("_i") < manifest["boundary_index"]).drop("_i")


def reveal(df: DataFrame, order: list[str], column: str, manifest: dict, phrase: str) -> DataFrame:
    """The rows behind the boundary, only with the exact phrase and if their values still have the sealed hash."""
    if phrase != REVEAL:
        raise PermissionError("the phrase isn't right")
    held = numbered(df, order).where(F.col("_i") >= manifest["boundary_index"]).drop("_i")
    if seal(held, order, column) != manifest["holdout_sha256"]:
        raise ValueError("the holdout has changed")
    return held


#: Values that are hashed together.
SEAL_ROWS = 4096


def seal(df: DataFrame, order: list[str], column: str) -> str:
    """SHA-256 over a column's values in order: of each SEAL_ROWS of them, then of as many of these digests, and so on to one."""
    level = numbered(df.select(*order, F.col(column).alias("_v")), order).select("_i", "_v")
    for depth in range(64):
        values = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"])
        level = level.groupBy(F.expr(f"_i div {SEAL_ROWS}").alias("_i")).agg(F.sha2(F.to_json(values), 256).alias("_v"))
        top = level.limit(2).collect() if depth else []
        if depth and len(top) < 2:
            return top[0]["_v"] if top else hashlib.sha256(b"[]").hexdigest()
    raise ValueError("more values than can be sealed")


def reproduced(a: DataFrame, b: DataFrame, keys: list[str], column: str, rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """(missing, differing): rows that only one side has, and rows whose values differ past the tolerances."""
    both = a.select(*keys, F.col(column).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(*keys, F.col(column).alias("_b"), F.lit(1).alias("_in_b")), keys, "full")
    one = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    return both.agg(F.count_if(one).alias("missing"), F.count_if(~one & (F.abs(F.col("_a") - F.col("_b")) > atol + rtol * F.abs("_b"))).alias("differing"))
