"""Performance statistics as grouped aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewake.functions import normal

#: Euler's constant, of the expected maximum of normal draws.
EULER = 0.5772156649015329


def sharpe(r: Column, periods: float = 365.0) -> Column:
    """Mean over sample deviation, annualised; 0 where returns don't vary, null for a single one."""
    deviation = F.stddev_samp(r)
    return F.when(F.count(r) < 2, F.lit(None)).when(deviation == 0, 0.0).otherwise(F.avg(r) / deviation * math.sqrt(periods))


def sortino(r: Column, periods: float = 365.0, target: float = 0.0) -> Column:
    """Mean excess over downside deviation, annualised; 0 where there is none."""
    down = F.sqrt(F.avg(F.pow(F.least(r - target, F.lit(0.0)), 2)))
    return F.when(down == 0, 0.0).otherwise(F.avg(r - target) / down * math.sqrt(periods))


def total_return(r: Column) -> Column:
    """exp of the sum of log returns, less 1."""
    return F.exp(F.sum(r)) - 1


def drawdown_rows(df: DataFrame, r: str, keys: list[str], order: list[str]) -> DataFrame:
    """The frame with ``equity`` (compounded 1 + r), ``peak`` and ``drawdown``; the peak starts at the first equity."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("equity", F.exp(F.sum(F.log1p(F.col(r))).over(w)))
    rows = rows.withColumn("peak", F.max("equity").over(w))
    return rows.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def moments(df: DataFrame, r: str, keys: list[str]) -> DataFrame:
    """n, mean, deviation, bias-corrected skewness g1 and non-excess kurtosis g2 of each group, from power sums.

    Sums are taken about the group's mean, which costs a join of one row a group.
    """
    means = df.groupBy(*keys).agg(F.avg(r).alias("mean"))
    d = F.col(r) - F.col("mean")
    sums = df.join(means, keys).groupBy(*keys, "mean").agg(F.count("*").alias("n"), F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4"))
    n, m2, m3, m4 = F.col("n"), F.col("s2") / F.col("n"), F.col("s3") / F.col("n"), F.col("s4") / F.col("n")
    g1 = F.when((n > 2) & (m2 > 0), F.sqrt(n * (n - 1)) / (n - 2) * m3 / F.pow(m2, 1.5))
    g2 = F.when((n > 3) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (m2 * m2) - 3 * (n - 1)) + 3)
    return sums.select(*keys, "n", "mean", F.sqrt(F.when(n > 1, F.col("s2") / (n - 1))).alias("deviation"), g1.alias("g1"), g2.alias("g2"))


def psr_z(sr: Column, benchmark: Column, n: Column, g1: Column, g2: Column) -> Column:
    """z of the probabilistic Sharpe ratio (per period); null where n < 3 or the variance isn't positive."""
    v = 1 - g1 * sr + (g2 - 1) / 4 * sr * sr
    return F.when((n >= 3) & (v > 0), (sr - benchmark) * F.sqrt(n - 1) / F.sqrt(v))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Expected maximum of as many unskilled trials' Sharpe ratios."""
    if trials < 2 or variance <= 0:
        return 0.0
    inverse = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * inverse(1 - 1 / trials) + EULER * inverse(1 - 1 / (trials * math.e)))


def expected_max(variance: Column, trials: Column) -> Column:
    """The same of columns; 0 for fewer than two trials or no variance."""
    n = trials.cast("double")
    best = (1 - EULER) * normal.inverse(1 - 1 / n) + EULER * normal.inverse(1 - 1 / (n * math.e))
    return F.when((n >= 2) & (variance > 0), F.sqrt(variance) * best).otherwise(0.0)


#: Groups whose brackets are broadcast.
FEW_GROUPS = 10_000
#: Bins of a histogram: what a task holds of a group and point.
BINS = 4096


def percentiles(df: DataFrame, x: str, keys: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles, maximum and count of each group of whole numbers.

    Each point's rank is sought in a histogram of the group's range, then in one of the bin that
    holds it, until a bin is one value: a few scans, and BINS counts a group and point, whatever
    the number of different values. Values that are no whole numbers are ranked as they are.
    """
    kind = df.schema[x].dataType
    names = [f"p{int(p * 100)}" for p in points]
    if not isinstance(kind, IntegralType):
        exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})").cast(kind).alias(n) for p, n in zip(points, names)]
        return df.groupBy(*keys).agg(*exact, F.max(x).alias("max"), F.count(x).alias("n"))
    key = F.struct(*(F.col(f"`{k}`") for k in keys), F.lit(0).alias("_none")).alias("_key")
    rows = df.select(key, F.col(x).cast("decimal(20,0)").alias("_x"))
    about = rows.groupBy("_key").agg(F.min("_x").alias("_low"), F.max("_x").alias("max"), F.count("_x").alias("n"))
    span, groups = about.agg(F.max(F.col("max") - F.col("_low")), F.count("*")).first()
    # A row a group and point: broadcast while there are few groups, so that rows don't move.
    few = F.broadcast if groups <= FEW_GROUPS else (lambda at: at)
    point = F.explode(F.array(*(F.struct(F.lit(n).alias("_point"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).cast("long").alias("_rank")) for p, n in zip(points, names)))).alias("_p")
    width = lambda high, low: F.ceil((high - low + 1) / F.lit(BINS)).cast("decimal(20,0)")
    # Where a rank is: values from _low on, in bins of _step values, of which it is the _rank-th.
    at = about.where("n > 0").select("_key", point, "_low", width(F.col("max"), F.col("_low")).alias("_step")).select("_key", "_p._point", "_p._rank", "_low", "_step")
    steps = max(1, int(span or 0) + 1)
    while True:
        bin_ = F.floor((F.col("_x") - F.col("_low")) / F.col("_step")).cast("long")
        inside = rows.where("_x IS NOT NULL").join(few(at), "_key").where((F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_low") + F.col("_step") * BINS))
        counts = inside.groupBy("_key", "_point", "_rank", "_low", "_step", bin_.alias("_bin")).agg(F.count("*").alias("_count"))
        so_far = F.sum("_count").over(Window.partitionBy("_key", "_point").orderBy("_bin"))
        held = counts.withColumn("_upto", so_far).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_count") < F.col("_rank")))
        start = (F.col("_low") + F.col("_bin") * F.col("_step")).cast("decimal(20,0)")
        finer = F.ceil(F.col("_step") / F.lit(BINS)).cast("decimal(20,0)")
        at = held.select("_key", "_point", (F.col("_rank") - F.col("_upto") + F.col("_count")).alias("_rank"), start.alias("_low"), finer.alias("_step"))
        # A histogram's bins are so many values wide; when that is one, the place is the value.
        steps = -(-steps // BINS)
        if steps == 1:
            break
    found = at.groupBy("_key").agg(*(F.max(F.when(F.col("_point") == n, F.col("_low"))).alias(n) for n in names))
    whole = about.join(found, "_key", "left")
    return whole.select(*(F.col(f"_key.`{k}`").alias(k) for k in keys), *(F.col(c).cast(kind).alias(c) for c in [*names, "max"]), "n")
