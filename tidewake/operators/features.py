"""Causal time-series features over ordered windows, one sort a key for all of them.

Frames look back only. A feature is null until its window is full, and where a
division has nothing to divide by; NaN never appears, but for the features that read ``ieee_return``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewake.operators import scan


def nulls_last(order: list[str]) -> list[Column]:
    """An order whose nulls come last, as the SQL has them; Spark's own come first."""
    return [F.col(c).asc_nulls_last() for c in order]


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    """The window that all features of a frame share."""
    return Window.partitionBy(*keys).orderBy(*nulls_last(order))


def rolling(aggregate: Callable[[Column], Column], x: Column, window: int, w: WindowSpec) -> Column:
    """An aggregate of the last ``window`` rows, null until so many values are there."""
    frame = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(frame) == window, aggregate(x).over(frame))


def log_return(price: Column, w: WindowSpec, lag: int = 1) -> Column:
    """ln of a price over that of ``lag`` rows before."""
    if lag < 1:
        raise ValueError("lag must be 1 or more")
    before = F.lag(price, lag).over(w)
    return F.when((price > 0) & (before > 0), F.ln(price / before))


def ln_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) as IEEE arithmetic has it: infinite where one of them is 0, NaN where both are or their signs differ; null only for null."""
    number = lambda x: F.lit(float(x))
    ratio = F.when(b == 0, F.when(a > 0, number("inf")).when(a.isNotNull(), number("nan"))).otherwise(F.try_divide(a, b))
    return F.when(ratio == 0, number("-inf")).when(ratio < 0, number("nan")).otherwise(F.ln(ratio))


def ieee_return(price: Column, w: WindowSpec, lag: int = 1) -> Column:
    """Like ``log_return``, but of prices that may be 0 or less: see ``ln_ratio``."""
    if lag < 1:
        raise ValueError("lag must be 1 or more")
    return ln_ratio(price, F.lag(price, lag).over(w))


def realized_vol(returns: str, w: WindowSpec, window: int = 60) -> Column:
    """Population deviation of the last ``window`` one-row returns (a column made by log_return)."""
    return rolling(F.stddev_pop, F.col(returns), window, w)


def sma(price: Column, w: WindowSpec, window: int = 20) -> Column:
    """Mean of the last ``window`` prices."""
    return rolling(F.avg, price, window, w)


def momentum(price: Column, w: WindowSpec, window: int = 60) -> Column:
    """Log return over the window."""
    return log_return(price, w, window)


def zscore(price: Column, w: WindowSpec, window: int = 60) -> Column:
    """Distance from the window's mean in population deviations; null where they are 0."""
    deviation = rolling(F.stddev_pop, price, window, w)
    return F.when(deviation > 0, (price - rolling(F.avg, price, window, w)) / deviation)


#: The longest window that a feature has by itself.
LONGEST_DEFAULT = 60

#: Features by name, of a price, the name of its returns, the window and the function that makes returns.
REGISTRY: dict[str, Callable[..., Column]] = {
    "log_return": lambda p, r, w, of, lag=1: of(p, w, lag),
    "realized_vol": lambda p, r, w, of, window=60: realized_vol(r, w, window),
    "sma": lambda p, r, w, of, window=20: sma(p, w, window),
    "momentum": lambda p, r, w, of, window=60: of(p, w, window),
    "zscore": lambda p, r, w, of, window=60: zscore(p, w, window),
}


def feature_name(name: str, params: dict) -> str:
    """name_k1v1_k2v2, parameters in order of their names."""
    return "_".join([name, *(f"{k}{v}" for k, v in sorted(params.items()))])


def build(df: DataFrame, specs: list[tuple[str, dict]], price: str, keys: list[str], order: list[str], pieces: bool = True, returns: Callable[..., Column] = log_return) -> DataFrame:
    """The frame with all features and ``valid``: whether all of them are there. In pieces, a task holds some of a key's rows; otherwise it holds a key.

    ``returns`` is ``log_return`` or ``ieee_return``.
    """
    unknown = [n for n, _ in specs if n not in REGISTRY]
    if unknown or not specs:
        raise ValueError(f"unknown features {unknown}" if unknown else "no features")
    # A window of returns begins with a return, which looks one row further back.
    back = 1 + max(p.get("window", p.get("lag", LONGEST_DEFAULT)) for _, p in specs)
    rows, w, own = scan.haloed(df, keys, nulls_last(order), back) if pieces else (df, ordered(keys, order), F.lit(True))
    base = rows.withColumn("_ret", returns(F.col(price), w)).withColumn("_own", own)
    names = [feature_name(n, p) for n, p in specs]
    out = base.select(*df.columns, "_own", *(REGISTRY[n](F.col(price), "_ret", w, returns, **p).alias(a) for (n, p), a in zip(specs, names))).where("_own").drop("_own")
    valid = F.lit(True)
    for a in names:
        valid = valid & F.col(a).isNotNull()
    return out.withColumn("valid", valid)


def sma_cross(df: DataFrame, mid: str, fast: int, slow: int, keys: list[str], order: list[str]) -> DataFrame:
    """Rows where the fast mean crosses the slow one: the frame with ``above``; the first full window counts as a cross.

    Sums are compared crosswise in decimals, so nothing is rounded.
    """
    rows, w, own = scan.haloed(df, keys, nulls_last(order), slow)
    wide = F.col(mid).cast("decimal(38,0)")
    sums = lambda n: F.sum(F.col(mid).cast("decimal(20,0)")).over(w.rowsBetween(-(n - 1), 0))
    full = rows.withColumn("_own", own).withColumn("_fast", sums(fast)).withColumn("_slow", sums(slow)).withColumn("_n", F.count(wide).over(w.rowsBetween(-(slow - 1), 0)))
    held = full.where(F.col("_n") == slow).withColumn("above", F.col("_fast") * slow > F.col("_slow") * fast)
    before = F.lag("above").over(w)
    return held.withColumn("_cross", before.isNull() | (before != F.col("above"))).where("_cross AND _own").select(*df.columns, "above")


def next_return(close: Column, w: WindowSpec) -> Column:
    """ln of the next close over this one; null on the last row; see ``ln_ratio`` for closes that are 0."""
    return ln_ratio(F.lead(close).over(w), close)


def turnover_cost(weight: Column, w: WindowSpec, bps: float) -> Column:
    """Cost of the change of a weight that starts from 0."""
    return F.abs(weight - F.coalesce(F.lag(weight).over(w), F.lit(0.0))) * (bps / 1e4)


def equity_curve(returns: Column, w: WindowSpec) -> Column:
    """exp of the running sum of log returns."""
    return F.exp(F.sum(returns).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def input_fault(x: Column, at: Column, before: Column) -> Column:
    """What is wrong with a value that features are to be built on, or null; times must not fall."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(~finite, "not finite").when(x <= 0, "not positive").when(at < before, "out of order")


def weighted_returns(df: DataFrame, weight: str, close: str, funding: str, bps: float, keys: list[str], order: list[str]) -> DataFrame:
    """hold, cost, funding_paid and strat of a weight decided on a row and held to the next; the last row goes.

    All strategies of the library account for their weights here.
    """
    w = ordered(keys, order)
    rows = df.select(
        *df.columns,
        next_return(F.col(close), w).alias("hold"),
        turnover_cost(F.col(weight), w, bps).alias("cost"),
        (F.col(weight) * F.lead(funding).over(w)).alias("funding_paid"),
    ).where("hold IS NOT NULL")
    return rows.withColumn("strat", F.col(weight) * F.col("hold") - F.col("cost") - F.coalesce("funding_paid", F.lit(0.0)))
