"""Order-book operators on ladders held as arrays, without user functions.

A level is a struct (pos, px_raw, qty_raw, n_orders); ``pos`` is its place of
arrival, which breaks ties so that sorts are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import fixed


def _live(ladder: str) -> Column:
    return F.filter(ladder, lambda x: x["qty_raw"] > 0)


def _unsorted(ladder: Column, descending: bool) -> Column:
    """Whether some level doesn't stand strictly behind the one before."""
    pairs = F.zip_with(F.slice(ladder, F.lit(1), F.greatest(F.size(ladder) - 1, F.lit(0))), F.slice(ladder, F.lit(2), F.greatest(F.size(ladder) - 1, F.lit(0))), lambda a, b: F.struct(a["px_raw"].alias("a"), b["px_raw"].alias("b")))
    return F.exists(pairs, lambda p: p["b"] >= p["a"] if descending else p["b"] <= p["a"])


def _sorted(ladder: Column, descending: bool) -> Column:
    side = -1 if descending else 1
    keyed = F.transform(ladder, lambda x: F.struct((x["px_raw"] * side).alias("k"), x["pos"].alias("p"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def repair(snapshots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ladders without empty levels and in price order, with what was wrong in each snapshot.

    Adds bad_qty (levels dropped), unsorted (ladders, 0 to 2), crossed and
    ts_regressed (against the snapshot before, by ``snap``).
    """
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("snap") if keys else None
    out = snapshots.select(
        "*", _live("bids").alias("b"), _live("asks").alias("a"), (F.size("bids") + F.size("asks")).alias("levels")
    ).withColumn("unsorted", _unsorted(F.col("b"), True).cast("long") + _unsorted(F.col("a"), False).cast("long"))
    out = out.withColumn("bad_qty", (F.col("levels") - F.size("b") - F.size("a")).cast("long"))
    out = out.withColumn("bids", _sorted(F.col("b"), True)).withColumn("asks", _sorted(F.col("a"), False)).drop("b", "a", "levels")
    crossed = F.try_element_at("bids", F.lit(1))["px_raw"] >= F.try_element_at("asks", F.lit(1))["px_raw"]
    out = out.withColumn("crossed", F.coalesce(crossed, F.lit(False)))
    if w is not None:
        out = out.withColumn("ts_regressed", F.col("ts") < F.coalesce(F.lag("ts").over(w), F.lit(0)))
    return out


def best(ladder: str) -> Column:
    """The first level, or null."""
    return F.try_element_at(ladder, F.lit(1))


def book_mid() -> Column:
    """Half of the best prices, or null where a side is empty."""
    return fixed.mid(best("bids")["px_raw"], best("asks")["px_raw"])


def size_at(ladder: str, px: Column) -> Column:
    """Quantity at a price, 0 where there is none."""
    return F.coalesce(F.try_element_at(F.filter(ladder, lambda x: x["px_raw"] == px), F.lit(1))["qty_raw"], F.lit(0))


def levels_as_of(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The book that level updates leave: the last quantity of each price by ``seq``, without removed prices."""
    return updates.groupBy(*keys, "side", "px_raw").agg(F.max_by("qty_raw", "seq").alias("qty_raw")).where("qty_raw > 0")


def market_walk(orders: DataFrame, levels: DataFrame, keys: list[str], taker_ppm: int) -> DataFrame:
    """Fills of market orders along the opposite ladder: (keys, cloid, level, px_raw, take_raw, notional_raw, fee_raw).

    ``levels`` are rows (keys, side of the book, level from 1 at the best, px_raw,
    qty_raw). Takes follow from running sums, so no order is walked level by level.
    """
    walk = Window.partitionBy(*keys, "cloid").orderBy("level")
    opposite = F.when(F.col("order_side") == "Buy", "ask").otherwise("bid")
    met = orders.withColumn("side", opposite).join(levels, [*keys, "side"])
    before = F.coalesce(F.sum("qty_raw").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("qty_raw"), F.col("order_qty") - before))
    fills = met.withColumn("take_raw", take).where("take_raw > 0")
    return fills.withColumn("notional_raw", fixed.notional(F.col("px_raw"), F.col("take_raw"))).withColumn("fee_raw", fixed.fee(F.col("notional_raw"), taker_ppm))


def resting_fills(orders: DataFrame, trades: DataFrame, keys: list[str], maker_ppm: int) -> DataFrame:
    """Fills of resting orders by later trades: volume at the price clears the queue ahead first.

    ``orders``: keys, cloid, order_side, order_px, order_qty, queue_ahead, order_seq.
    ``trades``: keys, seq, side (the aggressor's), px_raw, qty_raw. Every order sees
    each whole print. With V the volume so far, V - queue_ahead within 0 and the
    order's quantity is filled; a print's fill is the difference.
    """
    buys = (F.col("order_side") == "Buy") & (F.col("side") == "Sell") & (F.col("px_raw") <= F.col("order_px"))
    sells = (F.col("order_side") == "Sell") & (F.col("side") == "Buy") & (F.col("px_raw") >= F.col("order_px"))
    met = orders.join(trades, keys).where((F.col("seq") > F.col("order_seq")) & (buys | sells))
    path = Window.partitionBy(*keys, "cloid").orderBy("seq")
    volume = F.sum("qty_raw").over(path)
    done = lambda v: F.greatest(F.lit(0), F.least(v - F.col("queue_ahead"), F.col("order_qty")))
    fills = met.withColumn("fill_raw", done(volume) - done(volume - F.col("qty_raw"))).where("fill_raw > 0")
    return fills.withColumn("fee_raw", fixed.fee(fixed.notional(F.col("order_px"), F.col("fill_raw")), maker_ppm))
