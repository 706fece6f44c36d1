"""Queries of schedules, configurations, holdouts, logs of signals, and what market orders leave unfilled."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.operators import book, features, stats, validation
from tidewake.plans.market import _sorted_levels
from tidewake.plans.research import _CLOSES, _closes
from tidewake.shared import folder
from tidewake.sources import adapters as A
from tidewake.sources import config, logs
from tidewake.sources.adapters import with_tables


def s05_backoff(spark, sf_dir):
    """Delay before each reconnection attempt, and the most that jitter adds to it; attempts are users' numbers modulo 16."""
    attempts = A.ticks(spark, sf_dir).select((F.col("user_id") % 16 + 1).alias("attempt")).distinct()
    delay = logs.backoff_ms(F.col("attempt"))
    return attempts.select("attempt", delay.alias("delay_ms"), F.expr("0L").alias("least_jitter_ms"), F.floor(delay / 2).alias("most_jitter_ms"))


S05 = with_tables("ticks", """, d AS (SELECT DISTINCT user_id % 16 + 1 AS attempt FROM ticks)
SELECT attempt, CAST(least(30000, 250 * 2 ** least(attempt - 1, 10)) AS BIGINT) AS delay_ms, CAST(0 AS BIGINT) AS least_jitter_ms, CAST(floor(least(30000, 250 * 2 ** least(attempt - 1, 10)) / 2) AS BIGINT) AS most_jitter_ms FROM d""")


def b08_unfilled(spark, sf_dir):
    """What each market order takes from the visible ladder, and the rest of it that stays unfilled."""
    orders = A.order_requests(spark, sf_dir).select(F.col("cloid").alias("snap"), "cloid", F.col("side").alias("order_side"), (F.col("qty_raw") * 10).alias("order_qty"))
    taken = book.market_walk(orders, _sorted_levels(spark, sf_dir), ["snap"], 450).groupBy("cloid").agg(F.sum("take_raw").alias("taken"))
    both = orders.join(taken, "cloid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return both.select("cloid", F.col("taken").alias("filled_raw"), (F.col("order_qty") - F.col("taken")).alias("unfilled_raw"))


B08 = with_tables("l2_levels order_requests", """, q AS (SELECT snap, side, sum(qty_raw) AS qty FROM l2_levels WHERE qty_raw > 0 GROUP BY 1, 2)
SELECT o.cloid, CAST(least(o.qty_raw * 10, coalesce(q.qty, 0)) AS BIGINT) AS filled_raw, CAST(o.qty_raw * 10 - least(o.qty_raw * 10, coalesce(q.qty, 0)) AS BIGINT) AS unfilled_raw
FROM order_requests o LEFT JOIN q ON q.snap = o.cloid AND q.side = CASE o.side WHEN 'Buy' THEN 'ask' ELSE 'bid' END""")


def w16_rolling_risk(spark, sf_dir):
    """Sharpe and Sortino ratios of the 90 hours before each, a year of 365 periods."""
    w = features.ordered(["cfg"], ["t"])
    back = w.rowsBetween(-90, -1)
    whole, deviation, down = F.count("r").over(back) == 90, F.stddev_samp("r").over(back), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)).over(back))
    year = F.avg("r").over(back) * F.sqrt(F.lit(365.0))
    rows = A.trial_panel(spark, sf_dir)
    return rows.select("cfg", "t", F.round(F.when(whole & (deviation > 0), year / deviation), 6).alias("sharpe"), F.round(F.when(whole & (down > 0), year / down), 6).alias("sortino"))


W16 = with_tables("trial_panel", """, e AS (SELECT *, count(r) OVER b AS n, avg(r) OVER b AS m, stddev_samp(r) OVER b AS d, sqrt(avg(least(r, 0) ** 2) OVER b) AS down FROM trial_panel
  WINDOW b AS (PARTITION BY cfg ORDER BY t ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))
SELECT cfg, t, round(CASE WHEN n = 90 AND d > 0 THEN m * sqrt(365.0::DOUBLE) / d END, 6) AS sharpe, round(CASE WHEN n = 90 AND down > 0 THEN m * sqrt(365.0::DOUBLE) / down END, 6) AS sortino FROM e""")


def v14_funding_impact(spark, sf_dir):
    """Returns and Sharpe ratios of the rule's positions gross and net of daily funding, and what funding takes."""
    rule = _closes(spark, sf_dir).where("vol IS NOT NULL").withColumn("weight", F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    # Rates from -0.02 to 0.04 % a day, by the day's place in its week.
    paid = rule.withColumn("funding", (F.expr("t div 86400000") % 7 - 2) / 1e4)
    net = features.weighted_returns(paid, "weight", "close", "funding", 5.0, ["segment"], ["t"])
    gross = F.col("strat") + F.coalesce("funding_paid", F.lit(0.0))
    return net.withColumn("gross", gross).groupBy("segment").agg(
        F.sum("weight").cast("long").alias("long_days"), F.round(stats.total_return(F.col("gross")), 6).alias("gross"), F.round(stats.total_return(F.col("strat")), 6).alias("net"),
        F.round(stats.sharpe(F.col("gross")), 5).alias("sharpe_gross"), F.round(stats.sharpe(F.col("strat")), 5).alias("sharpe_net"), F.round(F.sum("funding_paid"), 6).alias("drag"),
    )


V14 = with_tables("candle_rows", _CLOSES + """, f AS (SELECT *, ((t // 86400000) % 7 - 2) / 1e4::DOUBLE AS funding FROM c),
r AS (SELECT segment, weight, weight * ln(lead(close) OVER w / close) - abs(weight - coalesce(lag(weight) OVER w, 0)) * 0.0005::DOUBLE AS g, weight * lead(funding) OVER w AS paid, ln(lead(close) OVER w / close) AS hold FROM f WINDOW w AS (PARTITION BY segment ORDER BY t))
SELECT segment, CAST(sum(weight) AS BIGINT) AS long_days, round(exp(sum(g)) - 1, 6) AS gross, round(exp(sum(g - paid)) - 1, 6) AS net,
  round(avg(g) / stddev_samp(g) * sqrt(365.0::DOUBLE), 5) AS sharpe_gross, round(avg(g - paid) / stddev_samp(g - paid) * sqrt(365.0::DOUBLE), 5) AS sharpe_net, round(sum(paid), 6) AS drag
FROM r WHERE hold IS NOT NULL GROUP BY 1""")


def _sealed(spark, sf_dir):
    """The daily closes and the manifest that seals their last fifth."""
    closes = A.daily_close(spark, sf_dir)
    n = closes.count()
    numbered = validation.numbered(closes, ["day"])
    return closes, logs.manifest(n, 0.2, validation.seal(numbered.where(F.col("_i") >= int(n * 0.8)).drop("_i"), ["day"], "close"), "daily closes")


def v11_research_rows(spark, sf_dir):
    """The closes that research may see: those before the holdout's boundary."""
    closes, sealed = _sealed(spark, sf_dir)
    return validation.research_rows(closes, ["day"], sealed).select(F.col("day").cast("string").alias("day"), "close")


def v12_reveal(spark, sf_dir):
    """The closes behind the boundary, opened with the phrase after their hash was compared."""
    closes, sealed = _sealed(spark, sf_dir)
    return validation.reveal(closes, ["day"], "close", sealed, validation.REVEAL).select(F.col("day").cast("string").alias("day"), "close")


_CUT = ", i AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS idx, count(*) OVER () AS n FROM daily_close) SELECT CAST(day AS VARCHAR) AS day, close FROM i WHERE idx {} floor(n * 0.8::DOUBLE)"
V11, V12 = with_tables("daily_close", _CUT.format("<")), with_tables("daily_close", _CUT.format(">="))


def o07_concat(spark, sf_dir):
    """Buys and then sells of each instrument as one sequence, numbered through."""
    t = A.ticks(spark, sf_dir).select("instrument", "tid", "side")
    both = t.where("side = 'Buy'").withColumn("part", F.lit(0)).unionByName(t.where("side = 'Sell'").withColumn("part", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("instrument").orderBy("part", "tid"))
    return both.select("instrument", n.cast("long").alias("n"), "tid")


O07 = with_tables("ticks", "SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY side, tid) AS n, tid FROM ticks")


def p13_broken_rules(spark, sf_dir):
    """Engine configurations derived from order requests, with the rules that each breaks."""
    o = A.order_requests(spark, sf_dir)
    rows = o.select(
        "cloid", F.when(F.col("cloid") % 11 > 0, F.col("side")).otherwise("").alias("instrument"), (F.col("px_raw") / 1e8 - 5000).alias("cash"), (F.col("cloid") % 50).alias("fast"), (F.col("cloid") % 70).alias("slow"),
        (F.col("qty_raw") / 1e8).alias("qty"), (F.col("cloid") % 7 - 1).alias("taker_ppm"), F.lit(150).alias("maker_ppm"), (F.col("cloid") % 13 - 1).alias("latency_ms"), F.lit(0).alias("funding_interval_ms"),
    )
    return rows.select("cloid", F.concat_ws(",", config.broken_rules()).alias("broken"))


P13 = with_tables("order_requests", """SELECT cloid, concat_ws(',', CASE WHEN cloid % 11 = 0 THEN 'instrument' END, CASE WHEN NOT px_raw / 1e8::DOUBLE - 5000 > 0 THEN 'cash' END, CASE WHEN NOT (cloid % 50 > 0 AND cloid % 50 < cloid % 70) THEN 'windows' END,
  CASE WHEN NOT qty_raw > 0 THEN 'qty' END, CASE WHEN cloid % 7 - 1 < 0 THEN 'fees' END, CASE WHEN cloid % 13 - 1 < 0 THEN 'latency' END) AS broken FROM order_requests""")


def p23_guarded_inputs(spark, sf_dir):
    """Rows that a feature may not be built on, by what is wrong with them: not finite, not positive, or out of order."""
    t = A.ticks(spark, sf_dir)
    px = F.when(F.col("tid") % 101 == 0, F.lit(float("nan"))).when(F.col("tid") % 103 == 0, 0.0).otherwise(F.col("px_raw") / 1e8)
    fault = features.input_fault(px, F.col("recv_us"), F.lag("recv_us").over(Window.partitionBy("instrument").orderBy("exch_us", "tid")))
    return t.select("instrument", fault.alias("fault")).where("fault IS NOT NULL").groupBy("instrument", "fault").agg(F.count("*").alias("n"))


P23 = with_tables("ticks", """, f AS (SELECT instrument, CASE WHEN tid % 101 = 0 THEN 'not finite' WHEN tid % 103 = 0 OR px_raw <= 0 THEN 'not positive'
  WHEN recv_us < lag(recv_us) OVER (PARTITION BY instrument ORDER BY exch_us, tid) THEN 'out of order' END AS fault FROM ticks)
SELECT instrument, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2""")


def s18_signal_log(spark, sf_dir):
    """Signals of daily closes appended in two runs that overlap: every day stands once."""
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    closes = A.daily_close(spark, sf_dir)
    w = Window.partitionBy(F.year("day")).orderBy("day")
    signals = closes.select(F.col("day").cast("string").alias("day"), F.coalesce((F.col("close") > F.lag("close").over(w)).cast("long"), F.lit(0).cast("long")).alias("signal"))
    logs.append_new(signals.where("day < '1996'"), path, "day")
    logs.append_new(signals, path, "day")
    logs.append_new(signals, path, "day")
    log = spark.read.schema(signals.schema).parquet(path)
    return log.agg(F.count("*").alias("n"), F.sum("signal").alias("longs"), F.max("day").alias("last_day"), F.max_by("signal", "day").alias("last_signal"))


S18 = with_tables("daily_close", """, s AS (SELECT CAST(day AS VARCHAR) AS day, coalesce(CAST(close > lag(close) OVER (PARTITION BY year(day) ORDER BY day) AS BIGINT), 0) AS signal FROM daily_close)
SELECT count(*) AS n, CAST(sum(signal) AS BIGINT) AS longs, max(day) AS last_day, arg_max(signal, day) AS last_signal FROM s""")


def s17_frozen_params(spark, sf_dir):
    """Means and deviations of each segment's returns, frozen to a file and read back under their hash."""
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    c = _closes(spark, sf_dir).groupBy("segment").agg(F.round(F.avg("ret"), 9).alias("mean"), F.round(F.stddev_samp("ret"), 9).alias("deviation"))
    digest = logs.freeze(c, path)
    return logs.frozen(spark, path, digest)


S17 = with_tables("candle_rows", _CLOSES + "SELECT segment, round(avg(ret), 9) AS mean, round(stddev_samp(ret), 9) AS deviation FROM c0 GROUP BY 1")

QUERIES = {
    "s05_backoff": (s05_backoff, S05), "b08_unfilled": (b08_unfilled, B08), "w16_rolling_risk": (w16_rolling_risk, W16), "v14_funding_impact": (v14_funding_impact, V14), "v11_research_rows": (v11_research_rows, V11), "v12_reveal": (v12_reveal, V12),
    "o07_concat": (o07_concat, O07), "p13_broken_rules": (p13_broken_rules, P13), "p23_guarded_inputs": (p23_guarded_inputs, P23), "s17_frozen_params": (s17_frozen_params, S17), "s18_signal_log": (s18_signal_log, S18),
}
