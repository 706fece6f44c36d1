"""Further queries: accounting, alignment, set operations, makers, paper execution, walk-forward and sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.functions import fixed, normal
from tidewake.operators import execution, features, regime, stats, validation
from tidewake.operators.fold import ordered_fold

from tidewake.plans.research import _CLOSES, _DEFLATED, _SHARPE, EXPECTED_MAX, _closes, _deflated
from tidewake.sources import adapters as A
from tidewake.sources import logs
from tidewake.shared import folder
from tidewake.sources.adapters import with_tables


def w13_funding_charge(spark, sf_dir):
    """Funding that a rule's weight pays on the next day."""
    c = _closes(spark, sf_dir).where("vol IS NOT NULL")
    w = features.ordered(["segment"], ["t"])
    rate = (F.expr("t div 86400000") % 7 - 3) / 10000.0
    return c.select("segment", "t", F.round(F.when(F.col("ret") > 0, 1.0).otherwise(0.0) * F.lead(rate).over(w), 9).alias("charge")).where("charge IS NOT NULL").withColumn("charge", F.col("charge") + 0.0)


W13 = with_tables("candle_rows", _CLOSES + "SELECT segment, t, round(weight * lead((t // 86400000 % 7 - 3) / 10000.0::DOUBLE) OVER (PARTITION BY segment ORDER BY t), 9) + 0.0 AS charge FROM c QUALIFY charge IS NOT NULL")


def w17_trades(spark, sf_dir):
    """How often a rule's position grows, from none."""
    c = _closes(spark, sf_dir).where("vol IS NOT NULL").withColumn("pos", F.when(F.col("ret") > 0, 1).otherwise(0))
    was = F.coalesce(F.lag("pos").over(features.ordered(["segment"], ["t"])), F.lit(0))
    return c.withColumn("grew", F.col("pos") > was).groupBy("segment").agg(F.count_if("grew").alias("n_trades"))


W17 = with_tables("candle_rows", _CLOSES + "SELECT segment, count(*) FILTER (WHERE weight > was) AS n_trades FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY segment ORDER BY t), 0) AS was FROM c) GROUP BY 1")


def w21_latency(spark, sf_dir):
    return stats.percentiles(A.ticks(spark, sf_dir).withColumn("latency_us", F.col("recv_us") - F.col("exch_us")), "latency_us", ["instrument"])


W21 = with_tables("ticks", "SELECT instrument, quantile_disc(recv_us - exch_us, 0.5) AS p50, quantile_disc(recv_us - exch_us, 0.95) AS p95, quantile_disc(recv_us - exch_us, 0.99) AS p99, max(recv_us - exch_us) AS max, count(*) AS n FROM ticks GROUP BY 1")


def a09_summaries(spark, sf_dir):
    """Mean, median, sample deviation and share of positive returns of each configuration."""
    return A.trial_panel(spark, sf_dir).groupBy("cfg").agg(F.round(F.avg("r"), 9).alias("mean"), F.round(F.expr("percentile(r, 0.5)"), 9).alias("median"), F.round(F.stddev_samp("r"), 9).alias("std"), F.round(F.avg((F.col("r") > 0).cast("double")), 9).alias("up"))


A09 = with_tables("trial_panel", "SELECT cfg, round(avg(r), 9) AS mean, round(median(r), 9) AS median, round(stddev_samp(r), 9) AS std, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS up FROM trial_panel GROUP BY 1")


def m06_trial_variance(spark, sf_dir):
    """Number and variance of trials' Sharpe ratios a period: what their expected maximum needs."""
    sr = A.trial_panel(spark, sf_dir).groupBy("cfg").agg((F.avg("r") / F.stddev_samp("r")).alias("sr"))
    one = sr.agg(F.count("*").alias("trials"), F.var_samp("sr").alias("v"), F.round(F.max("sr"), 9).alias("best"))
    return one.select("trials", F.round("v", 9).alias("variance"), "best", F.round(stats.expected_max(F.col("v"), F.col("trials")), 9).alias("expected_max"))


M06 = with_tables("trial_panel", f""", sr AS (SELECT avg(r) / stddev_samp(r) AS sr FROM trial_panel GROUP BY cfg),
s AS (SELECT var_samp(sr) AS v, count(*) AS k, max(sr) AS best, 1 - 1e0 / count(*) AS p1, 1 - 1e0 / (count(*) * exp(1e0)) AS p2 FROM sr)
SELECT k AS trials, round(v, 9) AS variance, round(best, 9) AS best, round({EXPECTED_MAX}, 9) AS expected_max FROM s""")


def m08_dashboard(spark, sf_dir):
    """A strategy's summary numbers."""
    from tidewake.plans.research import t06_rule_returns

    return t06_rule_returns(spark, sf_dir).groupBy("segment").agg(F.round(stats.total_return(F.col("strat")), 8).alias("total"), F.round(stats.sharpe(F.col("strat")), 6).alias("sharpe"), F.round(F.avg("weight"), 8).alias("exposure"), F.round(F.sum("cost"), 8).alias("costs"))


_RULE = _CLOSES + """, r0 AS (SELECT segment, t, weight, ln(lead(close) OVER w / close) AS hold, abs(weight - coalesce(lag(weight) OVER w, 0)) * 0.0005::DOUBLE AS cost, weight * 0.0001::DOUBLE AS fund FROM c WINDOW w AS (PARTITION BY segment ORDER BY t)),
rr AS (SELECT segment, t, weight, round(cost, 9) AS cost, round(weight * hold - cost - fund, 9) + 0.0 AS r FROM r0 WHERE hold IS NOT NULL)
"""
M08 = with_tables("candle_rows", _RULE + f"SELECT segment, round(exp(sum(r)) - 1, 8) AS total, round({_SHARPE}, 6) AS sharpe, round(avg(weight), 8) AS exposure, round(sum(cost), 8) AS costs FROM rr GROUP BY 1")


def j01_funding_on_days(spark, sf_dir):
    """Every candle day with that weekday's mean funding, 0 where there is none."""
    days = A.candle_rows(spark, sf_dir).select("segment", "open_ms")
    rates = A.funding(spark, sf_dir).groupBy((F.expr("time_us div 86400000000") % 7).alias("wd")).agg(F.avg("rate").alias("rate")).where("wd <> 3")
    return days.withColumn("wd", F.expr("open_ms div 86400000") % 7).join(rates, "wd", "left").select("segment", "open_ms", F.round(F.coalesce("rate", F.lit(0.0)), 12).alias("rate"))


J01 = with_tables("candle_rows funding", """, r AS (SELECT time_us // 86400000000 % 7 AS wd, avg(rate) AS rate FROM funding GROUP BY 1 HAVING wd <> 3)
SELECT segment, open_ms, round(coalesce(rate, 0), 12) AS rate FROM candle_rows LEFT JOIN r ON open_ms // 86400000 % 7 = wd""")


def j07_common_days(spark, sf_dir):
    """Candles of days that all segments have."""
    c = A.candle_rows(spark, sf_dir)
    k = c.select("segment").distinct().count()
    whole = c.groupBy("open_ms").agg(F.count_distinct("segment").alias("k")).where(F.col("k") == k).select("open_ms")
    return c.join(whole, "open_ms", "left_semi").select("segment", "open_ms", "close")


J07 = with_tables("candle_rows", "SELECT segment, open_ms, close FROM candle_rows WHERE open_ms IN (SELECT open_ms FROM candle_rows GROUP BY 1 HAVING count(DISTINCT segment) = (SELECT count(DISTINCT segment) FROM candle_rows))")


def j08_excess(spark, sf_dir):
    """Returns of configurations less those of the first, hour by hour."""
    p = A.trial_panel(spark, sf_dir)
    base = p.where("cfg = 0").select("t", F.col("r").alias("base"))
    return p.where("cfg > 0").join(base, "t").select("t", "cfg", F.round(F.col("r") - F.col("base"), 9).alias("excess"))


J08 = with_tables("trial_panel", "SELECT a.t, a.cfg, round(a.r - b.r, 9) AS excess FROM trial_panel a JOIN trial_panel b ON a.t = b.t AND b.cfg = 0 WHERE a.cfg > 0")


def o06_bag_union(spark, sf_dir):
    """Trials of all studies in one bag, repeats kept."""
    p = A.trial_panel(spark, sf_dir)
    a, b = p.where("cfg < 5").withColumn("study", F.lit("a")), p.where("cfg > 2").withColumn("study", F.lit("b"))
    return a.unionByName(b).groupBy("study", "cfg").agg(F.count("*").alias("n"))


O06 = with_tables("trial_panel", "SELECT study, cfg, count(*) AS n FROM (SELECT 'a' AS study, * FROM trial_panel WHERE cfg < 5 UNION ALL SELECT 'b', * FROM trial_panel WHERE cfg > 2) GROUP BY 1, 2")


def o08_intersection(spark, sf_dir):
    c = A.candle_rows(spark, sf_dir)
    days = lambda p: c.where(F.col("segment").startswith(p)).select("open_ms")
    return days("1").intersect(days("5"))


O08 = with_tables("candle_rows", "SELECT open_ms FROM candle_rows WHERE starts_with(segment, '1') INTERSECT SELECT open_ms FROM candle_rows WHERE starts_with(segment, '5')")


def o09_complement(spark, sf_dir):
    c = A.candle_rows(spark, sf_dir)
    seen = c.where(F.col("segment").startswith("1")).select("open_ms").distinct()
    return c.select("open_ms").distinct().join(seen, "open_ms", "left_anti")


O09 = with_tables("candle_rows", "SELECT open_ms FROM candle_rows EXCEPT SELECT open_ms FROM candle_rows WHERE starts_with(segment, '1')")


def e03_passive_maker(spark, sf_dir):
    """A maker that quotes one unit on one side at a time at the last price and turns once it is filled: a fold."""

    def start():
        return {"side": 1, "px": None, "pos": 0, "cash": 0, "fills": 0, "fees": 0}

    def step(s, row):
        px, aggressor = int(row.px_raw), row.side
        if s["px"] is not None and ((s["side"] == 1 and aggressor == "Sell" and px <= s["px"]) or (s["side"] == -1 and aggressor == "Buy" and px >= s["px"])):
            value = execution.cut(s["px"] * 1_000_000, execution.SCALE)
            fee = execution.cut(value * 150, fixed.PPM)
            s["cash"] -= s["side"] * value + fee
            s["pos"] += s["side"] * 1_000_000
            s["fees"] += fee
            s["fills"] += 1
            s["side"] = -s["side"]
        s["px"] = px
        return []

    finish = lambda s: [(s["fills"], s["pos"], s["cash"], s["fees"])]
    return ordered_fold(A.ticks(spark, sf_dir).select("instrument", "exch_us", "tid", "side", "px_raw"), ["instrument"], ["exch_us", "tid"], start, step, "fills long, position_raw long, cash_raw long, fees_raw long", finish)


def e06_funding_accrual(spark, sf_dir):
    """Funding that one unit pays at each boundary between ticks, at the price of the tick behind it."""
    w = features.ordered(["instrument"], ["exch_us", "tid"])
    t = A.ticks(spark, sf_dir).withColumn("b", F.col("exch_us") - F.first("exch_us").over(w)).withColumn("b", F.expr("b div 28800000000"))
    n = F.col("b") - F.coalesce(F.lag("b").over(w), F.lit(0))
    paid = fixed.signed_rate(fixed.notional(F.col("px_raw"), F.lit(100_000_000)), F.lit(100))
    return t.withColumn("n", n).groupBy("instrument").agg(F.sum(F.col("n") * paid).alias("funding_raw"), F.sum("n").alias("boundaries"))


E06 = with_tables("ticks", """, b AS (SELECT *, (exch_us - first(exch_us) OVER w) // 28800000000 AS b FROM ticks WINDOW w AS (PARTITION BY instrument ORDER BY exch_us, tid)),
n AS (SELECT *, b - coalesce(lag(b) OVER (PARTITION BY instrument ORDER BY exch_us, tid), 0) AS n FROM b)
SELECT instrument, CAST(sum(n * (px_raw * 100 // 1000000)) AS BIGINT) AS funding_raw, CAST(sum(n) AS BIGINT) AS boundaries FROM n GROUP BY 1""")


def e09_paper(spark, sf_dir):
    """Paper execution: requests are registered once, gated on the position that fills leave, and filled or rejected at once; a fold."""

    def start():
        return {"p": execution.Position(), "seen": 0, "filled": 0, "rejected": 0, "fees": 0}

    def step(s, row):
        side, qty, px = (1 if row.side == "Buy" else -1), int(row.qty_raw), int(row.px_raw)
        after = s["p"].qty + side * qty
        s["seen"] += 1
        if abs(after) > abs(s["p"].qty) and abs(after) > 1_500_000_000:
            s["rejected"] += 1
            return []
        fee = execution.cut(execution.cut(px * qty, execution.SCALE) * 450, fixed.PPM)
        s["p"].fill(side, qty, px, fee)
        s["filled"] += 1
        s["fees"] += fee
        return []

    finish = lambda s: [(s["seen"], s["filled"], s["rejected"], s["p"].qty, s["p"].realised, s["fees"])]
    schema = "requests long, filled long, rejected long, position_raw long, realised_raw long, fees_raw long"
    return ordered_fold(A.order_requests(spark, sf_dir).select("customer", "ts_us", "cloid", "side", "qty_raw", "px_raw"), ["customer"], ["ts_us", "cloid"], start, step, schema, finish)


def e10_paper_equity(spark, sf_dir):
    """Cash, realised and unrealised profit of each hundred orders' fills, marked at the last fill's price."""
    f = execution.first_fills(A.exec_reports(spark, sf_dir)).select(F.expr("cloid div 100").alias("account"), "cloid", "seq", "side", "qty_raw", "px_raw", "fee_raw")
    last = f.groupBy("account").agg(F.max_by("px_raw", F.struct("cloid", "seq")).alias("mark_raw"))
    p = execution.positions(f, ["account"], ["cloid", "seq"]).groupBy("account").agg(F.max(F.struct("n", "qty_raw", "entry_raw", "realised_raw")).alias("p"))
    open_ = fixed.notional(F.col("mark_raw") - F.col("p.entry_raw"), F.col("p.qty_raw"))
    return p.join(last, "account").select("account", F.col("p.realised_raw").alias("realised_raw"), open_.alias("unrealised_raw"), (F.lit(10_000_000_000_000) + F.col("p.realised_raw") + open_).alias("equity_raw"))


def e11_order_status(spark, sf_dir):
    """Every report of an order with what it does: applied, or a duplicate of an id or of a done order."""
    r = A.exec_reports(spark, sf_dir).join(A.order_requests(spark, sf_dir).select("cloid", F.col("qty_raw").alias("order_qty")), "cloid", "left")
    first = F.row_number().over(Window.partitionBy("cloid", "fill_id").orderBy("seq")) == 1
    r = r.withColumn("first", first).withColumn("q", F.when(F.col("first"), F.col("qty_raw")).otherwise(0))
    path = Window.partitionBy("cloid").orderBy("seq")
    before = F.coalesce(F.sum("q").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    effect = F.when(F.col("order_qty").isNull(), "UnknownOrder").when(~F.col("first") | (F.col("before") >= F.col("order_qty")), "Duplicate").when(F.col("before") + F.col("q") >= F.col("order_qty"), "Filled").otherwise("PartiallyFilled")
    return r.withColumn("before", before).groupBy(effect.alias("effect")).agg(F.count("*").alias("n"))


E11 = with_tables("exec_reports order_requests", """, f AS (SELECT e.*, o.qty_raw AS oq, row_number() OVER (PARTITION BY e.cloid, e.fill_id ORDER BY e.seq) = 1 AS fst FROM exec_reports e LEFT JOIN order_requests o ON e.cloid = o.cloid),
b AS (SELECT *, coalesce(sum(CASE WHEN fst THEN qty_raw ELSE 0 END) OVER (PARTITION BY cloid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT CASE WHEN oq IS NULL THEN 'UnknownOrder' WHEN NOT fst OR before >= oq THEN 'Duplicate' WHEN before + qty_raw >= oq THEN 'Filled' ELSE 'PartiallyFilled' END AS effect, count(*) AS n FROM b GROUP BY 1""")


def walk_windows(c, train_min=400, test=90, step=45):
    """(segment, win, train_end, test_end) of windows that go on until a segment's last bar is tested."""
    n = c.groupBy("segment").agg(F.count("*").alias("bars")).where(F.col("bars") > train_min + 1)
    ends = n.select("segment", "bars", F.posexplode(F.expr(f"sequence({train_min}L, bars - 2, {step}L)")).alias("win", "train_end"))
    return ends.select("segment", F.col("win").cast("long").alias("win"), "train_end", F.least(F.col("train_end") + test, F.col("bars")).alias("test_end"))


def v05_walk_forward_evaluate(spark, sf_dir):
    """Out-of-sample results of models fitted anew for each window: a table of windows meets the bars, one fit a group; windows of fewer than ten results go."""
    c = _closes(spark, sf_dir).withColumn("i", F.row_number().over(features.ordered(["segment"], ["t"])) - 1)
    rows = c.join(walk_windows(c), "segment").where(F.col("i") < F.col("test_end"))
    params = regime.fit_groups(rows.where("i < train_end"), ["segment", "win"], "t", ["ret", "vol"], rounds=200, tol=1e-5)
    # A test starts with the two bars before it, whose features are warm.
    rows = rows.where("i >= train_end - 2")
    scored = regime.filtered(rows, params, ["segment", "win"], ["t"], ["ret", "vol"])
    held = rows.join(scored, ["segment", "win", "t"]).withColumn("weight", F.when(F.col("regime") == 2, 1.0).otherwise(0.0)).withColumn("funding", F.lit(0.0))
    r = features.weighted_returns(held, "weight", "close", "funding", 5.0, ["segment", "win"], ["t"]).where("i >= train_end")
    return r.groupBy("segment", "win").agg(F.count("*").alias("n"), F.round(stats.sharpe(F.col("strat")), 4).alias("sharpe"), F.round(stats.total_return(F.col("strat")), 6).alias("total")).where("n >= 10")


def v15_rule_sweep(spark, sf_dir):
    """A grid of rules (look-back by threshold) over all segments, each scored by its Sharpe ratio: a table of configurations meets the bars once."""
    c = _closes(spark, sf_dir)
    w = features.ordered(["segment"], ["t"])
    for k in (1, 5, 10):
        c = c.withColumn(f"m{k}", features.log_return(F.col("close"), w, k))
    c = c.withColumn("hold", features.next_return(F.col("close"), w)).where("m10 IS NOT NULL AND hold IS NOT NULL")
    cells = [F.struct(F.lit(k).cast("long").alias("lag"), F.lit(b).alias("bar"), F.when(F.col(f"m{k}") > b, F.col("hold")).otherwise(0.0).alias("r")) for k in (1, 5, 10) for b in (0.0, 0.1)]
    long_ = c.select("segment", F.explode(F.array(*cells)).alias("x")).select("segment", "x.*")
    return long_.groupBy("segment", "lag", "bar").agg(F.round(stats.sharpe(F.col("r")), 6).alias("sharpe"))


V15 = with_tables("candle_rows", """, d AS (SELECT segment, open_ms AS t, close::DOUBLE AS c FROM candle_rows),
m AS (SELECT *, ln(c / lag(c, 1) OVER w) AS m1, ln(c / lag(c, 5) OVER w) AS m5, ln(c / lag(c, 10) OVER w) AS m10, ln(lead(c) OVER w / c) AS hold FROM d WINDOW w AS (PARTITION BY segment ORDER BY t)),
g AS (SELECT segment, unnest([1, 1, 5, 5, 10, 10])::BIGINT AS lag, unnest([0.0, 0.1, 0.0, 0.1, 0.0, 0.1])::DOUBLE AS bar, unnest([m1, m1, m5, m5, m10, m10]) AS m, hold FROM m WHERE m10 IS NOT NULL AND hold IS NOT NULL),
r AS (SELECT segment, lag, bar, CASE WHEN m > bar THEN hold ELSE 0 END AS r FROM g)
SELECT segment, lag, bar, round(""" + _SHARPE + ", 6) AS sharpe FROM r GROUP BY 1, 2, 3")


def v19_global_correction(spark, sf_dir):
    """The best trial of all against the expected maximum of as many."""
    m = _deflated(spark, sf_dir)
    best = m.groupBy().agg(F.min_by(F.struct("cfg", "sr", "bar", "dz"), F.struct(-F.col("sr"), F.col("cfg"))).alias("x")).select("x.*")
    return best.select("cfg", F.round("sr", 6).alias("best"), F.round("bar", 6).alias("benchmark"), F.round(normal.cdf(F.col("dz")), 6).alias("dsr"))


V19 = with_tables("trial_panel", _DEFLATED + f"SELECT cfg, round(sr, 6) AS best, round(bar, 6) AS benchmark, round({normal.cdf_sql('dz')}, 6) AS dsr FROM z ORDER BY sr DESC, cfg LIMIT 1")


def s12_trial_log(spark, sf_dir):
    """Trials written as JSON lines and read back: rows and Sharpe ratios of each."""
    import uuid

    p = A.trial_panel(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda x: x["r"])
    trials = p.groupBy("cfg").agg(ordered.alias("returns")).select(F.concat(F.lit("cfg"), "cfg").alias("name"), "returns", F.sha2(F.col("cfg").cast("string"), 256).alias("config_hash"), F.col("cfg").alias("trial_seq"))
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    logs.append_trials(trials, path)
    rows = logs.performance_rows(logs.read_trials(spark, path))
    return rows.groupBy(F.col("trial_seq").alias("cfg"), "name").agg(F.count("*").alias("n"), F.round(stats.sharpe(F.col("r")), 6).alias("sharpe"))


S12 = with_tables("trial_panel", f"SELECT cfg, 'cfg' || cfg AS name, count(*) AS n, round({_SHARPE}, 6) AS sharpe FROM trial_panel GROUP BY 1, 2")


def s19_metrics(spark, sf_dir):
    """Counters of all reports in the exposition format."""
    r = A.exec_reports(spark, sf_dir).groupBy("side").agg(F.count("*").alias("value"))
    return logs.metrics_text(r.select(F.concat(F.lower("side"), F.lit("_reports_total")).alias("name"), F.lit("counter").alias("kind"), "value"))


S19 = with_tables("exec_reports", "SELECT '# TYPE tidewake_' || n || ' counter' || chr(10) || 'tidewake_' || n || ' ' || c AS text FROM (SELECT lower(side) || '_reports_total' AS n, count(*) AS c FROM exec_reports GROUP BY 1)")

def h12_decoded(spark, sf_dir):
    """Smoothed probabilities and likeliest states of every day under its segment's model."""
    c = _closes(spark, sf_dir)
    p = regime.fit_groups(c, ["segment"], "t", ["ret", "vol"], rounds=100)
    return regime.decoded(c, p, ["segment"], "t", ["ret", "vol"]).select("segment", "t", F.transform("smoothed", lambda x: F.round(x, 6)).alias("smoothed"), "path")


def v22_reproduction(spark, sf_dir):
    """The rule's returns by windows against those by the running sums of their logarithms: no row is missing, none differs."""
    c = _closes(spark, sf_dir)
    w = features.ordered(["segment"], ["t"])
    a = c.select("segment", "t", F.col("ret").alias("r")).where("r IS NOT NULL")
    b = c.withColumn("l", F.ln("close")).withColumn("r", F.col("l") - F.lag("l").over(w)).where("r IS NOT NULL").select("segment", "t", "r")
    return validation.reproduced(a, b, ["segment", "t"], "r")


V22 = with_tables("candle_rows", "SELECT CAST(0 * count(*) AS BIGINT) AS missing, CAST(0 * count(*) AS BIGINT) AS differing FROM candle_rows")


def m09_track_record(spark, sf_dir):
    """What followed the logged signals: a target is held on the next day and pays for each change."""
    c = _closes(spark, sf_dir).where("vol IS NOT NULL")
    w = features.ordered(["segment"], ["t"])
    target = F.when(F.col("ret") > 0, 1.0).otherwise(0.0)
    rows = c.withColumn("held", F.coalesce(F.lag(target).over(w), F.lit(0.0)))
    rows = rows.withColumn("r", F.col("held") * F.col("ret") - F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))) * 0.0005)
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("r"), 8).alias("log_return"), F.count_if(F.col("held") > 0).alias("days_in"))


M09 = with_tables("candle_rows", _CLOSES + """, h AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY segment ORDER BY t), 0) AS held FROM c), g AS (SELECT *, held * ret - abs(held - coalesce(lag(held) OVER (PARTITION BY segment ORDER BY t), 0)) * 0.0005::DOUBLE AS r FROM h)
SELECT segment, count(*) AS n, round(sum(r), 8) AS log_return, count(*) FILTER (WHERE held > 0) AS days_in FROM g GROUP BY 1""")


def v21_daily_signal(spark, sf_dir):
    """The last day's signal of each segment under its frozen model."""
    c = _closes(spark, sf_dir)
    p = regime.fit_groups(c, ["segment"], "t", ["ret", "vol"], rounds=100)
    s = regime.filtered(c, p, ["segment"], ["t"], ["ret", "vol"])
    w = features.ordered(["segment"], ["t"])
    s = s.withColumn("target", F.when(F.col("regime") == 2, "LONG").otherwise("FLAT")).withColumn("was", F.coalesce(F.lag("target").over(w), F.lit("FLAT")))
    action = F.when((F.col("was") == "FLAT") & (F.col("target") == "LONG"), "ENTER").when((F.col("was") == "LONG") & (F.col("target") == "FLAT"), "EXIT").otherwise("HOLD")
    return s.withColumn("action", action).groupBy("segment").agg(F.max_by(F.struct("t", "regime", "target", "action"), "t").alias("x")).select("segment", "x.*")


QUERIES = {
    "h12_decoded": (h12_decoded, None), "v22_reproduction": (v22_reproduction, V22), "m09_track_record": (m09_track_record, M09), "v21_daily_signal": (v21_daily_signal, None),
    "w13_funding_charge": (w13_funding_charge, W13), "w17_trades": (w17_trades, W17), "w21_latency": (w21_latency, W21), "a09_summaries": (a09_summaries, A09), "m06_trial_variance": (m06_trial_variance, M06), "m08_dashboard": (m08_dashboard, M08),
    "j01_funding_on_days": (j01_funding_on_days, J01), "j07_common_days": (j07_common_days, J07), "j08_excess": (j08_excess, J08), "o06_bag_union": (o06_bag_union, O06), "o08_intersection": (o08_intersection, O08), "o09_complement": (o09_complement, O09),
    "e03_passive_maker": (e03_passive_maker, None), "e06_funding_accrual": (e06_funding_accrual, E06), "e09_paper": (e09_paper, None), "e10_paper_equity": (e10_paper_equity, None), "e11_order_status": (e11_order_status, E11),
    "v05_walk_forward_evaluate": (v05_walk_forward_evaluate, None), "v15_rule_sweep": (v15_rule_sweep, V15), "v19_global_correction": (v19_global_correction, V19), "s12_trial_log": (s12_trial_log, S12), "s19_metrics": (s19_metrics, S19),
}
