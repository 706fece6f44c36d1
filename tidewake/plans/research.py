"""Queries of statistics, validation, regime models and strategies (M, V, H, C, T, S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.functions import normal
from tidewake.operators import features, regime, scan, splits, stats, validation
from tidewake.sources import adapters as A
from tidewake.sources import config
from tidewake.sources.adapters import with_tables


def m01_sharpe(spark, sf_dir):
    return A.trial_panel(spark, sf_dir).groupBy("cfg").agg(F.round(stats.sharpe(F.col("r")), 6).alias("sharpe"))


_SHARPE = "CASE WHEN stddev_samp(r) = 0 THEN 0 ELSE avg(r) / stddev_samp(r) * sqrt(365.0::DOUBLE) END"
M01 = with_tables("trial_panel", f"SELECT cfg, round({_SHARPE}, 6) AS sharpe FROM trial_panel GROUP BY 1")


def m02_sortino(spark, sf_dir):
    return A.trial_panel(spark, sf_dir).groupBy("cfg").agg(F.round(stats.sortino(F.col("r")), 6).alias("sortino"))


M02 = with_tables("trial_panel", "SELECT cfg, round(avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(365.0::DOUBLE), 6) AS sortino FROM trial_panel GROUP BY 1")


def m03_max_drawdown(spark, sf_dir):
    return stats.drawdown_rows(A.trial_panel(spark, sf_dir), "r", ["cfg"], ["t"]).groupBy("cfg").agg(F.round(F.max("drawdown"), 8).alias("max_drawdown"))


M03 = with_tables("trial_panel", """, e AS (SELECT cfg, t, exp(sum(ln(1 + r)) OVER (PARTITION BY cfg ORDER BY t)) AS eq FROM trial_panel), p AS (SELECT *, max(eq) OVER (PARTITION BY cfg ORDER BY t) AS pk FROM e)
SELECT cfg, round(max((pk - eq) / pk), 8) AS max_drawdown FROM p GROUP BY 1""")


def m04_returns(spark, sf_dir):
    w = F.signum("r")
    return A.trial_panel(spark, sf_dir).groupBy("cfg").agg(F.round(stats.total_return(F.col("r")), 8).alias("total"), F.round(F.avg(F.abs(w)), 8).alias("exposure"), F.round(F.avg((w > 0).cast("double")), 8).alias("time_in_market"))


M04 = with_tables("trial_panel", "SELECT cfg, round(exp(sum(r)) - 1, 8) AS total, round(avg(abs(sign(r))), 8) AS exposure, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 8) AS time_in_market FROM trial_panel GROUP BY 1")


def _psr(spark, sf_dir):
    m = stats.moments(A.trial_panel(spark, sf_dir), "r", ["cfg"]).withColumn("sr", F.col("mean") / F.col("deviation"))
    return m.withColumn("z", stats.psr_z(F.col("sr"), F.lit(0.0), F.col("n"), F.col("g1"), F.col("g2")))


def m05_psr(spark, sf_dir):
    """z of the probabilistic Sharpe ratio against 0, with the moments that it needs."""
    return _psr(spark, sf_dir).select("cfg", "n", F.round("g1", 5).alias("g1"), F.round("g2", 5).alias("g2"), F.round("z", 5).alias("z"))


_MOMENTS = """, mu AS (SELECT cfg, avg(r) AS m, count(*) AS n FROM trial_panel GROUP BY 1),
mo AS (SELECT p.cfg, mu.n, mu.m, sum((r - m) ** 2) AS s2, sum((r - m) ** 3) / mu.n AS m3, sum((r - m) ** 4) / mu.n AS m4 FROM trial_panel p JOIN mu ON p.cfg = mu.cfg GROUP BY 1, 2, 3),
g AS (SELECT cfg, n, m / sqrt(s2 / (n - 1)) AS sr, sqrt(n * (n - 1)::DOUBLE) / (n - 2) * m3 / (s2 / n) ** 1.5 AS g1, (n - 1) / ((n - 2) * (n - 3)::DOUBLE) * ((n + 1) * m4 / (s2 / n) ** 2 - 3 * (n - 1)) + 3 AS g2 FROM mo)
"""
M05 = with_tables("trial_panel", _MOMENTS + "SELECT cfg, n, round(g1, 5) AS g1, round(g2, 5) AS g2, round(sr * sqrt(n - 1::DOUBLE) / sqrt(1 - g1 * sr + (g2 - 1) / 4 * sr * sr), 5) AS z FROM g")


def _deflated(spark, sf_dir):
    """Trials' moments with the expected maximum of as many ratios, ``bar``, of the one row of all."""
    m = _psr(spark, sf_dir)
    bar = m.agg(F.var_samp("sr").alias("v"), F.count("*").alias("k")).select(stats.expected_max(F.col("v"), F.col("k")).alias("bar"))
    return m.crossJoin(F.broadcast(bar)).withColumn("dz", stats.psr_z(F.col("sr"), F.col("bar"), F.col("n"), F.col("g1"), F.col("g2")))


def m07_deflated(spark, sf_dir):
    """Probabilistic Sharpe ratios of all trials against 0 and against their expected maximum."""
    return _deflated(spark, sf_dir).select("cfg", F.round(normal.cdf(F.col("z")), 6).alias("psr"), F.round(normal.cdf(F.col("dz")), 6).alias("dsr"))


#: Of ``v`` and ``k``, the variance and number of all trials' ratios.
EXPECTED_MAX = f"CASE WHEN k >= 2 AND v > 0 THEN sqrt(v) * ({1 - stats.EULER!r}e0 * ({normal.inverse_sql('p1')}) + {stats.EULER!r}e0 * ({normal.inverse_sql('p2')})) ELSE 0e0 END"
_DEFLATED = _MOMENTS.rstrip() + f""",
s AS (SELECT var_samp(sr) AS v, count(*) AS k, 1 - 1e0 / count(*) AS p1, 1 - 1e0 / (count(*) * exp(1e0)) AS p2 FROM g), bar AS (SELECT {EXPECTED_MAX} AS bar FROM s),
z AS (SELECT cfg, sr, bar, sr * sqrt(n - 1::DOUBLE) / sqrt(1 - g1 * sr + (g2 - 1) / 4 * sr * sr) AS z, (sr - bar) * sqrt(n - 1::DOUBLE) / sqrt(1 - g1 * sr + (g2 - 1) / 4 * sr * sr) AS dz FROM g, bar)
"""
M07 = with_tables("trial_panel", _DEFLATED + f"SELECT cfg, round({normal.cdf_sql('z')}, 6) AS psr, round({normal.cdf_sql('dz')}, 6) AS dsr FROM z")


def v01_walk_forward(spark, sf_dir):
    """Training and test rows of walk-forward splits over the days of all orders."""
    n = A.daily_close(spark, sf_dir).count()
    return validation.walk_forward(spark, n, 5, 10).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"))


V01 = with_tables("daily_close", """, n AS (SELECT count(*) AS n FROM daily_close), f AS (SELECT unnest(range(1, 6)) AS fold, n // 6 AS size FROM n),
r AS (SELECT fold, size, unnest(range(0, fold * size + size)) AS idx FROM f), x AS (SELECT fold, CASE WHEN idx >= fold * size THEN 'test' WHEN idx < fold * size - 10 THEN 'train' END AS role, idx FROM r)
SELECT fold, role, count(*) AS n, min(idx) AS low, max(idx) AS high FROM x WHERE role IS NOT NULL GROUP BY 1, 2""")


def v02_purged_kfold(spark, sf_dir):
    n = A.daily_close(spark, sf_dir).count()
    return validation.purged_kfold(spark, n, 5, 10).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"))


V02 = with_tables("daily_close", """, n AS (SELECT count(*) AS n FROM daily_close), f AS (SELECT fold, n, (fold - 1) * (n // 5) + least(fold - 1, n % 5) AS a, fold * (n // 5) + least(fold, n % 5) AS b FROM (SELECT unnest(range(1, 6)) AS fold, n FROM n)),
r AS (SELECT fold, a, b, unnest(range(0, n)) AS idx FROM f), x AS (SELECT fold, idx, CASE WHEN idx >= a AND idx < b THEN 'test' WHEN idx < a - 10 OR idx >= b + 10 THEN 'train' END AS role FROM r)
SELECT fold, role, count(*) AS n, min(idx) AS low, max(idx) AS high FROM x WHERE role IS NOT NULL GROUP BY 1, 2""")


def v04_leaks(spark, sf_dir):
    """Training rows of walk-forward splits that leak, by length of the label's span."""
    n = A.daily_close(spark, sf_dir).count()
    splits = validation.walk_forward(spark, n, 5, 10)
    counted = [validation.leaks(splits, span, True).agg(F.lit(span).cast("long").alias("span"), F.count("*").alias("leaks")) for span in (1, 10, 15)]
    return counted[0].union(counted[1]).union(counted[2])


V04 = with_tables("daily_close", """, n AS (SELECT count(*) AS n FROM daily_close), f AS (SELECT unnest(range(1, 6)) AS fold, n // 6 AS size FROM n), r AS (SELECT fold, size, unnest(range(0, fold * size - 10)) AS idx FROM f),
s AS (SELECT unnest([1, 10, 15])::BIGINT AS span)
SELECT span, count(*) FILTER (WHERE idx + span > fold * size) AS leaks FROM r, s GROUP BY 1""")


def v07_cscv(spark, sf_dir):
    """Probability of backtest overfitting, loss probability and medians of all ways to halve ten blocks."""
    p = A.trial_panel(spark, sf_dir)
    length = p.agg(F.max("t")).first()[0] + 1
    c = validation.cscv(p, 10, length)
    return c.agg(F.count("*").alias("splits"), F.round(F.avg((F.col("logit") <= 0).cast("double")), 6).alias("pbo"), F.round(F.avg((F.col("oos") < 0).cast("double")), 6).alias("loss"), F.round(F.median("logit"), 6).alias("median_logit"), F.round(F.median("oos"), 6).alias("median_oos"))


V07 = with_tables("trial_panel", """, l AS (SELECT (max(t) + 1) // 10 AS per FROM trial_panel), b AS (SELECT t // per AS block, cfg, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM trial_panel, l WHERE t < per * 10 GROUP BY 1, 2),
m AS (SELECT m FROM (SELECT unnest(range(1024)) AS m) WHERE bit_count(m::BIGINT) = 5),
h AS (SELECT m, cfg, (m >> block::BIGINT) & 1 AS ins, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM m, b GROUP BY 1, 2, 3),
x AS (SELECT m, cfg, ins, round(CASE WHEN (q - s * s / n) / (n - 1) > 1e-18 THEN s / n / sqrt((q - s * s / n) / (n - 1)) ELSE 0 END, 9) AS sh FROM h),
y AS (SELECT m, cfg, max(sh) FILTER (WHERE ins = 1) AS i, max(sh) FILTER (WHERE ins = 0) AS o FROM x GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY i DESC, cfg) AS place, rank() OVER (PARTITION BY m ORDER BY o) + (count(*) OVER (PARTITION BY m, o) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY m) AS k FROM y),
w AS (SELECT greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, rk / (k + 1))) AS om, o FROM z WHERE place = 1)
SELECT count(*) AS splits, round(avg(CASE WHEN ln(om / (1 - om)) <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pbo, round(avg(CASE WHEN o < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS loss, round(median(ln(om / (1 - om))), 6) AS median_logit, round(median(o), 6) AS median_oos FROM w""")


def v08_bootstrap_path(spark, sf_dir):
    """Stationary bootstrap paths over hours, with draws from tick prices and ids."""
    d = A.ticks(spark, sf_dir).select(F.expr("tid div 500").alias("rep"), (F.col("tid") % 500).alias("t"), (F.expr("px_raw div 1000000") * 7919 % 1000 / 1000.0).alias("u"), (F.expr("px_raw div 1000000") * 104729 % 997 / 997.0).alias("v"))
    return validation.bootstrap_path(d, 500, 10.0)


V08 = with_tables("ticks", """, d AS (SELECT tid // 500 AS rep, tid % 500 AS t, ((px_raw // 1000000) * 7919 % 1000) / 1000.0::DOUBLE AS u, ((px_raw // 1000000) * 104729 % 997) / 997.0::DOUBLE AS v FROM ticks),
j AS (SELECT *, CASE WHEN t = 0 OR u < 0.1::DOUBLE THEN t END AS jt, CASE WHEN t = 0 OR u < 0.1::DOUBLE THEN CAST(floor(v * 500) AS BIGINT) END AS js FROM d)
SELECT rep, t, (last_value(js IGNORE NULLS) OVER w + t - last_value(jt IGNORE NULLS) OVER w) % 500 AS idx FROM j WINDOW w AS (PARTITION BY rep ORDER BY t ROWS UNBOUNDED PRECEDING)""")


def v09_reality_check(spark, sf_dir):
    """White's reality check and the simplified SPA test of all configurations."""
    p = A.trial_panel(spark, sf_dir)
    length = p.agg(F.max("t")).first()[0] + 1
    r = validation.reality_check(p, length, 500, 10.0, 17)
    return r.select(*(F.round(c, 6).alias(c) for c in ("stat", "rc_p", "spa_stat", "spa_p")), "k_kept")


V09 = with_tables("trial_panel", f""", l AS (SELECT max(t) + 1 AS len FROM trial_panel), grid AS (SELECT rep, unnest(range(len)) AS t, len FROM (SELECT unnest(range(500)) AS rep), l),
d AS (SELECT *, {normal.even_sql("rep", "t", seed=17)} AS u, {normal.even_sql("rep", "t", seed=18)} AS v FROM grid),
j AS (SELECT *, CASE WHEN t = 0 OR u < 0.1e0 THEN t END AS jt, CASE WHEN t = 0 OR u < 0.1e0 THEN CAST(floor(v * len) AS BIGINT) END AS js FROM d),
p AS (SELECT rep, (last_value(js IGNORE NULLS) OVER w + t - last_value(jt IGNORE NULLS) OVER w) % len AS idx FROM j WINDOW w AS (PARTITION BY rep ORDER BY t ROWS UNBOUNDED PRECEDING)),
n AS (SELECT rep, idx, count(*) AS n FROM p GROUP BY 1, 2), boot AS (SELECT rep, cfg, sum(n * r) / max(len) AS m FROM n JOIN trial_panel ON t = idx, l GROUP BY 1, 2),
mean AS (SELECT cfg, sum(r) / max(len) AS mean FROM trial_panel, l GROUP BY 1), o AS (SELECT rep, b.cfg, mean, m - mean AS d FROM boot b JOIN mean ON mean.cfg = b.cfg),
om AS (SELECT cfg, mean, sqrt(avg(d * d) * max(len)) AS omega, max(len) AS len FROM o, l GROUP BY 1, 2),
k AS (SELECT cfg, omega, z, z >= -sqrt(2 * ln(ln(len))) AS kept FROM (SELECT *, CASE WHEN omega > 0 THEN sqrt(len) * mean / omega ELSE 0 END AS z FROM om)),
tops AS (SELECT greatest(max(z), 0) AS stat, greatest(coalesce(max(z) FILTER (WHERE kept), 0), 0) AS spa_stat, count(*) FILTER (WHERE kept) AS k_kept FROM k),
x AS (SELECT rep, kept, CASE WHEN omega > 0 THEN sqrt(len) * d / omega ELSE 0 END AS w FROM o JOIN k ON k.cfg = o.cfg, l),
m AS (SELECT rep, greatest(max(w), 0) AS top, greatest(coalesce(max(w) FILTER (WHERE kept), 0), 0) AS kept_top FROM x GROUP BY 1)
SELECT round(max(stat), 6) AS stat, round(avg(CASE WHEN top >= stat THEN 1e0 ELSE 0 END), 6) AS rc_p, round(max(spa_stat), 6) AS spa_stat, round(avg(CASE WHEN kept_top >= spa_stat THEN 1e0 ELSE 0 END), 6) AS spa_p, max(k_kept) AS k_kept FROM m, tops""")


def v03_configured_splits(spark, sf_dir):
    """The daily closes by the splits of two study configurations, one a scheme: rows, places and sums of each fold and role."""
    days = scan.placed(A.daily_close(spark, sf_dir), [], ["day"], "idx")
    n, out = days.count(), None
    for scheme in splits.SCHEMES:
        study = config.study_config({"features": [("sma", {})], "scheme": scheme, "n_splits": 5, "embargo": 10})
        held = splits.rows(days, "idx", splits.of_config(study, n), 100).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.round(F.sum("close"), 2).alias("close"))
        held = held.select(F.lit(scheme).alias("scheme"), "*")
        out = held if out is None else out.unionByName(held)
    return out


V03 = with_tables("daily_close", """, i AS (SELECT close, row_number() OVER (ORDER BY day) - 1 AS idx, count(*) OVER () AS n FROM daily_close), f AS (SELECT unnest(range(1, 6)) AS fold),
w AS (SELECT 'walk_forward' AS scheme, fold, CASE WHEN idx >= fold * (n // 6) AND idx < (fold + 1) * (n // 6) THEN 'test' WHEN idx < fold * (n // 6) - 10 THEN 'train' END AS role, idx, close FROM i, f),
b AS (SELECT *, (fold - 1) * (n // 5) + least(fold - 1, n % 5) AS a, fold * (n // 5) + least(fold, n % 5) AS z FROM i, f),
k AS (SELECT 'purged_kfold' AS scheme, fold, CASE WHEN idx >= a AND idx < z THEN 'test' WHEN idx < a - 10 OR idx >= z + 10 THEN 'train' END AS role, idx, close FROM b)
SELECT scheme, fold, role, count(*) AS n, min(idx) AS low, max(idx) AS high, round(sum(close), 2) AS close FROM (SELECT * FROM w UNION ALL SELECT * FROM k) WHERE role IS NOT NULL GROUP BY 1, 2, 3""")


def v10_holdout(spark, sf_dir):
    """Rows of the daily closes before and behind the holdout's boundary."""
    n = A.daily_close(spark, sf_dir).count()
    cut = int(n * 0.8)
    idx = F.row_number().over(Window.orderBy("day")) - 1
    # One row a day: some thousand rows, whatever the number of orders.
    return A.daily_close(spark, sf_dir).withColumn("idx", idx).groupBy(F.when(F.col("idx") < cut, "research").otherwise("holdout").alias("part")).agg(F.count("*").alias("n"), F.min("day").cast("string").alias("first_day"))


V10 = with_tables("daily_close", """, i AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS idx, count(*) OVER () AS n FROM daily_close)
SELECT CASE WHEN idx < floor(n * 0.8::DOUBLE) THEN 'research' ELSE 'holdout' END AS part, count(*) AS n, CAST(min(day) AS VARCHAR) AS first_day FROM i GROUP BY 1""")


def _closes(spark, sf_dir):
    """Daily closes of each order priority with returns and volatility."""
    c = A.candle_rows(spark, sf_dir).select("segment", F.col("open_ms").alias("t"), F.col("close").cast("double").alias("close"))
    w = features.ordered(["segment"], ["t"])
    c = c.withColumn("ret", features.log_return(F.col("close"), w))
    return c.withColumn("vol", features.realized_vol("ret", w, 20))


def h08_hmm_fit(spark, sf_dir):
    """One fitted three-state model a segment: log-likelihood and means, in order."""
    p = regime.fit_groups(_closes(spark, sf_dir), ["segment"], "t", ["ret", "vol"], rounds=100)
    return p.select("segment", "n", F.round("loglik", 3).alias("loglik"), F.round(F.col("means")[0], 4).alias("mean_low"), F.round(F.col("means")[4], 4).alias("mean_high"))


def h11_hmm_filter(spark, sf_dir):
    """Causal regime of every day under its segment's model."""
    c = _closes(spark, sf_dir)
    p = regime.fit_groups(c, ["segment"], "t", ["ret", "vol"], rounds=100)
    return regime.filtered(c, p, ["segment"], ["t"], ["ret", "vol"]).select("segment", "t", F.transform("probs", lambda x: F.round(x, 6)).alias("probs"), "regime")


def c01_run_lengths(spark, sf_dir):
    """Run-length posterior of every segment's standardised returns; the chance of a fresh run is the hazard."""
    c = _closes(spark, sf_dir)
    w = features.ordered(["segment"], ["t"])
    before = F.lag("vol").over(w)
    z = c.withColumn("z", F.when(before > 0, F.col("ret") / before))
    return regime.run_lengths(z, "z", ["segment"], ["t"], 100.0, 500).select("segment", "t", F.round("p_change", 9).alias("p_change"), "run_length")


def c04_changepoints(spark, sf_dir):
    """Onsets where the likeliest run length falls by more than five."""
    r = c01_run_lengths(spark, sf_dir)
    w = features.ordered(["segment"], ["t"])
    i = r.withColumn("i", F.row_number().over(w) - 1).withColumn("drop", F.col("run_length") - F.lag("run_length").over(w))
    return i.where("drop < -5").select("segment", F.greatest(F.col("i") - F.col("run_length"), F.lit(0)).cast("long").alias("onset")).distinct()


def t06_rule_returns(spark, sf_dir):
    """Returns after costs of a rule that holds where the last return was positive."""
    c = _closes(spark, sf_dir).where("vol IS NOT NULL").withColumn("weight", F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).withColumn("funding", F.lit(0.0001))
    r = features.weighted_returns(c, "weight", "close", "funding", 5.0, ["segment"], ["t"])
    return r.select("segment", "t", "weight", F.round("hold", 9).alias("hold"), F.round("cost", 9).alias("cost"), (F.round("strat", 9) + 0.0).alias("strat"))


_CLOSES = """, c0 AS (SELECT segment, open_ms AS t, close::DOUBLE AS close, ln(close::DOUBLE / lag(close) OVER (PARTITION BY segment ORDER BY open_ms)) AS ret FROM candle_rows),
c1 AS (SELECT *, CASE WHEN count(ret) OVER f = 20 THEN stddev_pop(ret) OVER f END AS vol FROM c0 WINDOW f AS (PARTITION BY segment ORDER BY t ROWS 19 PRECEDING)),
c AS (SELECT *, CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS weight FROM c1 WHERE vol IS NOT NULL)
"""
T06 = with_tables("candle_rows", _CLOSES + """, r AS (SELECT segment, t, weight, ln(lead(close) OVER w / close) AS hold, abs(weight - coalesce(lag(weight) OVER w, 0)) * 0.0005::DOUBLE AS cost, weight * 0.0001::DOUBLE AS fund FROM c WINDOW w AS (PARTITION BY segment ORDER BY t))
SELECT segment, t, weight, round(hold, 9) AS hold, round(cost, 9) AS cost, round(weight * hold - cost - fund, 9) + 0.0 AS strat FROM r WHERE hold IS NOT NULL""")


def t07_buy_and_hold(spark, sf_dir):
    c = _closes(spark, sf_dir)
    w = features.ordered(["segment"], ["t"])
    return c.withColumn("hold", features.next_return(F.col("close"), w)).where("hold IS NOT NULL").groupBy("segment").agg(F.round(F.sum("hold"), 8).alias("log_return"), F.count("*").alias("n"))


T07 = with_tables("candle_rows", _CLOSES + "SELECT segment, round(sum(h), 8) AS log_return, count(*) AS n FROM (SELECT segment, ln(lead(close) OVER (PARTITION BY segment ORDER BY t) / close) AS h FROM c0) WHERE h IS NOT NULL GROUP BY 1")


def _regimes(spark, sf_dir):
    c = _closes(spark, sf_dir)
    p = regime.fit_groups(c, ["segment"], "t", ["ret", "vol"], rounds=100)
    return c.join(regime.filtered(c, p, ["segment"], ["t"], ["ret", "vol"]), ["segment", "t"]).join(p.select("segment", "means"), "segment")


def _strategy(rows, weight):
    r = features.weighted_returns(rows.withColumn("weight", weight).withColumn("funding", F.lit(0.0)), "weight", "close", "funding", 5.0, ["segment"], ["t"])
    return r.groupBy("segment").agg(F.count("*").alias("n"), F.round(stats.sharpe(F.col("strat")), 4).alias("sharpe"), F.round(F.avg(F.abs("weight")), 4).alias("exposure"))


def t01_long_flat(spark, sf_dir):
    """Held in the highest regime, flat in others."""
    return _strategy(_regimes(spark, sf_dir), F.when(F.col("regime") == 2, 1.0).otherwise(0.0))


def t02_long_short(spark, sf_dir):
    return _strategy(_regimes(spark, sf_dir), F.when(F.col("regime") == 2, 1.0).when(F.col("regime") == 0, -1.0).otherwise(0.0))


def t03_overlay(spark, sf_dir):
    """Long in the highest regime only where the likeliest run is five days or longer."""
    both = _regimes(spark, sf_dir).join(c01_run_lengths(spark, sf_dir), ["segment", "t"], "left")
    return _strategy(both, F.when((F.col("regime") == 2) & (F.coalesce("run_length", F.lit(1 << 30)) >= 5), 1.0).otherwise(0.0))


def t04_vol_target(spark, sf_dir):
    size = F.least(F.greatest(F.lit(0.02) / F.col("vol"), F.lit(0.0)), F.lit(3.0))
    return _strategy(_regimes(spark, sf_dir), F.when(F.col("regime") == 2, size * F.col("probs")[2]).otherwise(0.0))


def t05_kelly(spark, sf_dir):
    # The expected return: each regime's chance times its mean return, the first of its two features.
    edge = sum((F.col("probs")[i] * F.col("means")[2 * i] for i in range(3)), F.lit(0.0))
    return _strategy(_regimes(spark, sf_dir), F.least(F.greatest(0.25 * edge / (F.col("vol") * F.col("vol")), F.lit(0.0)), F.lit(3.0)))


def a08_attribution(spark, sf_dir):
    """Days, mean and share of the return by regime; regimes without days keep their row."""
    r = features.weighted_returns(_regimes(spark, sf_dir).withColumn("weight", F.lit(1.0)).withColumn("funding", F.lit(0.0)), "weight", "close", "funding", 0.0, ["segment"], ["t"])
    by = r.groupBy("regime").agg(F.count("*").alias("days"), F.avg("strat").alias("mean"), F.sum("strat").alias("total"))
    all_ = F.sum("total").over(Window.partitionBy(F.lit(0)))
    named = r.sparkSession.createDataFrame([(0, "bear"), (1, "chop"), (2, "bull")], "regime int, name string")
    rows = named.join(by, "regime", "left")
    return rows.select("name", F.coalesce("days", F.lit(0)).alias("days"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.col("total") / all_, F.lit(0.0)), 4).alias("share"))


def s13_performance_matrix(spark, sf_dir):
    """Trials' returns as a matrix, one row an hour."""
    p = A.trial_panel(spark, sf_dir)
    return p.groupBy("t").pivot("cfg", list(range(8))).agg(F.first("r")).select("t", *(F.col(str(c)).alias(f"r{c}") for c in range(8)))


S13 = with_tables("trial_panel", "SELECT t, " + ", ".join(f"max(r) FILTER (WHERE cfg = {c}) AS r{c}" for c in range(8)) + " FROM trial_panel GROUP BY 1")


def s18_signal_log(spark, sf_dir):
    """Signals of a rule a day: what to do, given the day before; and gaps between days."""
    c = _closes(spark, sf_dir).where("vol IS NOT NULL").withColumn("target", F.when(F.col("ret") > 0, "LONG").otherwise("FLAT"))
    w = features.ordered(["segment"], ["t"])
    was = F.coalesce(F.lag("target").over(w), F.lit("FLAT"))
    action = F.when((was == "FLAT") & (F.col("target") == "LONG"), "ENTER").when((was == "LONG") & (F.col("target") == "FLAT"), "EXIT").otherwise("HOLD")
    gap = F.coalesce(F.col("t") - F.lag("t").over(w) != 86400000, F.lit(False))
    return c.select("segment", "t", "target", action.alias("action"), gap.alias("gap"))


S18 = with_tables("candle_rows", _CLOSES + """, s AS (SELECT segment, t, CASE WHEN ret > 0 THEN 'LONG' ELSE 'FLAT' END AS target FROM c), w AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY segment ORDER BY t), 'FLAT') AS was,
  coalesce(t - lag(t) OVER (PARTITION BY segment ORDER BY t) <> 86400000, false) AS gap FROM s)
SELECT segment, t, target, CASE WHEN was = 'FLAT' AND target = 'LONG' THEN 'ENTER' WHEN was = 'LONG' AND target = 'FLAT' THEN 'EXIT' ELSE 'HOLD' END AS action, gap FROM w""")

QUERIES = {
    "m01_sharpe": (m01_sharpe, M01), "s14_trial_sharpes": (m01_sharpe, M01), "m02_sortino": (m02_sortino, M02), "m03_max_drawdown": (m03_max_drawdown, M03), "m04_returns": (m04_returns, M04), "m05_psr": (m05_psr, M05), "m07_deflated": (m07_deflated, M07),
    "v01_walk_forward": (v01_walk_forward, V01), "v02_purged_kfold": (v02_purged_kfold, V02), "v04_leaks": (v04_leaks, V04), "v07_cscv": (v07_cscv, V07), "v08_bootstrap_path": (v08_bootstrap_path, V08), "v09_reality_check": (v09_reality_check, V09), "v03_configured_splits": (v03_configured_splits, V03), "v10_holdout": (v10_holdout, V10),
    "h08_hmm_fit": (h08_hmm_fit, None), "h11_hmm_filter": (h11_hmm_filter, None), "c01_run_lengths": (c01_run_lengths, None), "c04_changepoints": (c04_changepoints, None),
    "t01_long_flat": (t01_long_flat, None), "t02_long_short": (t02_long_short, None), "t03_overlay": (t03_overlay, None), "t04_vol_target": (t04_vol_target, None), "t05_kelly": (t05_kelly, None), "t06_rule_returns": (t06_rule_returns, T06), "t07_buy_and_hold": (t07_buy_and_hold, T07),
    "a08_attribution": (a08_attribution, None), "s13_performance_matrix": (s13_performance_matrix, S13), "s18_signal_log": (s18_signal_log, S18),
}
