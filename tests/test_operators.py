"""Hand cases and invariants of the operators that SQL can't check alone."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions import fixed
from tidewake.operators import book, execution, features, regime, stats, validation
from tidewake.sources import messages

S = fixed.SCALE


@pytest.mark.parametrize(("text", "raw", "error"), [
    ("104372.5", 10437250000000, None), (".5", 50000000, None), ("-3.25", -325000000, None), ("", None, "empty"), ("1.2.3", None, "malformed"), ("0.123456789", None, "digits"),
    ("99999999999999", None, "overflow"), (None, None, "empty"), ("+7", 700000000, None), (" 1 ", 100000000, None), ("5.", 500000000, None), ("-", None, "empty"), ("1e5", None, "malformed"),
])
def test_parse(spark, text, raw, error):
    r = spark.createDataFrame([(text,)], "t string").select(fixed.parse(F.col("t")).alias("p")).first().p
    assert (r.raw, r.error) == (raw, error)


def test_format_round_trip(spark):
    raws = [0, 1, -1, 10**8, 123456789, -(10**15), 2**63 - 1, -(2**63) + 1]
    rows = spark.createDataFrame([(x,) for x in raws], "r long").select("r", fixed.format_raw(F.col("r")).alias("t"))
    for r in rows.withColumn("p", fixed.parse(F.col("t"))).collect():
        assert r.p.raw == r.r and r.p.error is None
    assert [r.t for r in rows.collect()][:3] == ["0", "0.00000001", "-0.00000001"]


def test_products_past_a_long_fail(spark):
    df = spark.createDataFrame([(2**62, 2**62)], "a long, b long")
    with pytest.raises(Exception):
        df.select(fixed.notional(F.col("a"), F.col("b"))).collect()


def test_repair_and_flags(spark):
    level = lambda pos, px, qty: (pos, px, qty, 1)
    rows = [
        (1, 10, [level(1, 99, 1), level(2, 98, 2)], [level(3, 101, 1), level(4, 102, 2)]), (2, 5, [level(1, 98, 1), level(2, 99, 2), level(3, 97, 0)], [level(4, 98, 1)]),
        (3, 6, [], [level(1, 5, 1)]), (4, 7, [level(1, 9, 1), level(2, 9, 2)], []),
    ]
    kind = "array<struct<pos:long,px_raw:long,qty_raw:long,n_orders:long>>"
    df = spark.createDataFrame([(0, *r) for r in rows], f"part int, snap long, ts long, bids {kind}, asks {kind}")
    got = {r.snap: r for r in book.repair(df, ["part"]).collect()}
    assert [x.px_raw for x in got[2].bids] == [99, 98] and got[2].crossed and got[2].unsorted == 1 and got[2].bad_qty == 1 and got[2].ts_regressed
    assert not got[1].crossed and got[1].unsorted == 0 and not got[3].ts_regressed and got[4].unsorted == 1 and [x.qty_raw for x in got[4].bids] == [1, 2]


def test_market_walk(spark):
    levels = spark.createDataFrame([(0, "ask", 1, 101 * S, S), (0, "ask", 2, 102 * S, 2 * S), (0, "bid", 1, 99 * S, S)], "k int, side string, level int, px_raw long, qty_raw long")
    orders = spark.createDataFrame([(0, 1, "Buy", 3 * S // 2), (0, 2, "Sell", 10 * S)], "k int, cloid long, order_side string, order_qty long")
    got = {(r.cloid, r.level): (r.take_raw, r.fee_raw) for r in book.market_walk(orders, levels, ["k"], 450).collect()}
    assert got == {(1, 1): (S, 4_545_000), (1, 2): (S // 2, 2_295_000), (2, 1): (S, 4_455_000)}


def test_resting_order_behind_a_queue(spark):
    orders = spark.createDataFrame([(0, 1, "Buy", 100 * S, S, 2 * S, 0)], "k int, cloid long, order_side string, order_px long, order_qty long, queue_ahead long, order_seq long")
    trades = spark.createDataFrame([(0, 1, "Sell", 100 * S, 3 * S // 2), (0, 2, "Sell", 99 * S, S), (0, 3, "Buy", 90 * S, 9 * S)], "k int, seq long, side string, px_raw long, qty_raw long")
    got = book.resting_fills(orders, trades, ["k"], 150).collect()
    assert [(r.seq, r.fill_raw, r.fee_raw) for r in got] == [(2, S // 2, 750_000)]


def test_position_extends_reduces_flips_and_flattens():
    p = execution.Position()
    p.fill(1, 2 * S, 100 * S, 0)
    p.fill(1, 2 * S, 110 * S, 0)
    assert (p.qty, p.entry, p.realised) == (4 * S, 105 * S, 0)
    p.fill(-1, S, 115 * S, S)
    assert (p.qty, p.entry, p.realised) == (3 * S, 105 * S, 9 * S)
    p.fill(-1, 5 * S, 100 * S, 0)
    assert (p.qty, p.entry, p.realised) == (-2 * S, 100 * S, -6 * S)
    p.fill(1, 2 * S, 90 * S, 0)
    assert (p.qty, p.entry, p.realised) == (0, 0, 14 * S)


def test_engine_crosses_with_latency(spark):
    mids = [100 + min(i, 15 - i) for i in range(16)]
    rows = [("x", i * 1000, i, m * S) for i, m in enumerate(mids)]
    df = spark.createDataFrame(rows, "k string, ts_us long, tid long, px_raw long")
    r = execution.backtest(df, ["k"], ["ts_us"], cash=1000 * S, fast=2, slow=4, qty=S // 100, latency_us=500, taker_ppm=0).first()
    assert r.fills == 2 and r.position_raw == -S // 100 and r.expired_raw == 0
    slow = execution.backtest(df, ["k"], ["ts_us"], cash=1000 * S, fast=2, slow=4, qty=S // 100, latency_us=10**9, taker_ppm=0).first()
    assert slow.fills == 0 and slow.expired_raw > 0 and slow.pnl_raw == 0
    assert execution.backtest(df.limit(0), ["k"], ["ts_us"], cash=1, fast=2, slow=4, qty=1, latency_us=0, taker_ppm=0).count() == 0


def test_fold_is_the_same_in_small_batches(spark):
    rows = [(i % 3, i, "Buy" if i % 4 else "Sell", S, (100 + i % 7) * S, 5) for i in range(300)]
    df = spark.createDataFrame(rows, "account long, seq long, side string, qty_raw long, px_raw long, fee_raw long")
    whole = sorted(map(tuple, execution.positions(df, ["account"], ["seq"]).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, execution.positions(df, ["account"], ["seq"]).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gate_order(spark):
    rows = [(0, "Buy", 2, False, "MaxPosition"), (3, "Sell", 2, True, "Allow"), (0, "Buy", 1, True, "KillSwitchTripped"), (-1, "Buy", 2, True, "Allow"), (0, "Buy", 1, False, "MaxNotional")]
    df = spark.createDataFrame([(p * S, s, q * S, 200_000 * S, k) for p, s, q, k, _ in rows], "position long, side string, qty_raw long, px_raw long, killed boolean")
    got = execution.gate(df, S, 150_000 * S).collect()
    assert [r.decision for r in got] == [w for *_, w in rows]


def all_paths(model, x):
    """Log-likelihood, smoothed probabilities and likeliest path by trying every path of states."""
    k, n = len(model.start), len(x)
    normal = lambda v, j: math.prod(math.exp(-((a - m) ** 2) / (2 * s)) / math.sqrt(2 * math.pi * s) for a, m, s in zip(v, model.means[j], model.variances[j]))
    total, smoothed, best = 0.0, np.zeros((n, k)), (0.0, None)
    for path in itertools.product(range(k), repeat=n):
        p = model.start[path[0]] * math.prod(model.move[i, j] for i, j in zip(path, path[1:])) * math.prod(normal(v, j) for v, j in zip(x, path))
        total += p
        smoothed[range(n), path] += p
        best = max(best, (p, path), key=lambda b: b[0])
    return math.log(total), smoothed / total, best[1]


def test_recursions_against_all_paths():
    rng = np.random.default_rng(9)
    model = regime.Regimes(np.array([0.5, 0.2, 0.3]), rng.dirichlet(np.ones(3), 3), rng.standard_normal((3, 2)), rng.uniform(0.5, 2, (3, 2)))
    x = rng.standard_normal((6, 2)) * 2
    evidence, top = model.evidence(x)
    alpha, scales = regime.beliefs(model, evidence)
    total, smoothed, path = all_paths(model, x)
    assert math.isclose((np.log(scales) + top).sum(), total) and np.allclose(alpha * regime.hindsight(model, evidence, scales), smoothed)
    assert tuple(regime.likeliest(model, evidence)) == path
    assert np.allclose(alpha[2], all_paths(model, x[:3])[1][2])


def test_hmm_recovers_states():
    rng = np.random.default_rng(7)
    move = np.array([[0.95, 0.04, 0.01], [0.03, 0.94, 0.03], [0.01, 0.04, 0.95]])
    means, state, states = np.array([-3.0, 0.0, 3.0]), 0, []
    for _ in range(3000):
        states.append(state)
        state = rng.choice(3, p=move[state])
    x = (means[states] + rng.standard_normal(3000) * 0.5)[:, None]
    model, total = regime.fit(x, 3)
    assert np.allclose(model.means[:, 0], means, atol=0.1) and np.allclose(model.move, move, atol=0.05) and math.isfinite(total)
    assert (regime.likeliest(model, model.evidence(x)[0]) == np.array(states)).mean() > 0.97
    assert regime.fit(x, 3, 1)[1] < regime.fit(x, 3, 3)[1] <= total + 1


def test_filter_is_causal_and_equals_beliefs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(150) - 2, rng.standard_normal(150) + 2])
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    p = regime.fit_groups(df, ["k"], "t", ["x"], k=2)
    got = [r.probs for r in regime.filtered(df, p, ["k"], ["t"], ["x"]).orderBy("t").collect()]
    model, _ = regime.fit(x[:, None], 2, 60)
    assert np.allclose(got, regime.beliefs(model, model.evidence(x[:, None])[0])[0], atol=1e-9)
    cut = [r.probs for r in regime.filtered(df.where("t < 200"), p, ["k"], ["t"], ["x"]).orderBy("t").collect()]
    assert np.allclose(cut, got[:200])


def test_run_lengths_against_one_row_at_a_time():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal(12), rng.standard_normal(12) + 6])
    model = regime.RunLength(20, 100, (0.5, 2.0, 1.5, 0.7))
    runs = [(1.0, [])]  # (probability, rows of the run)
    for v in x:
        weighed = []
        for p, rows in runs:
            m, k, a, b = 0.5, 2.0, 1.5, 0.7
            for r in rows:
                b, m, k, a = b + k * (r - m) ** 2 / (2 * (k + 1)), (k * m + r) / (k + 1), k + 1, a + 0.5
            s = b * (k + 1) / (a * k)
            density = math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(2 * a * math.pi * s) * (1 + (v - m) ** 2 / (2 * a * s)) ** (-a - 0.5)
            weighed.append((p * density, rows))
        total = sum(p for p, _ in weighed)
        runs = [(1 / 20, [])] + [(p / total * 19 / 20, [*rows, v]) for p, rows in weighed]
        fresh, length = model.step(v)
        assert math.isclose(fresh, runs[0][0], rel_tol=1e-9) and length == max(range(len(runs)), key=lambda i: runs[i][0])
        assert np.allclose(model.chance, [p for p, _ in runs])


def test_changepoints_are_found():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(300) + m for m in (0, 5, -3)])
    model = regime.RunLength(250, 500)
    out = [model.step(v) for v in x]
    # The chance of a fresh run is the hazard at every step, until lengths are cut.
    assert np.allclose([p for p, _ in out[:400]], 1 / 250)
    lengths = [r for _, r in out]
    onsets = {t - lengths[t] for t in range(1, 900) if lengths[t] - lengths[t - 1] < -50}
    assert any(abs(o - 300) <= 5 for o in onsets) and any(abs(o - 600) <= 5 for o in onsets)
    with pytest.raises(ValueError):
        regime.RunLength(0.5)


def test_moments_against_plain_formulas(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(size=200)
    r = stats.moments(spark.createDataFrame([(1, float(v)) for v in x], "k int, r double"), "r", ["k"]).first()
    n, d = len(x), x - x.mean()
    m2, m3, m4 = (d**2).mean(), (d**3).mean(), (d**4).mean()
    assert math.isclose(r.g1, math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5, rel_tol=1e-9)
    assert math.isclose(r.g2, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / m2**2 - 3 * (n - 1)) + 3, rel_tol=1e-9)
    assert stats.expected_max_sharpe(1.0, 1) == 0 and 1.5 < stats.expected_max_sharpe(1.0, 10) < 1.6


def test_splits_do_not_leak(spark):
    for splits in (validation.walk_forward(spark, 100, 4, 5), validation.purged_kfold(spark, 100, 4, 5)):
        assert validation.leaks(splits, 5, False).count() == 0
        tests = splits.where("role = 'test'")
        assert tests.count() == tests.select("idx").distinct().count()
    with pytest.raises(ValueError):
        validation.walk_forward(spark, 100, 1, 0)


def test_overfitting_is_told_from_skill(spark):
    rng = np.random.default_rng(1)
    noise = rng.standard_normal((600, 20)) * 0.01
    skill = noise.copy()
    skill[:, 7] += 0.01
    frame = lambda m: spark.createDataFrame([(t, c, float(m[t, c])) for t in range(600) for c in range(20)], "t long, cfg long, r double")
    pbo = [validation.cscv(frame(m), 6, 600).agg(F.avg((F.col("logit") <= 0).cast("double"))).first()[0] for m in (noise, skill)]
    assert pbo[1] == 0 and pbo[0] > 0.2
    p = [validation.reality_check(frame(m), 600, 200, 10.0, 3).first().spa_p for m in (noise, skill)]
    assert p[1] < 0.02 < p[0]


def test_messages_keep_faults_aside(spark):
    df = spark.createDataFrame([(1, "{bad"), (2, None), (3, '{"channel":"trades","trades":[]}'), (4, '{"channel":"trades"}'), (5, '{"channel":"pong","more":1}')], "seq long, text string")
    got = {r.seq: (r.kind, r.error) for r in messages.parse(df).collect()}
    assert got == {1: ("bad", "malformed"), 2: ("bad", "malformed"), 3: ("trades", None), 4: ("trades", "malformed"), 5: ("pong", None)}


def test_features_need_names(spark):
    with pytest.raises(ValueError):
        features.build(spark.range(1), [("nothing", {})], "id", [], ["id"])
    assert features.feature_name("sma", {"window": 20, "lag": 1}) == "sma_lag1_window20"


def test_decoding_sees_the_future(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(80) - 3, rng.standard_normal(80) + 3])
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    p = regime.fit_groups(df, ["k"], "t", ["x"], k=2)
    rows = regime.decoded(df, p, ["k"], "t", ["x"]).orderBy("t").collect()
    assert [r.path for r in rows] == [0] * 80 + [1] * 80 and all(abs(sum(r.smoothed) - 1) < 1e-9 for r in rows)


def test_a_holdout_stays_sealed(spark):
    from tidewake.sources import logs

    df = spark.createDataFrame([(i, i / 7) for i in range(50)], "t long, v double")
    digest = validation.seal(df.where("t >= 40"), ["t"], "v")
    m = logs.manifest(50, 0.2, digest, "s")
    assert validation.research_rows(df, ["t"], m).count() == 40
    assert validation.reveal(df, ["t"], "v", m, validation.REVEAL).count() == 10
    with pytest.raises(PermissionError):
        validation.reveal(df, ["t"], "v", m, "please")
    with pytest.raises(ValueError):
        validation.reveal(df.withColumn("v", F.col("v") + 1), ["t"], "v", m, validation.REVEAL)
    with pytest.raises(ValueError):
        validation.research_rows(df.limit(49), ["t"], m)


def test_reproduction(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.1), (4, 0.0)], "k int, v double")
    assert tuple(validation.reproduced(a, b, ["k"], "v").first()) == (2, 1)


def test_walk_forward_tests_every_last_bar(spark, monkeypatch):
    import random

    from tidewake.plans import more, research

    random.seed(5)
    bars = []
    for s, n in (("a", 500), ("b", 455), ("c", 300)):
        price = 100.0
        for t in range(n):
            price *= 1 + random.gauss(0.001, 0.01)
            bars.append((s, t, price))
    monkeypatch.setattr(research.A, "candle_rows", lambda *_: spark.createDataFrame(bars, "segment string, open_ms long, close double"))
    ends = more.walk_windows(more._closes(spark, "")).orderBy("segment", "win").collect()
    assert [tuple(r) for r in ends] == [("a", 0, 400, 490), ("a", 1, 445, 500), ("a", 2, 490, 500), ("b", 0, 400, 455), ("b", 1, 445, 455)]
    got = more.v05_walk_forward_evaluate(spark, "").orderBy("segment", "win").collect()
    assert [(r.segment, r.win, r.n) for r in got] == [("a", 0, 89), ("a", 1, 54), ("b", 0, 54)]
