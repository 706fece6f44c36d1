"""Statistics of trials, bootstraps, holdouts and logs against plain code."""

import hashlib
import json
import math
from statistics import NormalDist, fmean, stdev

import pytest
from pyspark.sql import functions as F

from tidewake.operators import stats, validation
from tidewake.plans import more, research
from tidewake.sources import adapters as A
from tidewake.sources import config, logs

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trials(spark):
    """Returns of every configuration in order."""
    out = {}
    for r in A.trial_panel(spark, PATH).orderBy("cfg", "t").collect():
        out.setdefault(r.cfg, []).append(r.r)
    return out


def moments(x):
    n, m = len(x), fmean(x)
    m2, m3, m4 = (sum((v - m) ** k for v in x) / n for k in (2, 3, 4))
    skew = math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / m2**2 - 3 * (n - 1)) + 3
    return m / stdev(x), skew, kurtosis, n


def probability(x, bar):
    sr, g1, g2, n = moments(x)
    return NormalDist().cdf((sr - bar) * math.sqrt(n - 1) / math.sqrt(1 - g1 * sr + (g2 - 1) / 4 * sr * sr))


def expected_maximum(trials):
    ratios = [moments(x)[0] for x in trials.values()]
    k, inverse = len(ratios), NormalDist().inv_cdf
    return stdev(ratios) * ((1 - 0.5772156649015329) * inverse(1 - 1 / k) + 0.5772156649015329 * inverse(1 - 1 / (k * math.e)))


def test_deflated_sharpe(spark, trials):
    bar = expected_maximum(trials)
    got = {r.cfg: (r.psr, r.dsr) for r in research.m07_deflated(spark, PATH).collect()}
    assert set(got) == set(trials)
    for cfg, x in trials.items():
        assert got[cfg] == pytest.approx((probability(x, 0.0), probability(x, bar)), abs=2e-6)


def test_global_correction(spark, trials):
    best = min(trials, key=lambda c: (-moments(trials[c])[0], c))
    r = more.v19_global_correction(spark, PATH).first()
    bar = expected_maximum(trials)
    assert r.cfg == best and (r.best, r.benchmark, r.dsr) == pytest.approx((moments(trials[best])[0], bar, probability(trials[best], bar)), abs=2e-6)


def test_reality_check(spark):
    length, reps, block, seed = 60, 40, 5.0, 3
    panel = spark.range(length * 4).select((F.col("id") % length).alias("t"), F.floor(F.col("id") / length).alias("cfg"), ((F.pmod(F.xxhash64("id"), F.lit(2000)) - 990) / 1e5).alias("r"))
    x = {}
    for r in panel.orderBy("t").collect():
        x.setdefault(r.cfg, []).append(r.r)
    draws = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    draws = draws.select("rep", "t", validation.even("rep", "t", seed=seed).alias("u"), validation.even("rep", "t", seed=seed + 1).alias("v"))
    paths = {}
    for r in draws.orderBy("rep", "t").collect():
        path = paths.setdefault(r.rep, [])
        path.append(int(r.v * length) if r.t == 0 or r.u < 1 / block else (path[-1] + 1) % length)
    mean = {c: fmean(v) for c, v in x.items()}
    boot = {c: [fmean(v[i] for i in path) - mean[c] for path in paths.values()] for c, v in x.items()}
    omega = {c: math.sqrt(fmean(d * d for d in boot[c]) * length) for c in x}
    z = {c: math.sqrt(length) * mean[c] / omega[c] for c in x}
    kept = [c for c in x if z[c] >= -math.sqrt(2 * math.log(math.log(length)))]
    tops = [[max(0.0, *(math.sqrt(length) * boot[c][k] / omega[c] for c in names)) for k in range(reps)] for names in (x, kept)]
    stat, spa = max(0.0, *z.values()), max(0.0, *(z[c] for c in kept))
    got = validation.reality_check(panel, length, reps, block, seed).first()
    assert (got.stat, got.spa_stat, got.rc_p, got.spa_p) == pytest.approx((stat, spa, fmean(t >= stat for t in tops[0]), fmean(t >= spa for t in tops[1])))
    assert got.k_kept == len(kept)


def test_expected_maximum_of_few_trials():
    assert stats.expected_max_sharpe(0.0, 9) == stats.expected_max_sharpe(1.0, 1) == 0


def test_numbered_is_the_order(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("t"), F.lit("x").alias("v")).repartition(7)
    assert all(r._i == r.t for r in validation.numbered(df, ["t"]).collect())
    assert validation.numbered(df.limit(0), ["t"]).count() == 0


def test_a_seal_knows_every_value_and_its_place(spark, monkeypatch):
    monkeypatch.setattr(validation, "SEAL_ROWS", 16)
    df = spark.range(100).select(F.col("id").alias("t"), (F.col("id") * 7 % 100).alias("v"))
    whole = validation.seal(df, ["t"], "v")
    assert validation.seal(df.repartition(9), ["t"], "v") == whole
    assert len({whole, validation.seal(df.where("t > 0"), ["t"], "v"), validation.seal(df.withColumn("v", F.when(F.col("t") == 50, -1).otherwise(F.col("v"))), ["t"], "v"), validation.seal(df.withColumn("t", 99 - F.col("t")), ["t"], "v")}) == 4


def test_signals_are_appended_once(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-{d:02}", d) for d in range(1, 11)], "day string, signal int")
    path = f"{tmp_path}/log"
    assert logs.last_key(spark, path, df.schema, "day") is None
    logs.append_new(df.where("signal <= 6"), path, "day")
    for _ in range(2):
        logs.append_new(df, path, "day")
    assert sorted(r.signal for r in spark.read.parquet(path).collect()) == list(range(1, 11))
    assert tuple(logs.last_row(spark, path, df.schema, "day").first()) == ("2024-01-10", 10)


def test_frozen_parameters_keep_their_hash(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    digest = logs.freeze(df, f"{tmp_path}/p")
    assert sorted(map(tuple, logs.frozen(spark, f"{tmp_path}/p", digest).collect())) == [("a", 1.5), ("b", None)]
    df.withColumn("v", F.lit(2.0)).write.mode("overwrite").parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError):
        logs.frozen(spark, f"{tmp_path}/p", digest)


def test_rules_as_columns_agree_with_the_class(spark):
    rows = [("x", 1.0, 2, 5, 0.1, 450, 150, 0, 0), ("", 0.0, 5, 5, 0.0, -1, 150, -1, -1), ("x", 1.0, 0, 5, 0.1, 450, 100_001, 0, 0)]
    names = "instrument string, cash double, fast int, slow int, qty double, taker_ppm int, maker_ppm int, latency_ms int, funding_interval_ms int"
    got = spark.createDataFrame(rows, names).select(config.broken_rules().alias("b")).collect()
    assert [r.b for r in got] == [config.EngineConfig(**dict(zip([n.split()[0] for n in names.split(", ")], r))).broken() for r in rows]


def test_backoff(spark):
    got = [r.d for r in spark.range(1, 15).select(logs.backoff_ms(F.col("id")).alias("d")).collect()]
    assert got == [min(30_000, 250 * 2 ** min(a - 1, 10)) for a in range(1, 15)]


def test_holdout_needs_the_phrase(spark):
    df = spark.range(20).select("id", (F.col("id") * 2).alias("v"))
    held = logs.manifest(20, 0.25, validation.seal(df.where("id >= 15"), ["id"], "v"), "s")
    assert sorted(r.id for r in validation.research_rows(df, ["id"], held).collect()) == list(range(15))
    assert sorted(r.id for r in validation.reveal(df, ["id"], "v", held, validation.REVEAL).collect()) == list(range(15, 20))
    with pytest.raises(PermissionError):
        validation.reveal(df, ["id"], "v", held, "no")


def test_seals_of_many_levels(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("t"), (F.col("id") * 7 % 11).alias("v"))
    two = validation.seal(df, ["t"], "v")
    monkeypatch.setattr(validation, "SEAL_ROWS", 3)
    level = [json.dumps([i * 7 % 11 for i in range(a, min(a + 3, 60))], separators=(",", ":")) for a in range(0, 60, 3)]
    while True:
        level = [hashlib.sha256(x.encode()).hexdigest() for x in level]
        if len(level) == 1:
            break
        level = [json.dumps(level[a : a + 3], separators=(",", ":")) for a in range(0, len(level), 3)]
    assert validation.seal(df.repartition(5), ["t"], "v") == level[0] != two
    assert validation.seal(df.limit(0), ["t"], "v") == hashlib.sha256(b"[]").hexdigest()
