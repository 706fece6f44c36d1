"""The normal distribution and even numbers: against the standard library, and in both engines."""

import math
import random
from statistics import NormalDist

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewake.functions import normal
from tidewake.operators import splits, stats
from tidewake.sources.config import study_config


def test_distribution_and_inverse(spark):
    rng = random.Random(1)
    zs = [0.0, -0.0, 7.07106781186547, -7.2, 8.5, 37.5, -40.0, *(rng.uniform(-9, 9) for _ in range(300))]
    got = {r.z: r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal.cdf(F.col("z")).alias("p")).collect()}
    assert all(got[z] == pytest.approx(NormalDist().cdf(z), rel=1e-9, abs=1e-15) for z in zs)
    ps = [1e-300, 1e-20, 0.075, 0.925, 0.5, 1 - 1e-12, *(rng.random() for _ in range(300))]
    back = {r.p: r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.inverse(F.col("p")).alias("z")).collect()}
    assert all(back[p] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-14) for p in ps)
    edges = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(normal.inverse(F.col("p")), normal.cdf(F.when(F.lit(False), 1.0)))
    assert all(tuple(r) == (None, None) for r in edges.collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT unnest(?) AS z, unnest(?) AS p", [zs[:300], ps[:300]])
    for z, p, a, b in con.execute(f"SELECT z, p, {normal.cdf_sql('z')}, {normal.inverse_sql('p')} FROM x").fetchall():
        assert a == pytest.approx(got[z], rel=1e-12) and b == pytest.approx(back[p], rel=1e-12, abs=1e-14)


def test_even_numbers(spark):
    df = spark.range(40).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(499))).alias("t"))
    rows = df.select("rep", "t", normal.even("rep", "t", seed=17).alias("u"), normal.even("rep", "t", seed=18).alias("v")).orderBy("rep", "t").collect()
    want = duckdb.sql(f"SELECT {normal.even_sql('rep', 't', seed=17)} FROM (SELECT unnest(range(40)) AS rep), (SELECT unnest(range(500)) AS t) ORDER BY rep, t").fetchall()
    assert [r.u for r in rows] == [w for (w,) in want]
    u, v = [r.u for r in rows], [r.v for r in rows]
    n = len(u)
    assert all(0 <= x < 1 for x in u)
    counts = [0] * 20
    for x in u:
        counts[int(x * 20)] += 1
    assert sum((c - n / 20) ** 2 / (n / 20) for c in counts) < 45  # of 19 degrees of freedom
    for a, b in ((u[:-1], u[1:]), (u[:-500], u[500:]), (u, v)):
        correlation = 12 * sum((x - 0.5) * (y - 0.5) for x, y in zip(a, b)) / len(a)
        assert abs(correlation) < 4 / math.sqrt(len(a))


def test_expected_maximum(spark):
    df = spark.createDataFrame([(0.04, 2), (0.5, 1000), (0.0, 9), (0.3, 1)], "v double, k long")
    for r in df.withColumn("m", stats.expected_max(F.col("v"), F.col("k"))).collect():
        assert r.m == pytest.approx(stats.expected_max_sharpe(r.v, r.k), rel=1e-12)


@pytest.mark.parametrize("scheme", ["walk_forward", "purged_kfold"])
@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_splits(spark, scheme, bucket):
    for n, k, embargo in ((50, 3, 4), (23, 5, 0), (12, 2, 9)):
        intervals = splits.of_config(study_config({"features": [("sma", {})], "scheme": scheme, "n_splits": k, "embargo": embargo}), n)
        want = set()
        for fold in range(1, k + 1):
            if scheme == "walk_forward":
                size = n // (k + 1)
                tests = range(fold * size, (fold + 1) * size)
                train = range(0, fold * size - embargo)
            else:
                bounds = [i * (n // k) + min(i, n % k) for i in range(k + 1)]
                tests = range(bounds[fold - 1], bounds[fold])
                train = [i for i in range(n) if i < tests[0] - embargo or i >= tests[-1] + 1 + embargo]
            want |= {(fold, "test", i) for i in tests} | {(fold, "train", i) for i in train}
        assert set(map(tuple, splits.places(spark, intervals, bucket).collect())) == want
        met = splits.rows(spark.range(n).select(F.col("id").alias("a.b"), F.col("id").alias("i")), "i", intervals, bucket)
        assert {(r.fold, r.role, r.i) for r in met.collect()} == want
    for bad in ((5, 1, 0), (5, 2, -1), (1, 2, 0)):
        with pytest.raises(ValueError):
            splits.SCHEMES[scheme](*bad)
