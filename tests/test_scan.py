"""Places, running totals, halos and positions in pieces against whole windows and the fold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.operators import execution, features, scan, segments, stats


def rows_of(spark, seed=1, n=700):
    rng = random.Random(seed)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i, rng.randrange(-9, 10), "x") for i in range(n)]
    return spark.createDataFrame(data, "k string, t long, id long, x long, `a.b` string")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_places(spark):
    df = rows_of(spark)
    want = df.withColumn("_i", (F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1).cast("long"))
    assert same(scan.placed(df.repartition(7), ["k"], ["t", "id"]), want)
    assert scan.placed(df.limit(0), ["k"], ["t", "id"]).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_running_totals(spark, piece):
    df = scan.placed(rows_of(spark), ["k"], ["t", "id"])
    w = Window.partitionBy("k").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"s": F.sum("x").over(w), "sq": F.sum(F.col("x") * F.col("x")).over(w)})
    assert same(scan.running(df, ["k"], "_i", {"s": F.col("x"), "sq": F.col("x") * F.col("x")}, piece=piece), want)
    most = scan.running(df, ["k"], "_i", {"m": F.col("x")}, F.max, F.greatest, piece)
    assert same(most, df.withColumn("m", F.max("x").over(w)))


@pytest.mark.parametrize("piece", [1, 4, 25, 1000])
def test_halos(spark, piece):
    df = rows_of(spark)
    look = lambda w: {"s": F.sum("x").over(w.rowsBetween(-3, 0)), "n": F.count("*").over(w.rowsBetween(-3, 0)), "l": F.lag("x", 2).over(w), "d": F.lead("x").over(w)}
    copied, w, own = scan.haloed(df, ["k"], ["t", "id"], 3, 1, piece)
    got = copied.withColumns(look(w)).where(own).drop("_i", "_piece")
    assert same(got, df.withColumns(look(Window.partitionBy("k").orderBy("t", "id"))))


@pytest.mark.parametrize("longest", [3, 1 << 17])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_positions_equal_the_fold(spark, monkeypatch, seed, longest):
    monkeypatch.setattr(segments, "LONGEST", longest)
    monkeypatch.setattr(segments, "CHUNK", 4)
    monkeypatch.setattr(scan, "PIECE", 16)
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice(["Buy", "Sell"]), rng.choice([1, 2, 3, 7]) * 10**7 + rng.randrange(3), rng.randrange(10**9, 10**12), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(data, "account long, seq long, side string, qty_raw long, px_raw long, fee_raw long")
    if longest > 400:
        monkeypatch.setattr(segments, "ordered_fold", None)  # not even asked for
    got, want = segments.positions(df, ["account"], ["seq"]), execution.positions(df, ["account"], ["seq"])
    assert same(got.select(want.columns), want)


def test_a_key_of_large_prices_and_no_rows(spark):
    kind = "account long, seq long, side string, qty_raw long, px_raw long, fee_raw long"
    df = spark.createDataFrame([(1, i, "Buy" if i % 3 else "Sell", 10**13, 10**13 + i, 0) for i in range(20)], kind)
    assert same(segments.positions(df, ["account"], ["seq"]), execution.positions(df, ["account"], ["seq"]))
    assert segments.positions(df.limit(0), ["account"], ["seq"]).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_percentiles_by_histograms(spark, monkeypatch, bins, few):
    import math

    monkeypatch.setattr(stats, "BINS", bins)
    monkeypatch.setattr(stats, "FEW_GROUPS", few)
    rng = random.Random(bins)
    data = [(k, None if rng.random() < 0.05 else x) for k in ["a", "b", None, "one"] for x in [rng.choice([rng.randrange(-50, 50), rng.randrange(-(10**6), 10**6)]) for _ in range(1 if k == "one" else 120)]]
    data += [("nothing", None), ("equal", 5), ("equal", 5), ("ends", -(2**63)), ("ends", 2**63 - 1), ("ends", 0)] if bins == 4096 else []
    df = spark.createDataFrame(data, "`k.x` string, x long")
    want = {}
    for k in {k for k, _ in data}:
        xs = sorted(x for kk, x in data if kk == k and x is not None)
        want[k] = (*(xs[max(1, math.ceil(p * len(xs))) - 1] if xs else None for p in (0.5, 0.95, 0.99)), max(xs, default=None), len(xs))
    got = {r[0]: tuple(r)[1:] for r in stats.percentiles(df, "x", ["k.x"]).collect()}
    assert got == want
    one = stats.percentiles(df, "x", []).collect()
    xs = sorted(x for _, x in data if x is not None)
    assert [tuple(r) for r in one] == [(*(xs[math.ceil(p * len(xs)) - 1] for p in (0.5, 0.95, 0.99)), xs[-1], len(xs))]
    assert stats.percentiles(df.limit(0), "x", ["k.x"]).count() == 0


@pytest.mark.parametrize("piece", [5, 30])
def test_features_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(scan, "PIECE", piece)
    df = rows_of(spark).select("k", "t", "id", (F.col("x") + 20).cast("double").alias("px"), (F.col("x") + 20).alias("raw"))
    specs = [("sma", {"window": 7}), ("zscore", {"window": 9}), ("realized_vol", {"window": 8}), ("log_return", {"lag": 3}), ("momentum", {"window": 6})]
    rounded = lambda rows: rows.select("id", "valid", *(F.round(features.feature_name(*s), 9) for s in specs))
    assert same(rounded(features.build(df, specs, "px", ["k"], ["t", "id"])), rounded(features.build(df, specs, "px", ["k"], ["t", "id"], pieces=False)))
    got = features.sma_cross(df, "raw", 3, 9, ["k"], ["t", "id"])
    monkeypatch.setattr(scan, "PIECE", 1 << 16)
    assert same(got, features.sma_cross(df, "raw", 3, 9, ["k"], ["t", "id"])) and got.count() > 10
