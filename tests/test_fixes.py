"""Order states and as-of joins against plain code."""

import random

from pyspark.sql import functions as F

from tidewake.operators import execution


def test_average_price_is_cut_at_each_fill(spark):
    random.seed(3)
    reports, requests, want = [], [], {}
    for cloid in range(40):
        total = random.randint(3, 12)
        requests.append((cloid, total))
        qty = px = fees = 0
        for seq in range(6):
            q, p, fee = random.randint(1, 4), random.randint(-50, 200), random.randint(0, 5)
            reports.append((cloid, seq, seq, q, p, fee))
            if seq == 2:
                reports.append((cloid, seq, seq + 100, q, p + 1, fee))  # a repeated id
            if qty < total:
                n = px * qty + p * q
                px = abs(n) // (qty + q) * (1 if n >= 0 else -1)
                qty, fees = qty + q, fees + fee
        want[cloid] = (qty, px, fees, "Filled" if qty >= total else "PartiallyFilled")
    r = spark.createDataFrame(reports, "cloid long, fill_id long, seq long, qty_raw long, px_raw long, fee_raw long")
    o = spark.createDataFrame(requests, "cloid long, qty_raw long")
    got = {x.cloid: tuple(x)[1:] for x in execution.order_states(r, o).select("cloid", "filled_raw", "vwap_raw", "fees_raw", "status").collect()}
    assert got == want


def _marks(n, seed):
    random.seed(seed)
    return [(random.choice("ab"), random.randint(0, 60), i, random.randint(1, 9)) for i in range(n)]


def test_next_snapshot_follows_the_sequence(spark):
    marks = _marks(80, 1)
    orders = [(k, 1000 + s, ts, s) for k, ts, s, _ in marks if s % 3 == 0]
    m = spark.createDataFrame(marks, "k string, ts_us long, seq long, mark_raw long")
    o = spark.createDataFrame(orders, "k string, cloid long, ts_us long, seq long")
    for latency in (0, 1, 7):
        for bucket in (4, 1000):
            want = {}
            for k, cloid, ts, s in orders:
                later = sorted((t, q, p) for kk, t, q, p in marks if kk == k and t >= ts + latency and (t, q) > (ts, s))
                want[cloid] = (ts + latency, *((later[0][0], later[0][2]) if later else (None, None)))
            got = {r.cloid: (r.arrival_us, r.mark_us, r.mark_raw) for r in execution.next_snapshot(o, m, ["k"], latency, bucket).collect()}
            assert got == want


def test_last_mark_in_buckets(spark):
    marks = _marks(60, 2)
    events = [(k, 500 + i, random.randint(-5, 70)) for i, k in enumerate("ab" * 20)]
    m = spark.createDataFrame([(k, t, p) for k, t, _, p in marks], "k string, ts_us long, mark_raw long")
    e = spark.createDataFrame(events, "k string, tid long, ts_us long")
    want = {tid: max(((t, p) for kk, t, _, p in marks if kk == k and t <= ts), default=(0, None))[1] for k, tid, ts in events}
    for bucket in (4, 1000):
        assert {r.tid: r.mark_raw for r in execution.last_mark(e, m, ["k"], bucket).collect()} == want


def test_no_window_frame_follows(spark):
    m = spark.createDataFrame(_marks(5, 1), "k string, ts_us long, seq long, mark_raw long")
    plan = execution.next_snapshot(m.withColumn("cloid", F.col("seq")), m, ["k"], 1)._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower()
