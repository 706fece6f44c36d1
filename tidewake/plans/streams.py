"""Queries that run as streams over a table until all of it is read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.operators import execution
from tidewake.plans.execution import A06
from tidewake.sources import adapters as A
from tidewake.sources.adapters import with_tables
from tidewake.streaming import market, ordered, watch
from tidewake.streaming.replay import Run, replayed


def _events(spark, sf_dir):
    return replayed(A.table(spark, sf_dir, "events"), ["ts", "event_id"])


def stream_bars(spark, sf_dir):
    """Hourly bars of the event stream, each written when the watermark has passed it."""
    replay, run = _events(spark, sf_dir), Run(spark)
    bars = lambda: market.bars(replay.stream(), late="1 hour")
    run.drain(bars())
    replay.close("ts", "3 hours")
    return run.drain(bars()).rows(bars().schema).select("instrument", "open", "high", "low", "close", "n")


STREAM_BARS = """SELECT event_type AS instrument, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n
FROM events GROUP BY event_type, date_trunc('hour', ts)"""


def stream_sessions(spark, sf_dir):
    """The same bars in sessions: one that ends after two batches, one that goes on from there, and the end of the day."""
    replay, run = _events(spark, sf_dir), Run(spark)
    bars = lambda: market.bars(replay.stream(), late="1 hour")
    run.session(bars(), batches=2, seconds=600)
    run.drain(bars())
    replay.close("ts", "3 hours")
    return run.drain(bars()).rows(bars().schema).select("instrument", "open", "high", "low", "close", "n")


def stream_positions(spark, sf_dir):
    """Positions of each hundred orders after each fill, in order, from 16 files that come in another one."""
    f = execution.first_fills(A.exec_reports(spark, sf_dir)).withColumn("account", F.expr("cloid div 100"))
    f = f.withColumn("seq", F.row_number().over(Window.partitionBy("account").orderBy("cloid", "seq")).cast("long"))
    mixed = f.select("account", "seq", F.timestamp_seconds("seq").alias("at"), "side", "qty_raw", "px_raw", "fee_raw", F.pmod(F.xxhash64(F.expr("seq div 50")), F.lit(16)).alias("mix"))
    replay = replayed(mixed, ["mix"], files=16, files_a_batch=4)
    moved = ordered.positions(replay.stream(), late="30 days")
    return Run(spark).drain(moved).rows(moved.schema).where("NOT late").select("account", "n", "qty_raw", "entry_raw", "realised_raw")


#: Milliseconds without an event after which an instrument is silent.
SILENT_MS = 1_200_000


def stream_silences(spark, sf_dir):
    """Instruments that were silent for too long, and when that was told."""
    t = A.ticks(spark, sf_dir).select(F.col("instrument").alias("key"), F.timestamp_millis(F.expr("exch_us div 1000")).alias("at"), "tid")
    replay, run = replayed(t, ["at", "tid"]), Run(spark)
    told = lambda: watch.silences(replay.stream(), SILENT_MS, late="1 second")
    run.drain(told())
    replay.close("at", "1 day")
    return run.drain(told()).rows(told().schema).select(F.col("key").alias("instrument"), "silent_ms", "told_ms")


STREAM_SILENCES = with_tables("ticks", f""", g AS (SELECT instrument, exch_us // 1000 AS ms, lead(exch_us // 1000) OVER (PARTITION BY instrument ORDER BY exch_us, tid) AS following FROM ticks)
SELECT instrument, ms AS silent_ms, ms + {SILENT_MS} AS told_ms FROM g WHERE following IS NULL OR following - ms > {SILENT_MS}""")

#: Events of an instrument that an hour lets in.
ADMITTED = 4


def stream_delivery(spark, sf_dir):
    """Events an instrument and hour: offered, delivered and dropped, the latter two told by the stream."""
    t = A.ticks(spark, sf_dir).select(F.col("instrument").alias("key"), F.timestamp_micros("exch_us").alias("at"), F.col("tid").alias("seq"))
    replay, run = replayed(t, ["at", "seq"]), Run(spark)
    sent = lambda: watch.bounded_delivery(replay.stream(), ADMITTED, 3_600_000, late="1 second")
    run.drain(sent())
    replay.close("at", "1 day")
    rows = run.drain(sent()).rows(sent().schema)
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    hour = F.expr("unix_millis(at) div 3600000").alias("hour")
    return rows.groupBy(F.col("key").alias("instrument"), hour).agg(of("row", F.col("n")).alias("delivered"), of("row", F.col("seq")).alias("tids"), of("admitted", F.col("n")).alias("admitted"), of("dropped", F.col("n")).alias("dropped"))


STREAM_DELIVERY = with_tables("ticks", f""", g AS (SELECT instrument, exch_us // 3600000000 AS hour, tid, row_number() OVER (PARTITION BY instrument, exch_us // 3600000000 ORDER BY exch_us, tid) <= {ADMITTED} AS fine FROM ticks)
SELECT instrument, hour, count(*) FILTER (WHERE fine) AS delivered, CAST(sum(CASE WHEN fine THEN tid ELSE 0 END) AS BIGINT) AS tids, count(*) FILTER (WHERE fine) AS admitted, count(*) FILTER (WHERE NOT fine) AS dropped FROM g GROUP BY 1, 2""")


def stream_counters(spark, sf_dir):
    """Counters of the event stream, observed batch by batch and told by a listener."""
    replay = _events(spark, sf_dir)
    amount = F.round(F.col("value") * 100)
    seen = watch.counted(replay.stream().select("event_id", "value"), "events", rows=F.count("*"), even=F.count_if(F.col("event_id") % 2 == 0), cents=F.sum(amount))
    told = watch.listened(spark, "events", lambda: Run(spark).drain(seen))
    return told.groupBy("metric").agg(F.sum("value").cast("long").alias("total"))


STREAM_COUNTERS = """SELECT unnest(['rows', 'even', 'cents']) AS metric, unnest([count(*), count(*) FILTER (WHERE event_id % 2 = 0), CAST(sum(round(value * 100)) AS BIGINT)]) AS total FROM events"""

QUERIES = {
    "stream_bars": (stream_bars, STREAM_BARS), "stream_sessions": (stream_sessions, STREAM_BARS), "stream_positions": (stream_positions, A06), "stream_silences": (stream_silences, STREAM_SILENCES),
    "stream_delivery": (stream_delivery, STREAM_DELIVERY), "stream_counters": (stream_counters, STREAM_COUNTERS),
}
