"""Queries that write event logs and artifacts and read them back, and extremes (S, J, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.plans.execution import _FILLS
from tidewake.sources import adapters as A
from tidewake.sources import eventlog, logs
from tidewake.sources.adapters import with_tables
from tidewake.streaming.replay import fresh


def _trade_log(spark, sf_dir):
    t = A.ticks(spark, sf_dir).select("instrument", F.lit("trade").alias("kind"), (F.col("exch_us") * 1000).alias("exch_ns"), (F.col("recv_us") * 1000).alias("recv_ns"), "px_raw", "qty_raw", "side", "tid")
    path = fresh(spark, "logs")
    eventlog.write_log(t, path, "venue")
    return path


def s01_event_log(spark, sf_dir):
    """All trades, written as framed logs and read from them."""
    log = eventlog.read_log(spark, _trade_log(spark, sf_dir))
    return log.select("instrument", "tid", F.expr("exch_ns div 1000").alias("exch_us"), F.expr("recv_ns div 1000").alias("recv_us"), "px_raw", "qty_raw", "side")


S01 = with_tables("ticks", "SELECT instrument, tid, exch_us, recv_us, px_raw, qty_raw, side FROM ticks")


def s01_book_log(spark, sf_dir):
    """All book snapshots, written as framed logs and read from them, a row a level."""
    level = lambda side: F.transform(side, lambda x: F.struct(x["px_raw"].alias("px_raw"), x["qty_raw"].alias("qty_raw"), x["n_orders"].alias("n_orders")))
    books = A.snapshots(spark, sf_dir).select(F.concat(F.lit("book"), F.col("snap") % 4).alias("instrument"), F.lit("book").alias("kind"), F.col("snap").alias("exch_ns"), F.col("snap").alias("recv_ns"), level("bids").alias("bids"), level("asks").alias("asks"))
    path = fresh(spark, "logs")
    eventlog.write_log(books, path)
    log = eventlog.read_log(spark, path)
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"{name}s").alias("levels"))
    sides = log.select(F.col("exch_ns").alias("snap"), F.explode(F.array(side("bid"), side("ask"))).alias("s"))
    return sides.select("snap", "s.side", F.posexplode("s.levels").alias("i", "x")).select("snap", "side", "i", "x.*")


S01_BOOK = with_tables("l2_levels", "SELECT snap, side, CAST(row_number() OVER (PARTITION BY snap, side ORDER BY pos) - 1 AS INTEGER) AS i, px_raw, qty_raw, n_orders FROM l2_levels")


def s02_log_counts(spark, sf_dir):
    """What the log's writers counted, and what its files hold."""
    path = _trade_log(spark, sf_dir)
    held = eventlog.read_log(spark, path).groupBy("instrument").agg(F.count("*").alias("held"))
    return eventlog.written_counts(spark, path).join(held, "instrument")


S02 = with_tables("ticks", "SELECT instrument, count(*) AS events, count(*) AS held FROM ticks GROUP BY 1")


def j11_log_instruments(spark, sf_dir):
    """Instruments that a configuration asks for (those of the first events, and one that nobody trades) against the headers of the log's files, either way."""
    path = _trade_log(spark, sf_dir)
    headers = eventlog.read_log(spark, path).groupBy("instrument").agg(F.min(F.col("venue") == "venue").alias("venue_fits"))
    asked = A.ticks(spark, sf_dir).where("tid < 5").select("instrument").union(spark.createDataFrame([("nothing",)], "instrument string")).distinct().withColumn("asked", F.lit(True))
    both = headers.withColumn("held", F.lit(True)).join(asked, "instrument", "full")
    return both.select("instrument", F.coalesce("asked", F.lit(False)).alias("asked"), F.coalesce("held", F.lit(False)).alias("held"), "venue_fits")


J11 = with_tables("ticks", """, a AS (SELECT DISTINCT instrument FROM ticks WHERE tid < 5 UNION SELECT 'nothing'), h AS (SELECT DISTINCT instrument FROM ticks)
SELECT coalesce(a.instrument, h.instrument) AS instrument, a.instrument IS NOT NULL AS asked, h.instrument IS NOT NULL AS held, CASE WHEN h.instrument IS NOT NULL THEN true END AS venue_fits FROM h FULL JOIN a ON a.instrument = h.instrument""")


def o04_extremes(spark, sf_dir):
    """The best and the worst trial of each hour of returns, ties to the smaller configuration."""
    p = A.trial_panel(spark, sf_dir)
    return p.groupBy("t").agg(F.min_by("cfg", F.struct(-F.col("r"), F.col("cfg"))).alias("best"), F.min_by("cfg", F.struct("r", "cfg")).alias("worst"), F.max("r").alias("top"), F.min("r").alias("bottom"))


O04 = with_tables("trial_panel", "SELECT t, arg_min(cfg, (-r, cfg)) AS best, arg_min(cfg, (r, cfg)) AS worst, max(r) AS top, min(r) AS bottom FROM trial_panel GROUP BY 1")


def s15_artifacts(spark, sf_dir):
    """A results document of each hundred orders, written under the hash of its text and read back; whether name and text agree."""
    from tidewake.operators import execution

    f = execution.first_fills(A.exec_reports(spark, sf_dir)).groupBy(F.expr("cloid div 100").alias("account"))
    rows = f.agg(F.count("*").alias("fills"), F.sum("qty_raw").alias("volume_raw"), F.sum("fee_raw").alias("fees_raw"))
    documents = logs.artifact_rows(rows, ["account", "fees_raw", "fills", "volume_raw"])
    path = fresh(spark, "artifacts")
    logs.write_artifacts(documents, path)
    return logs.read_artifacts(spark, path).select("hash", "text", "fits")


S15 = with_tables("exec_reports", _FILLS + """, r AS (SELECT cloid // 100 AS account, count(*) AS fills, CAST(sum(qty_raw) AS BIGINT) AS volume_raw, CAST(sum(fee_raw) AS BIGINT) AS fees_raw FROM ff GROUP BY 1),
t AS (SELECT '{"account":' || account || ',"fees_raw":' || fees_raw || ',"fills":' || fills || ',"volume_raw":' || volume_raw || '}' AS text FROM r)
SELECT sha256(text) AS hash, text, true AS fits FROM t""")

QUERIES = {"s01_event_log": (s01_event_log, S01), "s01_book_log": (s01_book_log, S01_BOOK), "s02_log_counts": (s02_log_counts, S02), "s15_artifacts": (s15_artifacts, S15), "j11_log_instruments": (j11_log_instruments, J11), "o04_extremes": (o04_extremes, O04)}
