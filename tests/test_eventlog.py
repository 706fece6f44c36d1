"""Framed event logs: round trips, cut files, commits."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tidewake.sources import adapters, eventlog

PATH = "/root/testdata/sf0.001"


def trades(spark):
    return adapters.ticks(spark, PATH).select("instrument", F.lit("trade").alias("kind"), (F.col("exch_us") * 1000).alias("exch_ns"), (F.col("recv_us") * 1000).alias("recv_ns"), "px_raw", "qty_raw", "side", "tid")


def files(folder):
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".log"))


def test_round_trip_in_order(spark, tmp_path):
    t, path = trades(spark), f"file://{tmp_path}/log"
    eventlog.write_log(t, path, "venue", 17, rows_a_file=200)
    back = eventlog.read_log(spark, path)
    assert sorted(map(tuple, back.select(*t.columns).collect())) == sorted(map(tuple, t.collect()))
    rows = back.collect()
    assert {(r.venue, r.created_ms) for r in rows} == {("venue", 17)} and len({r.file for r in rows}) > 5
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file, []).append((r.n, r.exch_ns, r.tid))
    for part in by_file.values():
        assert [n for n, *_ in sorted(part)] == list(range(len(part))) and sorted(part) == sorted(part, key=lambda x: x[1:])
    assert back.rdd.getNumPartitions() == len(by_file)
    counts = {r.instrument: r.events for r in eventlog.written_counts(spark, path).collect()}
    assert counts == {r.instrument: r["count"] for r in t.groupBy("instrument").count().collect()}


def test_mixed_kinds(spark, tmp_path):
    level = "struct<px_raw: long, qty_raw: long, n_orders: long>"
    kind = f"instrument string, kind string, exch_ns long, recv_ns long, px_raw long, qty_raw long, side string, tid long, bids array<{level}>, asks array<{level}>, open_ns long, open long, high long, low long, close long, volume long, n_trades long"
    rows = [
        ("a", "trade", 5, 6, 10, 20, "Sell", 2**62, None, None, None, None, None, None, None, None, None),
        ("a", "book", 7, 8, None, None, None, None, [(1, 2, 3), (4, 5, 6)], [], None, None, None, None, None, None, None),
        ("a", "candle", 9, 10, None, None, None, None, None, None, 1, 2, 3, 4, 5, 6, 7),
        ("a", "trade", 11, 12, -10, 20, "Buy", 1, None, None, None, None, None, None, None, None, None),
    ]
    df, path = spark.createDataFrame(rows, kind), f"file://{tmp_path}/log"
    eventlog.write_log(df, path)
    back = eventlog.read_log(spark, path)
    assert list(map(tuple, back.orderBy("n").select(*df.columns).collect())) == rows
    # The bytes of the format.
    data = open(files(f"{tmp_path}/log")[0], "rb").read()
    head = struct.pack("<I", 25) + struct.pack("<Q", 0) + struct.pack("<Q", 1) + b"a" + struct.pack("<q", 0)
    assert data.startswith(b"QNT1" + head + struct.pack("<I", 48) + struct.pack("<IqqIqqQ", 0, 10, 20, 1, 5, 6, 2**62))


def test_cut_files(spark, tmp_path):
    eventlog.write_log(trades(spark).where("instrument = 'click'").limit(40), f"file://{tmp_path}/log")
    data = open(files(f"{tmp_path}/log")[0], "rb").read()
    read = lambda: eventlog.read_log(spark, f"file://{tmp_path}/cut.log").count()

    def cut(to):
        with open(f"{tmp_path}/cut.log", "wb") as out:
            out.write(to)

    cut(data)
    assert read() == 40
    for lost in (49, 50, 51, 52, 52 * 3):  # within a frame's length or between frames: the log ends there
        cut(data[:-lost])
        assert read() == 40 - -(-lost // 52)
    for lost in (1, 30, 48, 53):
        cut(data[:-lost])
        with pytest.raises(Exception, match="cut off within a frame"):
            read()
    for bad in (b"", b"QNT", b"NOPE" + data[4:]):
        cut(bad)
        with pytest.raises(Exception, match="is no event log"):
            read()
    cut(data[:10])
    with pytest.raises(Exception, match="cut off within a frame"):
        read()
    cut(data + struct.pack("<II", 4, 9))
    with pytest.raises(Exception, match="variant 9"):
        read()


def test_pieces_do_not_show(spark, monkeypatch):
    import io

    rows = [{"kind": "trade", "px_raw": i, "qty_raw": i, "side": "Buy", "exch_ns": i, "recv_ns": i, "tid": i} for i in range(50)]
    rows.insert(20, {"kind": "book", "exch_ns": 1, "recv_ns": 1, "bids": [{"px_raw": 1, "qty_raw": 2, "n_orders": 3}] * 9, "asks": []})
    data = eventlog.MAGIC + eventlog.header_frame("v", "i", 3) + b"".join(map(eventlog.encode, rows))
    for piece in (1, 7, 52, 1000):
        monkeypatch.setattr(eventlog, "PIECE_BYTES", piece)
        log = eventlog.Frames(io.BytesIO(data), "x")
        got = [int(r["tid"]) if not isinstance(part, list) else r["kind"] for part in log for r in part]
        assert got == [*range(20), "book", *range(20, 50)] and (log.venue, log.instrument, log.created_ms) == ("v", "i", 3)


def test_commit_and_abort(spark, tmp_path):
    t, path = trades(spark), f"file://{tmp_path}/log"
    eventlog.write_log(t, path)
    n = t.count()
    # A file that no list names isn't part of the log; a failed write leaves nothing.
    with open(f"{tmp_path}/log/stray.log", "wb") as out:
        out.write(b"half")
    with pytest.raises(Exception, match="Buy or Sell"):
        eventlog.write_log(t.withColumn("side", F.when(F.col("tid") % 50 == 7, "None").otherwise(F.col("side"))), path)
    assert eventlog.read_log(spark, path).count() == n and not os.listdir(f"{tmp_path}/log/_staging")
    eventlog.write_log(t.limit(10), path)
    assert eventlog.read_log(spark, path).count() == n + 10
    eventlog.write_log(t.limit(5), path, mode="overwrite")
    assert eventlog.read_log(spark, path).count() == 5


def test_the_header_must_name_the_instrument(spark, tmp_path):
    eventlog.write_log(trades(spark).where("instrument = 'click'"), f"file://{tmp_path}/log")
    assert eventlog.read_log(spark, f"file://{tmp_path}/log", "click").count() > 0
    with pytest.raises(Exception, match="not view"):
        eventlog.read_log(spark, f"file://{tmp_path}/log", "view").count()
