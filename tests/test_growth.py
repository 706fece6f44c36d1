"""What must not follow the size of a table: rows of a task, files, passes."""

import glob
import io
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewake.operators import segments
from tidewake.sources import adapters, eventlog
from tidewake.streaming.replay import replayed

PATH = "/root/testdata/sf0.001"


def test_reports_and_levels_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 200)
    n = adapters.table(spark, PATH, "lineitem").count()
    for rows, key in ((adapters.exec_reports(spark, PATH), "cloid"), (adapters.l2_levels(spark, PATH), "snap")):
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and len(sizes) >= n // 400 and max(sizes) < 600
        assert rows.select(key, F.spark_partition_id().alias("p")).distinct().count() == rows.select(key).distinct().count()


def test_positions_make_their_fills_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            made.add(len(f))
            yield f

    fills = spark.createDataFrame([(i % 3, i, "Buy" if i % 5 else "Sell", 10**8, 10**9 + i, 0) for i in range(60)], "a long, seq long, side string, qty_raw long, px_raw long, fee_raw long")
    assert segments.positions(fills.mapInPandas(seen, fills.schema), ["a"], ["seq"]).count() == 60
    assert made.value == 60


def test_books_are_coded_in_runs():
    level = pa.struct([("px_raw", pa.int64()), ("qty_raw", pa.int64()), ("n_orders", pa.int64())])
    rng = random.Random(5)
    ladder = lambda: [{"px_raw": rng.randint(-9, 9) << 40, "qty_raw": rng.randint(0, 9), "n_orders": rng.randrange(1 << 32)} for _ in range(rng.randrange(4))]
    rows = [{"kind": "book", "exch_ns": i, "recv_ns": -i, "bids": ladder(), "asks": ladder()} for i in range(90)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("exch_ns", pa.int64()), ("recv_ns", pa.int64()), ("bids", pa.list_(level)), ("asks", pa.list_(level))]))
    data = eventlog.frames_of(batch.slice(7))
    assert data == b"".join(map(eventlog.encode, rows[7:]))
    (run,) = eventlog.Frames(io.BytesIO(eventlog.MAGIC + eventlog.header_frame("v", "i", 3) + data), "x")
    assert run["exch_ns"].tolist() == list(range(7, 90)) and run["recv_ns"].tolist() == [-i for i in range(7, 90)]
    for side in ("bids", "asks"):
        n, levels = run[side]
        assert n.tolist() == [len(r[side]) for r in rows[7:]] and levels.tolist() == [tuple(x.values()) for r in rows[7:] for x in r[side]]


def test_a_replays_files_are_written_once_in_their_turn(spark):
    replay = replayed(spark.range(1000), ["id"], files=5, turn=lambda i: -i)
    base = replay.path.removeprefix("file:").rpartition("/replays/")[0].replace("//", "/")
    files = sorted((os.stat(f).st_mtime_ns, f) for f in glob.glob(f"{replay.path.removeprefix('file:').replace('//', '/')}/part-*"))
    firsts = [t["id"][0].as_py() for _, f in files if len(t := pq.read_table(f))]
    assert len(firsts) == 5 and firsts == sorted(firsts, reverse=True)
    moved = [f for f in glob.glob(f"{base}/ranges/*/_range=*/part-*") if sum(pq.read_table(f, columns=["id"]).column("id").to_pylist()) >= 0 and pq.read_schema(f).names == ["id"]]
    assert not moved
