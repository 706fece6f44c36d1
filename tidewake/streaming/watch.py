"""Watchdogs, bounded delivery and live counters of streams."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from tidewake.streaming.replay import named


class Silence(StatefulProcessor):
    """State of a key: its last time. A timer is set for when it will have been silent too long."""

    def __init__(self, limit_ms: int, by_event: bool):
        self.limit, self.by_event = limit_ms, by_event

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _rows(self, key, since: list[int]) -> Iterator[pd.DataFrame]:
        if since:
            yield pd.DataFrame({"key": [key[0]] * len(since), "silent_ms": since, "told_ms": [s + self.limit for s in since]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.last.get()
        last = int(found[0]) if found else None
        if last is not None:
            self.handle.deleteTimer(last + self.limit)
        times = sorted(int(t) for frame in rows for t in frame["at"].to_numpy("datetime64[ms]").astype("int64"))
        silent: list[int] = []
        if self.by_event:
            for t in times:
                if last is not None and t - last > self.limit:
                    silent.append(last)
                last = t if last is None else max(last, t)
        else:
            last = timerValues.getCurrentProcessingTimeInMs()
        self.last.update((last,))
        self.handle.registerTimer(last + self.limit)
        yield from self._rows(key, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A key that was told is new when it speaks again, so a silence is told once.
        last = int(self.last.get()[0])
        self.last.clear()
        yield from self._rows(key, [last])

    def close(self) -> None:
        pass


def silences(stream: DataFrame, limit_ms: int = 75_000, late: str = "0 seconds", by_event: bool = True) -> DataFrame:
    """(key, silent_ms, told_ms): keys of (key, at) without a row for longer than the limit, since when, and when that was told; once a silence.

    By event time, rows of a key come in order and the watermark is the clock: what is silent at its
    end is told, too. Otherwise the clock is the machine's, and silences are of arrival.
    """
    kind = stream.schema["key"].dataType.simpleString()
    timed = stream.select("key", "at")
    timed = (timed.withWatermark("at", late) if by_event else timed).where(named("key", "at"))
    return timed.groupBy("key").transformWithStateInPandas(Silence(limit_ms, by_event), f"key {kind}, silent_ms long, told_ms long", "append", "EventTime" if by_event else "ProcessingTime")


class Admission(StatefulProcessor):
    """State of a key: how many rows each open period has let in and turned away."""

    def __init__(self, most: int, period_ms: int):
        self.most, self.period = most, period_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "period long", "admitted long, dropped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        period = frame["at"].to_numpy("datetime64[ms]").astype("int64") // self.period
        # Of a batch's rows of a period the first are let in, as far as earlier batches left room.
        before = {}
        for p in set(period.tolist()):
            before[p] = tuple(map(int, self.used.getValue((p,)))) if self.used.containsKey((p,)) else (0, 0)
        place = frame.groupby(period).cumcount().to_numpy()
        room = [self.most - before[p][0] for p in period.tolist()]
        fine = place < room
        counts = pd.DataFrame({"p": period, "in": fine}).groupby("p")["in"].agg(["sum", "count"])
        for p, (n, of) in zip(counts.index.tolist(), counts.to_numpy().tolist()):
            self.used.updateValue((p,), (before[p][0] + int(n), before[p][1] + int(of - n)))
            if before[p] == (0, 0):
                self.handle.registerTimer((p + 1) * self.period)
        yield pd.DataFrame({"key": [key[0]] * len(frame), "at": frame["at"], "seq": frame["seq"], "kind": ["row" if x else "dropped" for x in fine], "n": 1})[fine]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p = expiredTimerInfo.getExpiryTimeInMs() // self.period - 1
        admitted, dropped = map(int, self.used.getValue((p,)))
        self.used.removeKey((p,))
        at = pd.to_datetime([p * self.period], unit="ms")
        yield pd.DataFrame({"key": [key[0]] * 2, "at": at.repeat(2), "seq": [0, 0], "kind": ["admitted", "dropped"], "n": [admitted, dropped]})

    def close(self) -> None:
        pass


def bounded_delivery(stream: DataFrame, most: int, period_ms: int = 1000, late: str = "0 seconds") -> DataFrame:
    """At most so many rows of a key a period of event time, of (key, at, seq): (key, at, seq, kind, n).

    Rows that are let in have kind 'row'. When the watermark has passed a period, its counts come as rows of
    kinds 'admitted' and 'dropped' and its state goes: nothing is lost untold. The first rows by (at, seq) of a
    batch go in, earlier batches before later ones.
    """
    kind = stream.schema["key"].dataType.simpleString()
    timed = stream.select("key", "at", "seq").withWatermark("at", late).where(named("key", "at"))
    return timed.groupBy("key").transformWithStateInPandas(Admission(most, period_ms), f"key {kind}, at timestamp, seq long, kind string, n long", "append", "EventTime")


class Counters(StreamingQueryListener):
    """Observed metrics of each batch of the streams it listens to, until they end."""

    def __init__(self, name: str):
        self.name, self.found, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            # A repeated batch replaces its own counts.
            self.found[event.progress.batchId] = {k: v for k, v in row.asDict().items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        """(batch, metric, value) of all batches."""
        rows = [(b, k, float(v)) for b, m in sorted(self.found.items()) for k, v in m.items() if v is not None]
        return spark.createDataFrame(rows, "batch long, metric string, value double")


def counted(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """The stream, observed: aggregates of each batch, which reach a ``Counters`` of the same name as the batch is done."""
    return stream.observe(name, *(c.alias(k) for k, c in metrics.items()))


def listened(spark: SparkSession, name: str, run, wait: float = 60.0) -> DataFrame:
    """Run a stream that is ``counted`` under the name, and give its counters as a table."""
    counters = Counters(name)
    spark.streams.addListener(counters)
    try:
        run()
        if not counters.ended.wait(wait):
            raise TimeoutError("the stream's last counters didn't come")
    finally:
        spark.streams.removeListener(counters)
    return counters.table(spark)
