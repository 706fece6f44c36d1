"""Tables as streams of files, and streams run until they have given all that they have.

Batches are written under their number, so a batch that is repeated replaces its
own rows: effects happen once. Files and state lie in the shared folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewake.shared import folder

#: State of more than a value and timers need this store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{folder(spark)}/{kind}/{uuid.uuid4().hex}"


@dataclass
class Replay:
    """A stream over a folder of files that can be added to."""

    spark: SparkSession
    path: str
    schema: StructType
    files_a_batch: int

    def add(self, rows: DataFrame) -> None:
        """One more file, which is the last to be read."""
        rows.select(self.schema.names).coalesce(1).write.mode("append").parquet(self.path)

    def close(self, time: str, beyond: str) -> None:
        """A last row of nulls but for its time, far enough behind all others that watermarks pass them: what waits for one comes out."""
        last = self.spark.read.schema(self.schema).parquet(self.path).agg((F.max(time) + F.expr(f"INTERVAL {beyond}")).alias(time))
        self.add(last.select(*(F.col(time) if c.name == time else F.lit(None).cast(c.dataType).alias(c.name) for c in self.schema)))

    def stream(self) -> DataFrame:
        """The files that are there when a run starts, and those that come later."""
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_a_batch).parquet(self.path)


def replayed(rows: DataFrame, order: list[str], files: int = 8, files_a_batch: int = 2, turn: Callable[[int], object] = lambda i: i) -> Replay:
    """Rows as files by ranges of the order, delivered by ``turn`` of the range's number: as they stand, or in another order."""
    spark = rows.sparkSession
    ranges = fresh(spark, "ranges")
    # spark_partition_id() is settled by the write.
    rows.repartitionByRange(files, *order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(ranges)
    out = Replay(spark, fresh(spark, "replays"), rows.schema, files_a_batch)
    rows.limit(0).write.parquet(out.path)
    # A range is one task's file: it is moved, not written again, and its time tells its turn.
    root = spark._jvm.org.apache.hadoop.fs.Path(ranges)
    system, at = root.getFileSystem(spark._jsc.hadoopConfiguration()), time.time_ns() // 1_000_000
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for place, i in enumerate(sorted(range(files), key=turn)):
        for f in system.globStatus(path(f"{ranges}/_range={i}/part-*")) or []:
            to = path(f"{out.path}/{f.getPath().getName()}")
            if not system.rename(f.getPath(), to):
                raise OSError(f"can't move {f.getPath()}")
            system.setTimes(to, at - files + place, -1)
    return out


def named(key: str, at: str) -> Column:
    """Rows with a key. It reads the time, too, so that it stays behind the watermark, which rows without a key (see ``close``) move."""
    return F.when(F.col(at).isNotNull(), F.col(key).isNotNull()).otherwise(False)


class Run:
    """A stream's rows by batch, and its state, which a later run goes on from."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh(spark, "streams")

    def keep(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")

    def drain(self, stream: DataFrame, mode: str = "append", keep: Callable[[DataFrame, int], None] | None = None) -> Run:
        """All that is there now."""
        self._start(stream, mode, keep, {"availableNow": True}).awaitTermination()
        return self

    def session(self, stream: DataFrame, mode: str = "append", seconds: float = 60.0, batches: int | None = None, every: str = "0 seconds", keep: Callable[[DataFrame, int], None] | None = None) -> bool:
        """Run for so many seconds or batches and stop between batches; whether it was the bound that ended it. State and rows stay for the next session."""
        left = batches
        bound = []

        def counted(batch: DataFrame, number: int) -> None:
            nonlocal left
            if left is not None and left <= 0:
                # A batch past the bound isn't written: it is open and the next session begins with it.
                bound.append(number)
                raise Ended
            (keep or self.keep)(batch, number)
            left = left if left is None else left - 1

        query = self._start(stream, mode, counted, {"processingTime": every})
        try:
            ended = query.awaitTermination(seconds)
        except Exception:
            if not bound:
                raise
            ended = True
        finally:
            query.stop()
        return bool(bound) or not ended

    def _start(self, stream: DataFrame, mode: str, keep, trigger: dict):
        # A stream copies the session's settings as it starts; state has a partition a core at most.
        size = "spark.sql.shuffle.partitions"
        new = {PROVIDER: ROCKS, size: str(min(int(self.spark.conf.get(size)), self.spark.sparkContext.defaultParallelism))}
        was = {k: self.spark.conf.get(k) for k in new}
        for k, v in new.items():
            self.spark.conf.set(k, v)
        try:
            return stream.writeStream.foreachBatch(keep or self.keep).outputMode(mode).option("checkpointLocation", f"{self.path}/state").trigger(**trigger).start()
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)

    def rows(self, schema: StructType, last_only: bool = False) -> DataFrame:
        """The rows of all batches; of complete output only the last batch's."""
        numbers = self.batches()
        if not numbers:
            return self.spark.createDataFrame([], schema)
        of = max(numbers) if last_only else "*"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows/batch={of}")

    def batches(self) -> list[int]:
        """Numbers of the batches that are written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/batch=*/_SUCCESS")
        found: Iterable = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


class Ended(Exception):
    """A session's bound is reached."""
