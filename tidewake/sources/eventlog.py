"""Framed binary event logs as a data source: a partition a file, written with a commit.

A log is a magic of four bytes, a frame with the header (venue, instrument,
creation time in ms), and a frame an event. A frame is its length as four bytes and so many bytes of
little-endian fields: texts and lists behind a count of eight bytes, variants as four bytes. A file that ends
within a frame is an error; one that ends within a frame's length ends there.

Files are read in pieces; runs of trades, all of one size, and runs of books are decoded at once. Tasks write
into a staging folder; the driver moves what committed tasks wrote to its place, then
writes a list of it. Readers of a folder with lists read listed files alone, so nothing half
written is seen, and a task that ran twice counts once. All file systems that Arrow opens by their URI will do.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The processes that plan a data source may not have this library on their path, so it is sent to them whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of the format: its first bytes, the variants of events and the sides.
MAGIC = b"QNT1"
TRADE, BOOK, CANDLE = 0, 1, 2
SIDES = ["Buy", "Sell"]
#: A trade's frame with its length; a level; a candle without its variant.
TRADE_FRAME = np.dtype([("size", "<u4"), ("kind", "<u4"), ("px_raw", "<i8"), ("qty_raw", "<i8"), ("side", "<u4"), ("exch_ns", "<i8"), ("recv_ns", "<i8"), ("tid", "<u8")])
LEVEL = "<qqI"
LEVEL_ITEM = np.dtype([("px_raw", "<i8"), ("qty_raw", "<i8"), ("n_orders", "<u4")])
#: A book's frame up to its bids; behind them stands the number of asks.
BOOK_HEAD = np.dtype([("size", "<u4"), ("kind", "<u4"), ("exch_ns", "<i8"), ("recv_ns", "<i8"), ("bids", "<u8")])
CANDLE_BODY = "<qqqqqqqqI"

PIECE_BYTES = 1 << 22
BATCH_ROWS = 1 << 15
#: Books that stand together from which on they are decoded at once.
FEW = 16
#: Events of a file, which one task writes and one reads.
FILE_ROWS = 1 << 18

_LEVELS = "array<struct<px_raw: long, qty_raw: long, n_orders: long>>"
SCHEMA = (
    "file string, venue string, instrument string, created_ms long, n long, kind string, exch_ns long, recv_ns long, px_raw long, qty_raw long, side string, tid long, "
    f"bids {_LEVELS}, asks {_LEVELS}, open_ns long, open long, high long, low long, close long, volume long, n_trades long"
)


class LogError(ValueError):
    """A file that is no log or is cut off."""


def _text(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<Q", data, at)
    return data[at + 8 : at + 8 + n].decode(), at + 8 + n


def header_frame(venue: str, instrument: str, created_ms: int) -> bytes:
    body = b"".join(struct.pack("<Q", len(t := x.encode())) + t for x in (venue, instrument)) + struct.pack("<q", created_ms)
    return struct.pack("<I", len(body)) + body


def _levels(data: bytes, at: int) -> tuple[list[dict], int]:
    (n,) = struct.unpack_from("<Q", data, at)
    end = at + 8 + n * struct.calcsize(LEVEL)
    return [dict(zip(("px_raw", "qty_raw", "n_orders"), x)) for x in struct.iter_unpack(LEVEL, data[at + 8 : end])], end


def decode(body: bytes) -> dict:
    """One event's columns."""
    (kind,) = struct.unpack_from("<I", body)
    if kind == TRADE:
        px, qty, side, exch, recv, tid = struct.unpack_from("<qqIqqQ", body, 4)
        return {"kind": "trade", "exch_ns": exch, "recv_ns": recv, "px_raw": px, "qty_raw": qty, "side": SIDES[side], "tid": tid}
    if kind == BOOK:
        exch, recv = struct.unpack_from("<qq", body, 4)
        bids, at = _levels(body, 20)
        return {"kind": "book", "exch_ns": exch, "recv_ns": recv, "bids": bids, "asks": _levels(body, at)[0]}
    if kind == CANDLE:
        opened, exch, recv, *prices, volume, trades = struct.unpack_from(CANDLE_BODY, body, 4)
        return {"kind": "candle", "exch_ns": exch, "recv_ns": recv, "open_ns": opened, **dict(zip(("open", "high", "low", "close"), prices)), "volume": volume, "n_trades": trades}
    raise LogError(f"no event has the variant {kind}")


def encode(row: dict) -> bytes:
    """One event's frame."""
    if row["kind"] == "trade":
        body = struct.pack("<IqqIqqQ", TRADE, row["px_raw"], row["qty_raw"], SIDES.index(row["side"]), row["exch_ns"], row["recv_ns"], row["tid"])
    elif row["kind"] == "book":
        ladder = lambda levels: struct.pack("<Q", len(levels)) + b"".join(struct.pack(LEVEL, x["px_raw"], x["qty_raw"], x["n_orders"]) for x in levels)
        body = struct.pack("<Iqq", BOOK, row["exch_ns"], row["recv_ns"]) + ladder(row["bids"]) + ladder(row["asks"])
    elif row["kind"] == "candle":
        body = struct.pack("<I", CANDLE) + struct.pack(CANDLE_BODY, *(row[c] for c in ("open_ns", "exch_ns", "recv_ns", "open", "high", "low", "close", "volume", "n_trades")))
    else:
        raise LogError(f"no event is of the kind {row['kind']}")
    return struct.pack("<I", len(body)) + body


def _gathered(data: np.ndarray, at: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The items that begin at the places."""
    return data[at[:, None] + np.arange(kind.itemsize)].reshape(-1).view(kind)


def _level_places(n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where levels begin: ``n`` of each book, from its start on."""
    before = np.cumsum(n) - n
    return np.repeat(start - before * LEVEL_ITEM.itemsize, n) + np.arange(n.sum()) * LEVEL_ITEM.itemsize


class Frames:
    """A log's header, and its events read in pieces: runs of trades as an array, runs of books as columns, others as rows."""

    def __init__(self, source, name: str):
        self.source, self.name, self.data, self.at = source, name, b"", 0
        if self._more(4) < 4 or self.data[:4] != MAGIC:
            raise LogError(f"{name} is no event log")
        self.at = 4
        body = self._frame()
        if body is None:
            raise LogError(f"{name} is cut off within a frame")
        self.venue, at = _text(body, 0)
        self.instrument, at = _text(body, at)
        (self.created_ms,) = struct.unpack_from("<q", body, at)

    def _more(self, need: int) -> int:
        """How many bytes are there from the place on, at least ``need`` if the file has them."""
        if len(self.data) - self.at < need:
            parts, there = [self.data[self.at :]], len(self.data) - self.at
            while there < need and (part := self.source.read(max(PIECE_BYTES, need - there))):
                parts.append(part)
                there += len(part)
            self.data, self.at = b"".join(parts), 0
        return len(self.data) - self.at

    def _frame(self) -> bytes | None:
        if self._more(4) < 4:
            return None
        (size,) = struct.unpack_from("<I", self.data, self.at)
        if self._more(4 + size) < 4 + size:
            raise LogError(f"{self.name} is cut off within a frame")
        body = self.data[self.at + 4 : self.at + 4 + size]
        self.at += 4 + size
        return body

    def _trades(self) -> np.ndarray:
        """Trades that stand from the place on, one behind the other."""
        there = self._more(TRADE_FRAME.itemsize) // TRADE_FRAME.itemsize
        if there and struct.unpack_from("<I", self.data, self.at + 4)[0] != TRADE:
            there = 0
        found = np.frombuffer(self.data, TRADE_FRAME, min(there, BATCH_ROWS), self.at) if there else np.zeros(0, TRADE_FRAME)
        good = (found["size"] == TRADE_FRAME.itemsize - 4) & (found["kind"] == TRADE)
        run = found if good.all() else found[: int(np.argmin(good))]
        self.at += len(run) * TRADE_FRAME.itemsize
        return run

    def _books(self) -> dict | None:
        """Columns of the books that stand whole from the place on, one behind the other; None for few of them."""
        starts, at, end, head = [], self.at, len(self.data), struct.Struct("<II")
        while len(starts) < BATCH_ROWS and at + 8 <= end:
            size, kind = head.unpack_from(self.data, at)
            if kind != BOOK or size < 36 or at + 4 + size > end:
                break
            starts.append(at)
            at += 4 + size
        if len(starts) < FEW:
            return None
        data, first = np.frombuffer(self.data, np.uint8), np.array(starts, np.int64)
        heads = _gathered(data, first, BOOK_HEAD)
        room = (heads["size"].astype(np.int64) - 36) // LEVEL_ITEM.itemsize
        if (heads["bids"] > room.astype(np.uint64)).any():
            return None
        bids = heads["bids"].astype(np.int64)
        middle = first + BOOK_HEAD.itemsize + bids * LEVEL_ITEM.itemsize
        asks = _gathered(data, middle, np.dtype("<u8"))
        if (asks != (room - bids).astype(np.uint64)).any() or (heads["size"] != 36 + room * LEVEL_ITEM.itemsize).any():
            return None
        self.at = at
        sides = {"bids": (bids, first + BOOK_HEAD.itemsize), "asks": (asks.astype(np.int64), middle + 8)}
        return {c: heads[c] for c in ("exch_ns", "recv_ns")} | {c: (n, _gathered(data, _level_places(n, start), LEVEL_ITEM)) for c, (n, start) in sides.items()}

    def __iter__(self) -> Iterator[np.ndarray | dict | list[dict]]:
        others: list[dict] = []
        while True:
            run = self._trades()
            if len(run):
                if others:
                    yield others
                    others = []
                yield run
                continue
            books = self._books()
            if books:
                if others:
                    yield others
                    others = []
                yield books
                continue
            body = self._frame()
            if body is not None:
                others.append(decode(body))
            if others and (body is None or len(others) == BATCH_ROWS):
                yield others
                others = []
            if body is None:
                return


@dataclass
class LogFile(InputPartition):
    """One file of a log."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class Reader(DataSourceReader):
    """A partition a file."""

    def __init__(self, options: dict, schema: StructType):
        self.uri, self.instrument, self.schema = options["path"], options.get("instrument"), schema

    def partitions(self) -> list[LogFile]:
        system, root = fs.FileSystem.from_uri(self.uri)
        files = listed(system, root)
        # Without a file there is a partition of none, as Spark wants one.
        return [LogFile(f) for f in files] or [LogFile("")]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.uri)
        kinds = to_arrow_schema(self.schema)
        with system.open_input_stream(partition.path) as source:
            log = Frames(source, partition.path)
            if self.instrument is not None and log.instrument != self.instrument:
                raise LogError(f"{partition.path} holds {log.instrument}, not {self.instrument}")
            n = 0
            for part in log:
                size = len(part["exch_ns"]) if isinstance(part, dict) else len(part)
                same = lambda x: pa.repeat(x, size)  # noqa: B023, E731
                columns = {"file": same(partition.path), "venue": same(log.venue), "instrument": same(log.instrument), "created_ms": same(log.created_ms), "n": np.arange(n, n + size)}
                if isinstance(part, np.ndarray):
                    columns |= {c: part[c].astype(np.int64) for c in ("exch_ns", "recv_ns", "px_raw", "qty_raw", "tid")}
                    columns |= {"kind": same("trade"), "side": np.array(SIDES, object)[part["side"]]}
                elif isinstance(part, dict):
                    columns |= {"kind": same("book"), **{c: part[c].astype(np.int64) for c in ("exch_ns", "recv_ns")}}
                    columns |= {c: _ladders(*part[c], kinds.field(c).type) for c in ("bids", "asks") if c in kinds.names}
                else:
                    columns |= {f: [r.get(f) for r in part] for f in kinds.names if f not in columns}
                n += size
                made = lambda x, kind: x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind)
                yield pa.RecordBatch.from_arrays([made(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)


def _ladders(n: np.ndarray, levels: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Levels as lists, ``n`` of each book."""
    of = kind.value_type
    values = pa.StructArray.from_arrays([pa.array(levels[f.name].astype(np.int64), f.type) for f in of], fields=list(of))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values, type=kind)


def listed(system: fs.FileSystem, root: str) -> list[str]:
    """A log's files: one file, those that a folder's lists name, or all of a folder without lists."""
    if system.get_file_info(root).type == fs.FileType.File:
        return [root]
    files = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
    lists = [f for f in files if f.rpartition("/")[2].startswith("_list-")]
    if not lists:
        return sorted(f for f in files if f.endswith(".log") and "/_staging/" not in f)
    names = []
    for f in lists:
        with system.open_input_stream(f) as source:
            names += json.loads(source.read())["files"]
    return sorted(f"{root}/{name}" for name in names)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (staged name, events) of each file."""

    files: list


class Writer(DataSourceArrowWriter):
    """A file for each run of rows of one instrument in a task."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.venue, self.created_ms = options["path"], options.get("venue", ""), int(options.get("created_ms", 0))
        self.run, self.overwrite = uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.uri)
        system.create_dir(f"{root}/_staging/{self.run}", recursive=True)
        files: list[list] = []
        out, last = None, None
        try:
            for batch in iterator:
                names = batch.column("instrument").to_pylist()
                cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if out is None or names[a] != last:
                        if out is not None:
                            out.close()
                        last = names[a]
                        files.append([f"{uuid.uuid4().hex}.log", last, 0])
                        out = system.open_output_stream(f"{root}/_staging/{self.run}/{files[-1][0]}")
                        out.write(MAGIC + header_frame(self.venue, last, self.created_ms))
                    out.write(frames_of(batch.slice(a, b - a)))
                    files[-1][2] += b - a
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.uri)
        before = listed(system, root) if self.overwrite else []
        lists = [f.path for f in system.get_file_info(fs.FileSelector(root)) if self.overwrite and f.base_name.startswith("_list-")]
        names, counts = [], {}
        for message in messages:
            for name, instrument, n in message.files if message else []:
                system.move(f"{root}/_staging/{self.run}/{name}", f"{root}/{name}")
                names.append(name)
                counts[instrument] = counts.get(instrument, 0) + n
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_list-{self.run}") as out:
            out.write(json.dumps({"files": names, "events": counts}, sort_keys=True).encode())
        for f in [*lists, *before]:
            system.delete_file(f)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.uri))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_staging/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staging/{self.run}")


def frames_of(batch: pa.RecordBatch) -> bytes:
    """The frames of a batch's rows; trades or books alone at once."""
    if "kind" in batch.schema.names and batch.column("kind").unique().to_pylist() == ["book"]:
        return _book_frames(batch)
    if "kind" in batch.schema.names and batch.column("kind").unique().to_pylist() != ["trade"]:
        return b"".join(map(encode, batch.to_pylist()))
    out = np.zeros(batch.num_rows, TRADE_FRAME)
    out["size"], out["kind"] = TRADE_FRAME.itemsize - 4, TRADE
    sides = batch.column("side").to_pylist()
    if not set(sides) <= set(SIDES):
        raise LogError("a trade's side must be Buy or Sell")
    out["side"] = [SIDES.index(s) for s in sides]
    for c in ("px_raw", "qty_raw", "exch_ns", "recv_ns", "tid"):
        if batch.column(c).null_count:
            raise LogError(f"a trade has no {c}")
        out[c] = batch.column(c).to_numpy(zero_copy_only=False)
    return out.tobytes()


def _book_frames(batch: pa.RecordBatch) -> bytes:
    """The frames of a batch of books."""
    for c in ("exch_ns", "recv_ns", "bids", "asks"):
        if batch.column(c).null_count:
            raise LogError(f"a book has no {c}")
    counts = {c: pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bids", "asks")}
    heads = np.zeros(batch.num_rows, BOOK_HEAD)
    heads["size"], heads["kind"], heads["bids"] = 36 + (counts["bids"] + counts["asks"]) * LEVEL_ITEM.itemsize, BOOK, counts["bids"]
    for c in ("exch_ns", "recv_ns"):
        heads[c] = batch.column(c).to_numpy(zero_copy_only=False)
    sizes = heads["size"].astype(np.int64) + 4
    first = np.cumsum(sizes) - sizes
    middle = first + BOOK_HEAD.itemsize + counts["bids"] * LEVEL_ITEM.itemsize
    out = np.zeros(int(sizes.sum()), np.uint8)

    def put(at: np.ndarray, items: np.ndarray) -> None:
        out[at[:, None] + np.arange(items.itemsize)] = items.view(np.uint8).reshape(len(items), items.itemsize)

    put(first, heads)
    put(middle, counts["asks"].astype("<u8"))
    for c, start in (("bids", first + BOOK_HEAD.itemsize), ("asks", middle + 8)):
        flat = batch.column(c).flatten()
        levels = np.zeros(len(flat), LEVEL_ITEM)
        for field, values in zip(flat.type, flat.flatten()):
            if values.null_count:
                raise LogError(f"a level has no {field.name}")
            found = values.to_numpy(zero_copy_only=False)
            if field.name == "n_orders" and len(found) and not 0 <= found.min() <= found.max() < 1 << 32:
                raise LogError("a level's number of orders must fit four bytes")
            levels[field.name] = found
        put(_level_places(counts[c], start), levels)
    return out.tobytes()


class EventLog(DataSource):
    """spark.read / df.write with format "eventlog"; ``path`` is a file or a folder's URI, ``instrument`` the only one that a log may hold."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def write_log(events: DataFrame, path: str, venue: str = "", created_ms: int = 0, mode: str = "append", rows_a_file: int = FILE_ROWS) -> None:
    """Events (instrument, kind and a kind's columns) as logs in order of their exchange time; instruments of many rows are dealt to several files by ranges of it."""
    from tidewake.operators.scan import written

    events.sparkSession.dataSource.register(EventLog)
    # Counting, finding ranges and dealing read what is made once.
    events = written(events)
    kinds = [] if "tid" not in events.columns else ["tid"]
    parts = max(1, -(-events.count() // rows_a_file))
    dealt = events.repartitionByRange(parts, "instrument", "exch_ns", *kinds).sortWithinPartitions("instrument", "exch_ns", *kinds)
    dealt.write.format("eventlog").option("venue", venue).option("created_ms", created_ms).mode(mode).save(path)


def read_log(spark: SparkSession, path: str, instrument: str | None = None) -> DataFrame:
    """A log's events, with their file and place in it; a file of another instrument is an error."""
    spark.dataSource.register(EventLog)
    reader = spark.read.format("eventlog")
    return (reader if instrument is None else reader.option("instrument", instrument)).load(path)


def written_counts(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, events) that the folder's lists tell of: what its writers counted."""
    found = _lists(spark, path).select(F.explode(F.from_json(F.get_json_object("value", "$.events"), "map<string,long>")).alias("instrument", "n"))
    return found.groupBy("instrument").agg(F.sum("n").alias("events"))


def _lists(spark: SparkSession, path: str) -> DataFrame:
    """A row a list: one for each write."""
    system, root = fs.FileSystem.from_uri(path)
    out = []
    for f in system.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith("_list-"):
            with system.open_input_stream(f.path) as source:
                out.append((source.read().decode(),))
    return spark.createDataFrame(out, "value string")
