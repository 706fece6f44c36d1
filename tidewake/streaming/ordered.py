"""Positions in the order of sequence numbers, however their fills arrive.

Fills carry their account's sequence number, from 1 without gaps. What arrives
ahead of its turn is held in map state, as runs of consecutive numbers; what
arrives behind its turn (repeated, or after its gap was given up) changes nothing and is
told as late. A gap is given up once the watermark has passed a held fill by ``patience``:
an event-time timer then lets the held fills go in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from tidewake.operators.execution import Position
from tidewake.streaming.replay import named

FILL = ["seq", "side", "qty_raw", "px_raw", "fee_raw"]


class Ordered(StatefulProcessor):
    """State of an account: what is next, the position, and runs of fills ahead of their turn."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "next long, n long, qty long, entry long, realised long")
        self.held = handle.getMapState("held", "first long", "ms long, seq array<long>, side array<long>, qty_raw array<long>, px_raw array<long>, fee_raw array<long>")

    def _load(self) -> tuple[list[int], Position]:
        found = self.known.get()
        at = [int(v) for v in found] if found else [1, 0, 0, 0, 0]
        return at[:2], Position(*at[2:])

    def _fill(self, at: list[int], p: Position, rows: Iterator[tuple], out: list) -> None:
        for seq, side, qty, px, fee in rows:
            late = seq < at[0]
            if not late:
                p.fill(side, qty, px, fee)
                at[:] = seq + 1, at[1] + 1
            out.append((seq, at[1], p.qty, p.entry, p.realised, late))

    def _starts(self) -> set[int]:
        """Where held runs begin: asked of the state once a call, then kept up."""
        return {k[0] for k in self.held.keys()}

    def _release(self, at: list[int], p: Position, until_ms: int | None, out: list, starts: set[int]) -> None:
        """Held runs whose turn has come; with a time, also those up to the last that is as old."""
        old = -1
        if until_ms is not None:
            old = max((s for s in starts if self.held.getValue((s,))[0] <= until_ms), default=-1)
        for s in sorted(starts):
            if s > at[0] and s > old:
                break
            _, *columns = self.held.getValue((s,))
            self._fill(at, p, zip(*([int(v) for v in c] for c in columns)), out)
            self.held.removeKey((s,))
            starts.remove(s)

    def _done(self, key, at: list[int], p: Position, out: list) -> Iterator[pd.DataFrame]:
        self.known.update((*at, p.qty, p.entry, p.realised))
        if out:
            seq, n, qty, entry, realised, late = zip(*out)
            yield pd.DataFrame({"account": [key[0]] * len(out), "seq": seq, "n": n, "qty_raw": qty, "entry_raw": entry, "realised_raw": realised, "late": late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, p = self._load()
        out: list[tuple] = []
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seq = frame["seq"].to_numpy(np.int64)
        columns = [seq, np.where(frame["side"] == "Buy", 1, -1), *(frame[c].to_numpy(np.int64) for c in FILL[2:])]
        ms = frame["at"].to_numpy("datetime64[ms]").astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(seq) > 1) + 1), len(seq)]
        holding, starts = None, self._starts()
        for a, b in zip(cuts, cuts[1:]):
            if seq[a] <= at[0]:
                self._fill(at, p, zip(*(c[a:b].tolist() for c in columns)), out)
                self._release(at, p, None, out, starts)
            else:
                first = int(seq[a])
                run = (int(ms[a:b].min()), *(c[a:b].tolist() for c in columns))
                if first in starts:
                    was = self.held.getValue((first,))
                    # Two runs from one number: the longer one holds the other's fills.
                    run = run if len(was[1]) < b - a else tuple(int(v) if i == 0 else [int(x) for x in v] for i, v in enumerate(was))
                self.held.updateValue((first,), run)
                starts.add(first)
                holding = min(holding or run[0], run[0])
        if holding is not None:
            self.handle.registerTimer(holding + self.patience)
            self._release(at, p, None, out, starts)
        yield from self._done(key, at, p, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, p = self._load()
        out: list[tuple] = []
        self._release(at, p, expiredTimerInfo.getExpiryTimeInMs() - self.patience, out, self._starts())
        yield from self._done(key, at, p, out)

    def close(self) -> None:
        pass


def positions(stream: DataFrame, late: str = "1 day", patience_ms: int = 60_000) -> DataFrame:
    """(account, seq, n, qty_raw, entry_raw, realised_raw, late) of fills (account, seq, at, side, qty_raw, px_raw, fee_raw), in each account's order.

    ``n`` counts the fills that took effect. Accounts are of any type.
    """
    kind = stream.schema["account"].dataType.simpleString()
    out = f"account {kind}, seq long, n long, qty_raw long, entry_raw long, realised_raw long, late boolean"
    timed = stream.select("account", "at", *FILL).withWatermark("at", late).where(named("account", "at"))
    return timed.groupBy("account").transformWithStateInPandas(Ordered(patience_ms), out, "append", "EventTime")
