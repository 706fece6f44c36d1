"""Order and position bookkeeping, risk gate, and the event-driven backtest.

Closed forms are window expressions; what truly depends on its path is a step
for ``ordered_fold``. Money is in raw longs and truncated at each step, with
Python's integers, which don't overflow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import fixed
from tidewake.operators.fold import ordered_fold

SCALE = fixed.SCALE


def cut(a: int, b: int) -> int:
    """a / b truncated towards zero."""
    q = abs(a) // abs(b)
    return q if (a >= 0) == (b >= 0) else -q


@dataclass
class Position:
    """Signed quantity, average entry and realised profit, all raw."""

    qty: int = 0
    entry: int = 0
    realised: int = 0

    def fill(self, side: int, qty: int, px: int, fee: int) -> None:
        """Extend blends the entry, reduce keeps it, a flip sets it, flat clears it; fees are realised."""
        signed = side * qty
        closed = min(abs(self.qty), qty) if self.qty and (self.qty > 0) != (signed > 0) else 0
        if closed:
            gain = (px - self.entry) * (1 if self.qty > 0 else -1)
            self.realised += cut(gain * closed, SCALE)
        self.realised -= fee
        after = self.qty + signed
        if not after:
            self.entry = 0
        elif not closed:
            self.entry = cut(self.entry * abs(self.qty) + px * qty, abs(self.qty) + qty)
        elif (after > 0) == (signed > 0):
            self.entry = px
        self.qty = after


def first_fills(reports: DataFrame) -> DataFrame:
    """Each order's first report of each fill id: repeated ids have no effect."""
    once = Window.partitionBy("cloid", "fill_id").orderBy("seq")
    return reports.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def order_states(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """(cloid, filled_raw, vwap_raw, fees_raw, status) of registered orders; a fill past the order's end is a duplicate.

    The average price is cut to whole raw units at each fill, so it depends on
    the fills' order: it is folded over an order's own fills.
    """
    fills = first_fills(reports).join(requests.select("cloid", F.col("qty_raw").alias("order_qty")), "cloid")
    path = Window.partitionBy("cloid").orderBy("seq")
    before = F.coalesce(F.sum("qty_raw").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = fills.withColumn("before", before).where("before < order_qty")
    done = used.groupBy("cloid", "order_qty").agg(F.array_sort(F.collect_list(F.struct("seq", "qty_raw", "px_raw", "fee_raw"))).alias("fills"))
    exact = lambda x: f"cast({x} AS DECIMAL(19, 0))"
    blended = f"({exact('a.px')} * {exact('a.qty')} + {exact('f.px_raw')} * {exact('f.qty_raw')}) div {exact('(a.qty + f.qty_raw)')}"
    folded = F.expr(
        "aggregate(fills, named_struct('qty', 0L, 'px', 0L, 'fee', 0L), (a, f) -> named_struct("
        f"'qty', a.qty + f.qty_raw, 'px', if(a.qty + f.qty_raw = 0, f.px_raw, {blended}), 'fee', a.fee + f.fee_raw))"
    )
    return done.withColumn("x", folded).select(
        "cloid", F.col("x.qty").alias("filled_raw"), F.col("x.px").alias("vwap_raw"), F.col("x.fee").alias("fees_raw"), F.when(F.col("x.qty") >= F.col("order_qty"), "Filled").otherwise("PartiallyFilled").alias("status")
    )


def positions(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, n, qty_raw, entry_raw, realised_raw) after each fill, in order."""

    def step(state, row):
        state["p"].fill(1 if row.side == "Buy" else -1, int(row.qty_raw), int(row.px_raw), int(row.fee_raw))
        state["n"] += 1
        return [(state["n"], state["p"].qty, state["p"].entry, state["p"].realised)]

    return ordered_fold(fills, keys, order, lambda: {"p": Position(), "n": 0}, step, "n long, qty_raw long, entry_raw long, realised_raw long")


def kill_switch(path: DataFrame, keys: list[str], order: list[str], limit: float) -> DataFrame:
    """The path with peak, drawdown and ``killed``, which latches once the drawdown reaches the limit.

    A boolean column ``reset`` (if there is one) starts a new epoch behind its
    row, with that row's equity as its peak.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = path
    part = keys
    if "reset" in path.columns:
        rows = rows.withColumn("epoch", F.coalesce(F.sum(F.col("reset").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = rows.withColumn("_floor", F.when(F.lag("reset").over(w), F.lag("equity").over(w)))
        part = [*keys, "epoch"]
    else:
        rows = rows.withColumn("_floor", F.lit(None).cast("long"))
    run = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("peak", F.greatest(F.max("equity").over(run), F.coalesce(F.max("_floor").over(run), F.max("equity").over(run)))).drop("_floor")
    rows = rows.withColumn("drawdown", F.when(F.col("peak") > 0, 1 - F.col("equity") / F.col("peak")).otherwise(0.0))
    return rows.withColumn("killed", F.max(F.col("drawdown") >= limit).over(run))


def gate(orders: DataFrame, max_position: int, max_notional: int) -> DataFrame:
    """Decision on orders (position, side, qty_raw, px_raw, killed): reducing always passes, then kill, position and notional caps."""
    after = F.col("position") + fixed.sign(F.col("side")) * F.col("qty_raw")
    size = F.abs(fixed.notional(F.col("px_raw"), after))
    decision = (
        F.when(F.abs(after) <= F.abs("position"), "Allow")
        .when(F.col("killed"), "KillSwitchTripped")
        .when(F.abs(after) > max_position, "MaxPosition")
        .when(size > max_notional, "MaxNotional")
        .otherwise("Allow")
    )
    return orders.withColumn("resulting", after).withColumn("decision", decision)


#: Microseconds of a bucket of time in as-of joins.
BUCKET_US = 3_600_000_000


def _nearest(rows: DataFrame, keys: list[str], ahead: bool, bucket_us: int) -> DataFrame:
    """``rows`` (keys, at, s, kind, mark, ...) with ``m``, the nearest mark at or behind (``ahead``) or at or before each.

    A running window within (keys, bucket of time), so that one key's rows are
    dealt to many tasks; rows that see no mark in their bucket get the edge mark
    of the nearest bucket that has one, found among a row a bucket.
    """
    rows = rows.withColumn("bucket", F.floor(F.col("at") / bucket_us))
    to = F.desc if ahead else F.asc
    past = Window.partitionBy(*keys, "bucket").orderBy(to("at"), to("s"), to("kind")).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("m", F.last("mark", ignorenulls=True).over(past))
    place = F.when(F.col("mark").isNotNull(), F.struct("at", "s"))
    edge = (F.min_by if ahead else F.max_by)("mark", place)
    buckets = Window.partitionBy(*keys).orderBy(to("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(*keys, "bucket").agg(edge.alias("edge")).withColumn("edge", F.last("edge", ignorenulls=True).over(buckets))
    return seen.join(edges, [*keys, "bucket"], "left").withColumn("m", F.coalesce("m", "edge"))


def next_snapshot(orders: DataFrame, marks: DataFrame, keys: list[str], latency_us: int, bucket_us: int = BUCKET_US) -> DataFrame:
    """Each order with the first later mark at or behind its arrival (forward as-of): mark_us, mark_raw, or null.

    Orders (keys, cloid, ts_us, seq) and marks (keys, ts_us, seq, mark_raw) stand
    in one sequence of time and ``seq``. Without latency an order doesn't meet
    the mark that made it, but the next one in the sequence.
    """
    at_once = F.col("seq") if latency_us == 0 else F.lit(-(1 << 63))
    nothing = F.lit(None).cast("struct<mark_us: bigint, mark_raw: bigint>")
    left = orders.select(*keys, "cloid", (F.col("ts_us") + latency_us).alias("at"), at_once.cast("long").alias("s"), F.lit(1).alias("kind"), nothing.alias("mark"))
    mark = F.struct(F.col("ts_us").alias("mark_us"), "mark_raw")
    right = marks.select(*keys, F.lit(None).cast(orders.schema["cloid"].dataType).alias("cloid"), F.col("ts_us").alias("at"), F.col("seq").cast("long").alias("s"), F.lit(0).alias("kind"), mark.alias("mark"))
    seen = _nearest(left.union(right), keys, True, bucket_us)
    return seen.where("kind = 1").select(*keys, "cloid", F.col("at").alias("arrival_us"), F.col("m.mark_us").alias("mark_us"), F.col("m.mark_raw").alias("mark_raw"))


def last_mark(events: DataFrame, marks: DataFrame, keys: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """Each event with the last mark at or before it (backward as-of): mark_raw, or null; of marks at one time the highest."""
    left = events.select(*keys, F.col("tid"), F.col("ts_us").alias("at"), F.lit((1 << 63) - 1).alias("s"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("mark"))
    right = marks.select(*keys, F.lit(None).cast("long").alias("tid"), F.col("ts_us").alias("at"), F.col("mark_raw").cast("long").alias("s"), F.lit(0).alias("kind"), F.col("mark_raw").cast("long").alias("mark"))
    seen = _nearest(left.union(right), keys, False, bucket_us)
    return seen.where("kind = 1").select(*keys, "tid", F.col("m").alias("mark_raw"))


@dataclass
class Engine:
    """State of one instrument's backtest: account, working orders and the crossing strategy's means."""

    cash: int
    fast: int
    slow: int
    qty: int
    latency_us: int
    taker_ppm: int
    funding_us: int = 0
    funding_ppm: int = 0
    start_cash: int = 0
    pos: int = 0
    fees: int = 0
    funding: int = 0
    volume: int = 0
    fills: int = 0
    peak: int = 0
    max_dd: int = 0
    equity: int = 0
    next_funding: int | None = None
    pending: list[tuple[int, int]] = field(default_factory=list)
    mids: list[int] = field(default_factory=list)
    above: bool | None = None

    def __post_init__(self):
        self.start_cash = self.equity = self.peak = self.cash


def engine_step(s: Engine, row) -> list[tuple]:
    """One market event (ts_us, px_raw as mid and as the price of any size): funding, arrivals, strategy, mark."""
    now, mid = int(row.ts_us), int(row.px_raw)
    if s.funding_us:
        if s.next_funding is None:
            s.next_funding = now + s.funding_us
        while now >= s.next_funding:
            paid = cut(cut(mid * s.pos, SCALE) * s.funding_ppm, fixed.PPM)
            s.cash -= paid
            s.funding += paid
            s.next_funding += s.funding_us
    due = [o for o in s.pending if o[0] <= now]
    s.pending = [o for o in s.pending if o[0] > now]
    for _, signed in due:
        value = cut(mid * abs(signed), SCALE)
        charge = cut(value * s.taker_ppm, fixed.PPM)
        s.cash -= (value if signed > 0 else -value) + charge
        s.pos += signed
        s.fees += charge
        s.volume += value
        s.fills += 1
    s.mids.append(mid)
    if len(s.mids) > s.slow:
        s.mids.pop(0)
    if len(s.mids) == s.slow:
        above = sum(s.mids[-s.fast :]) * s.slow > sum(s.mids) * s.fast
        if above != s.above:
            s.above = above
            delta = (s.qty if above else -s.qty) - s.pos
            if delta:
                s.pending.append((now + s.latency_us, delta))
    s.equity = s.cash + cut(mid * s.pos, SCALE)
    s.peak = max(s.peak, s.equity)
    s.max_dd = max(s.max_dd, s.peak - s.equity)
    return []


def backtest(events: DataFrame, keys: list[str], order: list[str], **params) -> DataFrame:
    """(keys, fills, volume_raw, fees_raw, funding_raw, expired_raw, position_raw, equity_raw, pnl_raw, max_dd_raw) of each instrument."""

    def finish(s: Engine) -> list[tuple]:
        return [(s.fills, s.volume, s.fees, s.funding, sum(abs(q) for _, q in s.pending), s.pos, s.equity, s.equity - s.start_cash, s.max_dd)]

    schema = "fills long, volume_raw long, fees_raw long, funding_raw long, expired_raw long, position_raw long, equity_raw long, pnl_raw long, max_dd_raw long"
    return ordered_fold(events, keys, order, lambda: Engine(**params), engine_step, schema, finish)
