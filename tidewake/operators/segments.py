"""Positions after each fill without a fold over a key: quantities by running totals, average prices by segments.

The quantity is a sum. Where it comes to nothing or changes its sign, what came
before no longer matters: there an account's path is cut into segments. The average price, which
is cut to whole units at each fill that extends a position, is folded over a
segment alone, and segments are independent; profit is a sum again. A segment longer than
``LONGEST`` rows goes through the ordered fold, whose memory doesn't follow its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import fixed
from tidewake.operators import scan
from tidewake.operators.fold import ordered_fold
from tidewake.sources.adapters import dealt

#: Rows of a segment that are folded as one array.
LONGEST = 1 << 17
#: Rows of an inner array: arrays are copied as they grow.
CHUNK = 64

_LONG = "decimal(38,0)"


def _blended(entry: str, qty: str, px: str, more: str) -> str:
    """The average price after an extension, truncated towards zero."""
    wide = lambda x: f"cast({x} AS DECIMAL(19, 0))"
    return f"({wide(entry)} * {wide(f'abs({qty})')} + {wide(px)} * {wide(f'abs({more})')}) div {wide(f'(abs({qty}) + abs({more}))')}"


def _entries() -> str:
    """SQL of each row's average price before it, over chunks of a segment's rows (seed, signed, px_raw, before)."""
    # A seed is the part of a fill that flipped into this segment: its price starts it.
    after = f"CASE WHEN r.seed THEN r.px_raw WHEN r.before = 0 OR (r.before > 0) = (r.signed > 0) THEN {_blended('s.e', 'r.before', 'r.px_raw', 'r.signed')} ELSE s.e END"
    empty = "named_struct('e', {e}, 'out', cast(array() AS {kind}))"
    inner = f"aggregate(c.rows, {empty.format(e='a.e', kind='ARRAY<BIGINT>')}, (s, r) -> named_struct('e', {after}, 'out', array_append(s.out, s.e)))"
    step = f"transform(array({inner}), x -> named_struct('e', x.e, 'out', array_append(a.out, x.out)))[0]"
    return f"flatten(aggregate(chunks, {empty.format(e='0L', kind='ARRAY<ARRAY<BIGINT>>')}, (a, c) -> {step}).out)"


def _gain(entry: Column) -> Column:
    """What a fill realises against an average price, truncated towards zero."""
    closed = F.when((F.col("before") != 0) & ((F.col("before") > 0) != (F.col("signed") > 0)), F.least(F.abs("before"), F.abs("signed"))).otherwise(F.lit(0).cast("long"))
    return fixed.notional((F.col("px_raw") - entry) * F.signum("before").cast("long"), closed)


def _long_segments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of long segments, row by row in bounded memory."""
    from tidewake.operators.execution import cut

    def step(state, row):
        e = state["e"]
        if row.seed:
            state["e"] = int(row.px_raw)
        elif row.before == 0 or (row.before > 0) == (row.signed > 0):
            state["e"] = cut(e * abs(int(row.before)) + int(row.px_raw) * abs(int(row.signed)), abs(int(row.before)) + abs(int(row.signed)))
        return [] if row.seed else [(int(row.place), int(row.signed), int(row.px_raw), int(row.fee_raw), int(row.before), e)]

    return ordered_fold(rows, [*keys, "segment"], ["place"], lambda: {"e": 0}, step, "place long, signed long, px_raw long, fee_raw long, before long, entry long")


def positions(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, n, qty_raw, entry_raw, realised_raw) after each fill (side, qty_raw, px_raw, fee_raw) of a key, in order."""
    signed = fixed.sign(F.col("side")) * F.col("qty_raw")
    # What makes the fills is done once, not again for each pass over them.
    rows = scan.written(fills.select(*keys, *(c for c in order if c not in keys), signed.alias("signed"), "px_raw", "fee_raw"))
    pieces = scan.longest(rows, keys) > scan.PIECE
    if pieces:
        rows = scan.placed(rows, keys, order, "place").select(*keys, "place", "signed", "px_raw", "fee_raw")
        rows = scan.running(rows, keys, "place", {"before": F.col("signed")})
    else:
        # Every key fits a piece: all that follows stays where its rows are dealt to, and one sort serves the windows.
        w = Window.partitionBy(*keys).orderBy(*order)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        rows = dealt(rows, *keys).select("*", (F.row_number().over(w) - 1).cast("long").alias("place"), F.sum("signed").over(earlier).alias("before"))
    rows = rows.withColumn("before", F.coalesce("before", F.lit(0)))
    after = F.col("before") + F.col("signed")
    flips = (F.col("before") != 0) & (after != 0) & ((F.col("before") > 0) != (after > 0))
    ends = ((after == 0) | flips).cast("long")
    rows = scan.running(rows, keys, "place", {"segment": ends}) if pieces else rows.withColumn("segment", F.sum(ends).over(earlier))
    rows = rows.withColumn("segment", F.coalesce("segment", F.lit(0))).select(*keys, "segment", "place", "signed", "px_raw", "fee_raw", "before")
    if pieces:
        rows = scan.written(rows)
    # A flip's price also starts the segment behind it.
    parts = F.array_compact(F.array(F.struct(F.col("segment"), F.lit(False).alias("seed")), F.when(flips, F.struct((F.col("segment") + 1).alias("segment"), F.lit(True).alias("seed")))))
    seeded = rows.withColumn("_part", F.explode(parts)).select(*keys, "_part.segment", "_part.seed", "place", "signed", "px_raw", "fee_raw", "before")

    sizes = rows.groupBy(*keys, "segment").agg(F.count("*").alias("_n"))
    long_ = sizes.where(F.col("_n") > LONGEST).select(*keys, "segment")
    any_long = (pieces or scan.PIECE > LONGEST) and not long_.isEmpty()
    short = seeded.join(long_, [*keys, "segment"], "left_anti") if any_long else seeded
    # CHUNK rows a group, then LONGEST / CHUNK chunks.
    chunks = short.groupBy(*keys, "segment", F.expr(f"place div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "seed", "signed", "px_raw", "fee_raw", "before"))).alias("rows"))
    whole = chunks.groupBy(*keys, "segment").agg(F.sort_array(F.collect_list(F.struct("chunk", "rows"))).alias("chunks"))
    folded = whole.withColumn("_e", F.expr(_entries())).select(*keys, F.explode(F.arrays_zip(F.flatten("chunks.rows").alias("r"), F.col("_e").alias("entry"))).alias("x"))
    folded = folded.where("NOT x.r.seed").select(*keys, "x.r.place", "x.r.signed", "x.r.px_raw", "x.r.fee_raw", "x.r.before", "x.entry")
    if any_long:
        folded = folded.unionByName(_long_segments(seeded.join(long_, [*keys, "segment"]), keys).drop("segment"))
    if pieces:
        folded = scan.written(folded)

    gain = _gain(F.col("entry")) - F.col("fee_raw")
    done = scan.running(folded.withColumn("gain", gain), keys, "place", {"so_far": F.col("gain")}, pieces=pieces)
    extends = (F.col("before") == 0) | ((F.col("before") > 0) == (F.col("signed") > 0))
    flipped = (after != 0) & ~extends & ((after > 0) == (F.col("signed") > 0))
    entry = F.when(after == 0, F.lit(0)).when(extends, F.expr(_blended("entry", "before", "px_raw", "signed"))).when(flipped, F.col("px_raw")).otherwise(F.col("entry"))
    return done.select(*keys, (F.col("place") + 1).alias("n"), after.alias("qty_raw"), entry.cast("long").alias("entry_raw"), (F.coalesce("so_far", F.lit(0)) + F.col("gain")).alias("realised_raw"))
