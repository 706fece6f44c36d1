"""Fixed-point arithmetic on raw longs (1e8 units), as Column expressions.

Products are formed as decimals, which hold any product of two longs; a result
that is no long is an error, as Spark's ANSI casts make it. Divisions truncate
towards zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100_000_000
PPM = 1_000_000
#: Decimal digits behind the point.
DIGITS = 8


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _quotient(product: Column, by: int) -> Column:
    """A decimal over a positive number, truncated towards zero, as a long."""
    # Decimal division would round its last digit, so the remainder is taken off first.
    return ((product - product % F.lit(by).cast("decimal(19,0)")) / F.lit(by).cast("decimal(19,0)")).cast("decimal(38,0)").cast("long")


def parse(text: Column) -> Column:
    """Struct (raw, error) of a decimal text: error is null, 'empty', 'digits', 'malformed' or 'overflow'.

    A text in order costs one match and one cast; what is wrong is only asked of the others.
    """
    t = F.trim(text)
    fine = t.rlike(rf"^[+-]?([0-9]+\.?[0-9]{{0,{DIGITS}}}|\.[0-9]{{1,{DIGITS}}})$")
    value = t.try_cast(f"decimal(38,{DIGITS})")
    fits = F.coalesce(F.abs(value) <= F.lit("92233720368.54775807").cast(f"decimal(38,{DIGITS})"), F.lit(False))
    error = (
        F.when(fine, F.when(~fits, "overflow"))
        .when(t.isNull() | t.isin("", "+", "-", "."), "empty")
        .when(~t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), "malformed")
        .otherwise("digits")
    )
    raw = F.when(fine & fits, (value.cast(f"decimal(19,{DIGITS})") * SCALE).cast("long"))
    return F.struct(raw.alias("raw"), error.alias("error"))


def format_raw(raw: Column) -> Column:
    """The shortest decimal text of a raw number."""
    size = F.abs(raw.cast("decimal(20,0)")).cast("string")
    padded = F.lpad(size, F.greatest(F.length(size), F.lit(DIGITS + 1)), F.lit("0"))
    whole = F.substring(padded, F.lit(1), F.length(padded) - DIGITS)
    part = F.regexp_replace(F.right(padded, F.lit(DIGITS)), "0+$", "")
    return F.concat(F.when(raw < 0, "-").otherwise(""), whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def to_double(raw: Column) -> Column:
    """A raw number as a double."""
    return raw / float(SCALE)


def from_double(x: Column) -> Column:
    """The nearest raw number, halves away from zero."""
    return F.round(x * float(SCALE)).cast("long")


def notional(px: Column, qty: Column) -> Column:
    """Price times quantity, truncated."""
    return _quotient(_wide(px) * _wide(qty), SCALE)


def mid(bid: Column, ask: Column) -> Column:
    """Half of bid and ask, truncated."""
    return _quotient(bid.cast("decimal(38,0)") + ask.cast("decimal(38,0)"), 2)


def fee(amount: Column, ppm: int) -> Column:
    """Parts per million of an amount's size."""
    return _quotient(_wide(F.abs(amount)) * F.lit(ppm), PPM)


def signed_rate(amount: Column, ppm: Column) -> Column:
    """Parts per million of an amount, sign kept."""
    return _quotient(_wide(amount) * _wide(ppm), PPM)


def sign(side: Column) -> Column:
    """1 for Buy, -1 for Sell, else null."""
    return F.when(side == "Buy", 1).when(side == "Sell", -1)


def opposite(side: Column) -> Column:
    """The other side."""
    return F.when(side == "Buy", "Sell").when(side == "Sell", "Buy")


def side_of_code(code: Column) -> Column:
    """Buy for B, Sell for A, else null."""
    return F.when(code == "B", "Buy").when(code == "A", "Sell")


def client_order_id(session: Column, counter: Column) -> Column:
    """0x and 32 hex digits: the session in the upper, the counter in the lower half."""
    half = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(F.lit("0x"), half(session), half(counter))


def vol_target_quantity(equity: Column, price: Column, realised: Column, target: float, leverage: float) -> Column:
    """Quantity that brings volatility to the target, capped by leverage; 0 where an input is degenerate."""
    fine = (equity > 0) & (price > 0) & (realised > 0) & ~F.isnan(realised)
    return F.when(fine, F.least(equity * target / realised, equity * leverage) / price).otherwise(0.0)


def capped_kelly(edge: Column, variance: Column, fraction: float, cap: float) -> Column:
    """fraction * edge / variance within [-cap, cap]; 0 where an input is degenerate."""
    fine = edge.isNotNull() & (variance > 0)
    return F.when(fine, F.greatest(F.lit(-cap), F.least(F.lit(cap), fraction * edge / variance))).otherwise(0.0)
