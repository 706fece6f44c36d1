"""Venue messages: envelopes as text, parsed with explicit schemas; what can't be read is kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import fixed

_LEVEL = "array<struct<px:string,sz:string,n:int>>"
#: Fields that aren't named here are ignored.
ENVELOPE = f"channel string, data struct<coin:string,time:long,levels:array<{_LEVEL}>>, trades array<struct<coin:string,side:string,px:string,sz:string,time:long,tid:long>>"


def ws_messages(ticks: DataFrame) -> DataFrame:
    """(seq, text): an envelope for each tick; every kind of message and of fault occurs."""
    px, qty = fixed.format_raw(F.col("px_raw")), fixed.format_raw(F.col("qty_raw"))
    ms = F.expr("exch_us div 1000")
    code = F.when(F.col("side") == "Buy", "B").otherwise("A")
    trade = lambda p: F.struct(F.lit("trades").alias("channel"), F.array(F.struct(F.col("instrument").alias("coin"), code.alias("side"), p.alias("px"), qty.alias("sz"), ms.alias("time"), F.col("tid").alias("tid"), F.lit("x").alias("users"))).alias("trades"))
    level = lambda p: F.array(F.struct(p.alias("px"), qty.alias("sz"), F.lit(1).alias("n")))
    book = F.struct(F.lit("l2Book").alias("channel"), F.struct(F.col("instrument").alias("coin"), ms.alias("time"), F.array(level(px), level(fixed.format_raw(F.col("px_raw") + 100_000_000))).alias("levels")).alias("data"))
    k = F.col("tid") % 8
    text = (
        F.when(k <= 1, F.to_json(trade(px))).when(k == 2, F.to_json(trade(F.concat(px, F.lit("x"))))).when(k == 3, F.to_json(book))
        .when(k == 4, F.lit('{"channel":"subscriptionResponse"}')).when(k == 5, F.lit('{"channel":"pong"}')).when(k == 6, F.lit('{"channel":"news","data":{}}')).otherwise(F.lit("{not json"))
    )
    return ticks.select(F.col("tid").alias("seq"), text.alias("text"))


def parse(messages: DataFrame) -> DataFrame:
    """(seq, kind, m, error): kind is trades, book, ack, pong, other or bad; error says what couldn't be read."""
    numbers = lambda m, c: F.transform(m["trades"], lambda t: fixed.parse(t[c]))
    read = F.transform(F.array(F.from_json("text", ENVELOPE, {"mode": "PERMISSIVE"})), lambda m: F.struct(m.alias("m"), numbers(m, "px").alias("px"), numbers(m, "sz").alias("sz")))
    # A message is read once: filters of what was read can't be moved before a generated row, where they would read it again.
    rows = messages.select("seq", F.explode(read).alias("x")).select("seq", "x.m", "x.px", "x.sz")
    channel = F.col("m.channel")
    kind = (
        F.when(channel.isNull(), "bad").when(channel == "trades", "trades").when(channel == "l2Book", "book")
        .when(channel == "subscriptionResponse", "ack").when(channel == "pong", "pong").otherwise("other")
    )
    faulty = lambda c: F.exists(c, lambda x: x["error"].isNotNull())
    bad_trade = faulty("px") | faulty("sz") | F.exists("m.trades", lambda t: fixed.side_of_code(t["side"]).isNull())
    error = F.when(kind == "bad", "malformed").when((kind == "trades") & F.coalesce(bad_trade, F.lit(True)), "malformed")
    return rows.withColumn("kind", kind).withColumn("error", error)


def trades(parsed: DataFrame) -> DataFrame:
    """(seq, instrument, tid, px_raw, qty_raw, side, exch_ns) of all trades that could be read."""
    rows = parsed.where("kind = 'trades' AND error IS NULL").select("seq", F.explode(F.arrays_zip(F.col("m.trades").alias("t"), F.col("px").alias("px"), F.col("sz").alias("sz"))).alias("x"))
    return rows.select("seq", F.col("x.t.coin").alias("instrument"), F.col("x.t.tid").alias("tid"), F.col("x.px.raw").alias("px_raw"), F.col("x.sz.raw").alias("qty_raw"), fixed.side_of_code(F.col("x.t.side")).alias("side"), (F.col("x.t.time") * 1_000_000).alias("exch_ns"))


def books(parsed: DataFrame) -> DataFrame:
    """(seq, instrument, exch_ns, bids, asks) of all book messages."""
    ladder = lambda i: F.transform(F.col("m.data.levels")[i], lambda x, p: F.struct(p.alias("pos"), fixed.parse(x["px"])["raw"].alias("px_raw"), fixed.parse(x["sz"])["raw"].alias("qty_raw"), x["n"].alias("n_orders")))
    return parsed.where("kind = 'book' AND error IS NULL").select("seq", F.col("m.data.coin").alias("instrument"), (F.col("m.data.time") * 1_000_000).alias("exch_ns"), ladder(0).alias("bids"), ladder(1).alias("asks"))


def subscription(channel: Column, coin: Column) -> Column:
    """The message that asks for a channel of an instrument."""
    return F.to_json(F.struct(F.lit("subscribe").alias("method"), F.struct(channel.alias("type"), coin.alias("coin")).alias("subscription")))


def wire_orders(requests: DataFrame) -> DataFrame:
    """Requests with ``action``, the order message: every third rests, others take at once. Nothing is ever sent."""
    terms = F.when(F.col("cloid") % 3 == 0, "Gtc").otherwise("Ioc")
    body = F.struct(F.lit("order").alias("type"), (F.col("side") == "Buy").alias("b"), fixed.format_raw(F.col("px_raw")).alias("p"), fixed.format_raw(F.col("qty_raw")).alias("s"), terms.alias("t"))
    return requests.withColumn("action", F.to_json(body))
