"""Market-data relations built from the driver's tables, with the same relations as DuckDB SQL.

Every relation is lazy, but for numbers of rows, which files' footers tell, and keeps its order in explicit
columns; nothing relies on the order of rows. ``SQL`` holds the matching common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Raw units of a fixed-point number.
SCALE = 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts, so that its memory doesn't follow the table.
ROWS_A_TASK = 1 << 18


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The frame dealt by keys to as many tasks as its rows ask for; windows and joins on the keys stay there."""
    tasks = max(-(-df.count() // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.expr(
        f"extract(DAY FROM d_) * 86400000000L + extract(HOUR FROM d_) * 3600000000L + extract(MINUTE FROM d_) * 60000000L"
        f" + cast(extract(SECOND FROM d_) * 1000000 AS BIGINT)".replace("d_", f"({ts} - TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    ).cast("long")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: (instrument, tid, exch_us, recv_us, px_raw, qty_raw, side, k) from events."""
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"),
        F.col("event_id").alias("tid"),
        micros("ts").alias("exch_us"),
        (micros("ts") + F.col("event_id") % 1000 * 1000).alias("recv_us"),
        (F.round(F.col("value") * 100).cast("long") * 1_000_000).alias("px_raw"),
        ((k + 1) * 1_000_000).alias("qty_raw"),
        F.when(F.col("event_id") % 2 == 0, "Buy").otherwise("Sell").alias("side"),
        F.col("user_id").alias("user_id"),
    )


def daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, close) of all orders: integer cents a day, as a long price series."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(cents).alias("cents")).select("day", (F.col("cents") / 100.0).alias("close"))


def candle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, day, open_ms, open, high, low, close, volume) candles a market segment and day, in order of order key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return orders.groupBy(F.col("o_orderpriority").alias("segment"), "day").agg(
        (F.unix_date("day").cast("long") * 86400000).alias("open_ms"),
        F.min_by("cents", "o_orderkey").alias("open"),
        F.max("cents").alias("high"),
        F.min("cents").alias("low"),
        F.max_by("cents", "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time_us, rate) of funding events."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(micros("ts").alias("time_us"), ((F.round(F.col("value") * 100).cast("long") - 5000) / 1e8).alias("rate"))


def l2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snap, pos, side, px_raw, qty_raw, n_orders): one ladder level a row, in raw arrival order ``pos``."""
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    return lines.select(
        F.col("l_orderkey").alias("snap"),
        F.row_number().over(order).cast("long").alias("pos"),
        F.when(F.col("l_linenumber") % 2 == 1, "bid").otherwise("ask").alias("side"),
        (F.round(F.col("l_extendedprice") / 100).cast("long") * SCALE).alias("px_raw"),
        # every tenth level is empty, so that repairs have something to drop
        F.when(F.col("l_partkey") % 10 == 0, F.lit(0)).otherwise((F.col("l_quantity") * SCALE).cast("long")).cast("long").alias("qty_raw"),
        F.col("l_linenumber").cast("long").alias("n_orders"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snap, ts, bids, asks): raw ladders as arrays of levels."""
    level = F.struct("pos", "px_raw", "qty_raw", "n_orders")
    ladder = lambda side: F.array_sort(F.filter(F.collect_list(F.when(F.col("side") == side, level)), lambda x: x.isNotNull()))
    return l2_levels(spark, sf_dir).groupBy("snap").agg(ladder("bid").alias("bids"), ladder("ask").alias("asks")).withColumn("ts", F.col("snap") * 1000 - F.when(F.col("snap") % 7 == 0, 2000).otherwise(0))


def exec_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cloid, fill_id, seq, qty_raw, px_raw, fee_raw): fills with repeated ids."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    px = F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long") * SCALE
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("cloid"),
        F.col("l_linenumber").cast("long").alias("fill_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        (F.col("l_quantity") * 1_000_000).cast("long").alias("qty_raw"),
        px.alias("px_raw"),
        (F.round(F.col("l_tax") * 100).cast("long") * 10_000).alias("fee_raw"),
        F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy").alias("side"),
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cloid, customer, ts_us, side, qty_raw, px_raw): orders as requests."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cloid"),
        F.col("o_custkey").alias("customer"),
        micros("o_orderdate").alias("ts_us"),
        F.when(F.col("o_orderkey") % 2 == 0, "Buy").otherwise("Sell").alias("side"),
        ((F.col("o_orderkey") % 50 + 1) * 10_000_000).alias("qty_raw"),
        (F.round(F.col("o_totalprice")).cast("long") * SCALE).alias("px_raw"),
    )


def equity_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, seq, equity): running signed balances of each customer, in cents, from 1,000,000.00."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    signed = F.when(F.col("o_orderkey") % 2 == 0, cents).otherwise(-cents)
    path = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("account"), F.row_number().over(path).cast("long").alias("seq"), (F.lit(100_000_000).cast("long") + F.sum(signed).over(path)).alias("equity")
    )


def trial_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, cfg, r): mean value of an hour and configuration less 50, in per mille; gaps are 0. t counts hours from 0."""
    events = table(spark, sf_dir, "events").select((F.expr("cast(0 AS BIGINT)") + F.floor(micros("ts") / 3_600_000_000)).alias("hour"), (F.col("user_id") % 8).alias("cfg"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    means = events.groupBy("hour", "cfg").agg((F.sum("cents") / F.count("*") / 100 - 50).alias("m"))
    hours = events.select("hour").distinct()
    first = hours.agg(F.min("hour").alias("h0"))
    grid = hours.crossJoin(F.broadcast(first)).select("hour", (F.col("hour") - F.col("h0")).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("cfg"))
    return grid.join(means, ["hour", "cfg"], "left").select("t", F.col("cfg").cast("long").alias("cfg"), F.round(F.coalesce("m", F.lit(0.0)) / 1000, 9).alias("r"))


#: Common table expressions of the relations above, for DuckDB.
SQL = {
    "ticks": """ticks AS (SELECT event_type AS instrument, event_id AS tid, epoch_us(ts) AS exch_us, epoch_us(ts) + event_id % 1000 * 1000 AS recv_us,
      CAST(round(value * 100) AS BIGINT) * 1000000 AS px_raw, (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) + 1) * 1000000 AS qty_raw,
      CASE WHEN event_id % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side, user_id FROM events)""",
    "daily_close": """daily_close AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS close
      FROM orders GROUP BY 1)""",
    "candle_rows": """candle_rows AS (SELECT o_orderpriority AS segment, CAST(o_orderdate AS DATE) AS day, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000 AS open_ms,
      arg_min(cents, o_orderkey) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, o_orderkey) AS close, count(*) AS volume
      FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY 1, 2, 3)""",
    "funding": """funding AS (SELECT epoch_us(ts) AS time_us, (CAST(round(value * 100) AS BIGINT) - 5000) / 1e8::DOUBLE AS rate FROM events WHERE event_type = 'error')""",
    "l2_levels": """l2_levels AS (SELECT l_orderkey AS snap,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pos,
      CASE WHEN l_linenumber % 2 = 1 THEN 'bid' ELSE 'ask' END AS side, CAST(round(l_extendedprice / 100) AS BIGINT) * 100000000 AS px_raw,
      CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE CAST(l_quantity * 100000000 AS BIGINT) END AS qty_raw, CAST(l_linenumber AS BIGINT) AS n_orders FROM lineitem)""",
    "exec_reports": """exec_reports AS (SELECT l_orderkey AS cloid, CAST(l_linenumber AS BIGINT) AS fill_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS seq,
      CAST(l_quantity * 1000000 AS BIGINT) AS qty_raw, CAST(round(l_extendedprice / l_quantity) AS BIGINT) * 100000000 AS px_raw,
      CAST(round(l_tax * 100) AS BIGINT) * 10000 AS fee_raw, CASE WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS side FROM lineitem)""",
    "order_requests": """order_requests AS (SELECT o_orderkey AS cloid, o_custkey AS customer, epoch_us(o_orderdate) AS ts_us,
      CASE WHEN o_orderkey % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side, (o_orderkey % 50 + 1) * 10000000 AS qty_raw,
      CAST(round(o_totalprice) AS BIGINT) * 100000000 AS px_raw FROM orders)""",
    "equity_path": """equity_path AS (SELECT o_custkey AS account, row_number() OVER w AS seq,
      CAST(100000000 + sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS equity
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""",
    "trial_panel": """trial_panel AS (
      WITH e AS (SELECT epoch_us(ts) // 3600000000 AS hour, user_id % 8 AS cfg, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
      m AS (SELECT hour, cfg, CAST(sum(cents) AS DOUBLE) / count(*) / 100 - 50 AS m FROM e GROUP BY 1, 2),
      h AS (SELECT DISTINCT hour FROM e), g AS (SELECT hour, hour - (SELECT min(hour) FROM h) AS t, unnest(range(8)) AS cfg FROM h)
      SELECT t, CAST(g.cfg AS BIGINT) AS cfg, round(coalesce(m.m, 0) / 1000, 9) AS r FROM g LEFT JOIN m ON g.hour = m.hour AND g.cfg = m.cfg)""",
}


def with_tables(names: str, query: str) -> str:
    """A DuckDB query over some of the relations."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + (",\n" if query.lstrip().startswith(",") else "\n") + query.lstrip().removeprefix(",")
