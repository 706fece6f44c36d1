"""Queries of parsing, fixed-point arithmetic, ids and messages (P and S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import fixed
from tidewake.sources import adapters as A
from tidewake.sources.adapters import with_tables
from tidewake.sources.messages import books, parse, subscription, trades, wire_orders, ws_messages


def p01_parse_decimal(spark, sf_dir):
    k = F.col("event_id") % 9
    text = (
        F.when(k == 0, F.concat(F.lit(" "), F.col("value").cast("decimal(20,4)").cast("string")))
        .when(k == 1, F.concat(F.lit("-."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")))
        .when(k == 2, F.lit("")).when(k == 3, F.lit("1.2.3")).when(k == 4, F.lit("0.123456789")).when(k == 5, F.lit("99999999999999999999"))
        .when(k == 6, F.concat(F.lit("+"), F.col("event_id").cast("string"))).when(k == 7, F.lit("12a")).otherwise(F.lit("5."))
    )
    rows = A.table(spark, sf_dir, "events").select("event_id", text.alias("t")).withColumn("p", fixed.parse(F.col("t")))
    return rows.select("event_id", "t", F.coalesce("p.raw", F.lit(0)).alias("raw"), F.col("p.error").alias("error"))


P01 = """SELECT event_id, t,
  CASE WHEN k = 0 THEN CAST(t::DECIMAL(20,4) * 100000000 AS BIGINT) WHEN k = 1 THEN -(event_id % 1000) * 100000 WHEN k = 6 THEN event_id * 100000000 WHEN k = 8 THEN 500000000 ELSE 0 END AS raw,
  CASE k WHEN 2 THEN 'empty' WHEN 3 THEN 'malformed' WHEN 7 THEN 'malformed' WHEN 4 THEN 'digits' WHEN 5 THEN 'overflow' END AS error
FROM (SELECT event_id, event_id % 9 AS k, CASE event_id % 9 WHEN 0 THEN ' ' || CAST(value::DECIMAL(20,4) AS VARCHAR) WHEN 1 THEN '-.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0')
  WHEN 2 THEN '' WHEN 3 THEN '1.2.3' WHEN 4 THEN '0.123456789' WHEN 5 THEN '99999999999999999999' WHEN 6 THEN '+' || CAST(event_id AS VARCHAR) WHEN 7 THEN '12a' ELSE '5.' END AS t FROM events)"""


def p02_format_raw(spark, sf_dir):
    raw = F.col("px_raw") * F.when(F.col("tid") % 2 == 0, 1).otherwise(-1) + F.col("tid") % 3 * 7
    return A.ticks(spark, sf_dir).select("tid", fixed.format_raw(raw).alias("text"))


P02 = with_tables("ticks", """SELECT tid, CASE WHEN r < 0 THEN '-' ELSE '' END || CAST(abs(r) // 100000000 AS VARCHAR) ||
  CASE WHEN abs(r) % 100000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(r) % 100000000 AS VARCHAR), 8, '0'), '0') END AS text
FROM (SELECT tid, px_raw * CASE WHEN tid % 2 = 0 THEN 1 ELSE -1 END + tid % 3 * 7 AS r FROM ticks)""")


def p03_raw_double(spark, sf_dir):
    x = fixed.to_double(F.col("px_raw"))
    return A.ticks(spark, sf_dir).select("tid", x.alias("x"), fixed.from_double(x).alias("back"))


P03 = with_tables("ticks", "SELECT tid, px_raw / 100000000.0::DOUBLE AS x, px_raw AS back FROM ticks")


def p04_fixed_sums(spark, sf_dir):
    t = A.ticks(spark, sf_dir)
    return t.select("tid", (F.col("px_raw") + F.col("qty_raw")).alias("added"), (F.col("px_raw") - F.col("qty_raw")).alias("less"), (-F.col("px_raw")).alias("negated"), F.abs(F.col("qty_raw") - F.col("px_raw")).alias("size"), (F.col("px_raw") == 0).alias("is_zero"))


P04 = with_tables("ticks", "SELECT tid, px_raw + qty_raw AS added, px_raw - qty_raw AS less, -px_raw AS negated, abs(qty_raw - px_raw) AS size, px_raw = 0 AS is_zero FROM ticks")


def p05_notional(spark, sf_dir):
    return A.exec_reports(spark, sf_dir).select("cloid", "seq", fixed.notional(F.col("px_raw") + F.col("seq"), F.col("qty_raw")).alias("notional_raw"))


P05 = with_tables("exec_reports", "SELECT cloid, seq, CAST((px_raw + seq)::HUGEINT * qty_raw // 100000000 AS BIGINT) AS notional_raw FROM exec_reports")


def p06_mid(spark, sf_dir):
    return A.ticks(spark, sf_dir).select("tid", fixed.mid(F.col("px_raw"), F.col("px_raw") + F.col("tid")).alias("mid_raw"))


P06 = with_tables("ticks", "SELECT tid, (px_raw + px_raw + tid) // 2 AS mid_raw FROM ticks")


def p07_fee(spark, sf_dir):
    return A.ticks(spark, sf_dir).select("tid", fixed.fee(F.col("qty_raw") - F.col("px_raw"), 450).alias("taker_raw"), fixed.fee(F.col("qty_raw") - F.col("px_raw"), 150).alias("maker_raw"))


P07 = with_tables("ticks", "SELECT tid, abs(qty_raw - px_raw) * 450 // 1000000 AS taker_raw, abs(qty_raw - px_raw) * 150 // 1000000 AS maker_raw FROM ticks")


def p08_signed_rate(spark, sf_dir):
    return A.ticks(spark, sf_dir).select("tid", fixed.signed_rate(F.col("qty_raw") - F.col("px_raw") - 1, F.lit(100)).alias("paid_raw"))


P08 = with_tables("ticks", "SELECT tid, sign(d) * (abs(d) * 100 // 1000000) AS paid_raw FROM (SELECT tid, qty_raw - px_raw - 1 AS d FROM ticks)").replace("sign(d) * (", "CAST(sign(d) AS BIGINT) * (")


def p09_sides(spark, sf_dir):
    code = F.when(F.col("tid") % 3 == 0, "B").when(F.col("tid") % 3 == 1, "A").otherwise("X")
    return A.ticks(spark, sf_dir).select("tid", fixed.opposite(F.col("side")).alias("opposite"), fixed.sign(F.col("side")).cast("long").alias("sign"), fixed.side_of_code(code).alias("venue_side"))


P09 = with_tables("ticks", """SELECT tid, CASE side WHEN 'Buy' THEN 'Sell' ELSE 'Buy' END AS opposite, CAST(CASE side WHEN 'Buy' THEN 1 ELSE -1 END AS BIGINT) AS sign,
  CASE tid % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Sell' END AS venue_side FROM ticks""")


def p10_time_units(spark, sf_dir):
    ns, recv = F.col("exch_us") * 1000, F.col("recv_us") * 1000
    return A.ticks(spark, sf_dir).select("tid", ns.alias("exch_ns"), F.expr("exch_us div 1000").alias("exch_ms"), (recv - ns).alias("latency_ns"))


P10 = with_tables("ticks", "SELECT tid, exch_us * 1000 AS exch_ns, exch_us // 1000 AS exch_ms, (recv_us - exch_us) * 1000 AS latency_ns FROM ticks")


def p11_event_times(spark, sf_dir):
    t = A.ticks(spark, sf_dir).withColumn("kind", F.element_at(F.array(*map(F.lit, ("trade", "book", "candle"))), (F.col("tid") % 3 + 1).cast("int")))
    close = F.when(F.col("kind") == "candle", F.col("exch_us") + 60_000_000)
    return t.select("tid", "kind", F.coalesce(close, "exch_us").alias("event_us"), "recv_us")


P11 = with_tables("ticks", "SELECT tid, ['trade', 'book', 'candle'][tid % 3 + 1] AS kind, CASE WHEN tid % 3 = 2 THEN exch_us + 60000000 ELSE exch_us END AS event_us, recv_us FROM ticks")


def p12_config_rules(spark, sf_dir):
    """Names of the rules that an engine configuration breaks, one configuration a part."""
    c = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("config"), (F.col("p_size") * 40_000 - 40_000).alias("taker_ppm"), (F.col("p_size") % 7 * 20).alias("fast"), (F.col("p_size") % 11 * 20).alias("slow"), (F.round(F.col("p_retailprice")).cast("long") - 1000).alias("cash"), (F.col("p_size") % 5 - 1).alias("latency_ms"))
    rules = {
        "fees": (F.col("taker_ppm") < 0) | (F.col("taker_ppm") > 100_000),
        "windows": ~((F.col("fast") > 0) & (F.col("fast") < F.col("slow"))),
        "cash": F.col("cash") <= 0,
        "latency": F.col("latency_ms") < 0,
    }
    broken = F.filter(F.array(*(F.when(bad, name) for name, bad in rules.items())), lambda x: x.isNotNull())
    return c.select("config", F.concat_ws(",", broken).alias("broken"), (F.size(broken) == 0).alias("valid"))


P12 = """SELECT config, concat_ws(',', a, b, c, d) AS broken, a IS NULL AND b IS NULL AND c IS NULL AND d IS NULL AS valid FROM (SELECT p_partkey AS config,
  CASE WHEN p_size * 40000 - 40000 NOT BETWEEN 0 AND 100000 THEN 'fees' END AS a, CASE WHEN NOT (p_size % 7 * 20 > 0 AND p_size % 7 < p_size % 11) THEN 'windows' END AS b,
  CASE WHEN round(p_retailprice) - 1000 <= 0 THEN 'cash' END AS c, CASE WHEN p_size % 5 - 1 < 0 THEN 'latency' END AS d FROM part)"""


def p14_dates_iso(spark, sf_dir):
    return A.candle_rows(spark, sf_dir).select("segment", "open_ms", F.date_format("day", "yyyy-MM-dd").alias("date"))


P14 = with_tables("candle_rows", "SELECT segment, open_ms, strftime(day, '%Y-%m-%d') AS date FROM candle_rows")


def p15_first_index(spark, sf_dir):
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("segment").orderBy("day")) - 1
    rows = A.candle_rows(spark, sf_dir).withColumn("idx", idx)
    return rows.where("day >= DATE'1998-01-01'").groupBy("segment").agg(F.min("idx").cast("long").alias("first_idx"))


P15 = with_tables("candle_rows", "SELECT segment, min(idx) AS first_idx FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY day) - 1 AS idx FROM candle_rows) WHERE day >= DATE '1998-01-01' GROUP BY 1")


def p16_client_order_id(spark, sf_dir):
    return A.order_requests(spark, sf_dir).select("cloid", fixed.client_order_id(F.col("customer"), F.col("cloid")).alias("id"))


P16 = with_tables("order_requests", "SELECT cloid, '0x' || lpad(lower(to_hex(customer)), 16, '0') || lpad(lower(to_hex(cloid)), 16, '0') AS id FROM order_requests")


def p17_wire_action(spark, sf_dir):
    return wire_orders(A.order_requests(spark, sf_dir)).select("cloid", "action")


P17 = with_tables("order_requests", """SELECT cloid, '{"type":"order","b":' || CASE side WHEN 'Buy' THEN 'true' ELSE 'false' END || ',"p":"' || CAST(px_raw // 100000000 AS VARCHAR) || '","s":"' ||
  rtrim(rtrim(CAST(qty_raw // 100000000 AS VARCHAR) || '.' || CAST(qty_raw % 100000000 // 10000000 AS VARCHAR), '0'), '.') || '","t":"' || CASE WHEN cloid % 3 = 0 THEN 'Gtc' ELSE 'Ioc' END || '"}' AS action FROM order_requests""")


def p18_sha256(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))


P18 = "SELECT doc_id, sha256(text) AS sha FROM documents"


def p24_vol_target(spark, sf_dir):
    t = A.ticks(spark, sf_dir)
    q = fixed.vol_target_quantity(F.lit(100000.0), fixed.to_double(F.col("px_raw")), (F.col("tid") % 5) / 100, 0.02, 3.0)
    return t.select("tid", F.round(q, 6).alias("qty"))


P24 = with_tables("ticks", "SELECT tid, round(CASE WHEN px_raw > 0 AND tid % 5 > 0 THEN least(100000.0::DOUBLE * 0.02 / (tid % 5 / 100.0::DOUBLE), 300000.0) / (px_raw / 1e8) ELSE 0 END, 6) AS qty FROM ticks")


def p25_kelly(spark, sf_dir):
    edge, variance = (F.col("px_raw") / 1e8 - 50) / 1e4, (F.col("tid") % 4) / 1e4
    return A.ticks(spark, sf_dir).select("tid", F.round(fixed.capped_kelly(edge, variance, 0.25, 3.0), 6).alias("weight"))


P25 = with_tables("ticks", "SELECT tid, round(CASE WHEN tid % 4 > 0 THEN greatest(-3.0, least(3.0, 0.25 * ((px_raw / 1e8 - 50) / 1e4) / (tid % 4 / 1e4))) ELSE 0 END, 6) AS weight FROM ticks")


def p26_risk_limits(spark, sf_dir):
    limits = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), (F.round(F.col("c_acctbal")).cast("long") * 10_000).alias("max_position"), (F.round(F.col("c_acctbal")).cast("long") - 1000).alias("max_notional"), (F.col("c_custkey") % 13 / 10).alias("max_drawdown"))
    fine = (F.col("max_position") > 0) & (F.col("max_notional") > 0) & (F.col("max_drawdown") > 0) & (F.col("max_drawdown") <= 1)
    return limits.select("account", fine.alias("valid"))


P26 = "SELECT c_custkey AS account, CAST(round(c_acctbal) AS BIGINT) > 0 AND CAST(round(c_acctbal) AS BIGINT) > 1000 AND c_custkey % 13 > 0 AND c_custkey % 13 <= 10 AS valid FROM customer"


def s06_parse_messages(spark, sf_dir):
    return parse(ws_messages(A.ticks(spark, sf_dir))).groupBy("kind", "error").agg(F.count("*").alias("n"))


S06 = with_tables("ticks", """SELECT kind, error, count(*) AS n FROM (SELECT CASE tid % 8 WHEN 4 THEN 'ack' WHEN 5 THEN 'pong' WHEN 6 THEN 'other' WHEN 7 THEN 'bad' WHEN 3 THEN 'book' ELSE 'trades' END AS kind,
  CASE tid % 8 WHEN 7 THEN 'malformed' WHEN 2 THEN 'malformed' END AS error FROM ticks) GROUP BY 1, 2""")


def s06_trades(spark, sf_dir):
    return trades(parse(ws_messages(A.ticks(spark, sf_dir)))).select("tid", "px_raw", "qty_raw", "side", "exch_ns")


S06_TRADES = with_tables("ticks", "SELECT tid, px_raw, qty_raw, side, exch_us // 1000 * 1000000 AS exch_ns FROM ticks WHERE tid % 8 IN (0, 1)")


def s06_books(spark, sf_dir):
    return books(parse(ws_messages(A.ticks(spark, sf_dir)))).select("seq", F.size("bids").cast("long").alias("n_bids"), F.col("bids")[0]["px_raw"].alias("bid_raw"), F.col("asks")[0]["px_raw"].alias("ask_raw"))


S06_BOOKS = with_tables("ticks", "SELECT tid AS seq, CAST(1 AS BIGINT) AS n_bids, px_raw AS bid_raw, px_raw + 100000000 AS ask_raw FROM ticks WHERE tid % 8 = 3")


def s07_subscribe(spark, sf_dir):
    coins = A.ticks(spark, sf_dir).select("instrument").distinct()
    return coins.select("instrument", subscription(F.lit("trades"), F.col("instrument")).alias("message"))


S07 = with_tables("ticks", """SELECT DISTINCT instrument, '{"method":"subscribe","subscription":{"type":"trades","coin":"' || instrument || '"}}' AS message FROM ticks""")


def s10_mid_series(spark, sf_dir):
    s = A.snapshots(spark, sf_dir).where((F.size("bids") > 0) & (F.size("asks") > 0))
    m = fixed.mid(F.col("bids")[0]["px_raw"], F.col("asks")[0]["px_raw"])
    return s.select("snap", F.expr("ts div 1000").alias("ms"), fixed.to_double(m).alias("mid"))


S10 = with_tables("l2_levels", """, f AS (SELECT snap, arg_min(px_raw, pos) FILTER (WHERE side = 'bid') AS b, arg_min(px_raw, pos) FILTER (WHERE side = 'ask') AS a FROM l2_levels GROUP BY 1)
SELECT snap, (snap * 1000 - CASE WHEN snap % 7 = 0 THEN 2000 ELSE 0 END) // 1000 AS ms, ((a + b) // 2) / 100000000.0::DOUBLE AS mid FROM f WHERE a IS NOT NULL AND b IS NOT NULL""")


QUERIES = {
    "p01_parse_decimal": (p01_parse_decimal, P01), "p02_format_raw": (p02_format_raw, P02), "p03_raw_double": (p03_raw_double, P03), "p04_fixed_sums": (p04_fixed_sums, P04),
    "p05_notional": (p05_notional, P05), "p06_mid": (p06_mid, P06), "p07_fee": (p07_fee, P07), "p08_signed_rate": (p08_signed_rate, P08), "p09_sides": (p09_sides, P09),
    "p10_time_units": (p10_time_units, P10), "p11_event_times": (p11_event_times, P11), "p12_config_rules": (p12_config_rules, P12), "p14_dates_iso": (p14_dates_iso, P14),
    "p15_first_index": (p15_first_index, P15), "p16_client_order_id": (p16_client_order_id, P16), "p17_wire_action": (p17_wire_action, P17), "p18_sha256": (p18_sha256, P18),
    "p24_vol_target": (p24_vol_target, P24), "p25_kelly": (p25_kelly, P25), "p26_risk_limits": (p26_risk_limits, P26), "s06_parse_messages": (s06_parse_messages, S06),
    "s06_trades": (s06_trades, S06_TRADES), "s06_books": (s06_books, S06_BOOKS), "s07_subscribe": (s07_subscribe, S07), "s10_mid_series": (s10_mid_series, S10),
}
