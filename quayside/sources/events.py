"""Market events out of the generic event table, and the wire envelope.

Trades, quotes, force orders and funding points are projections of one scan;
column pruning and filters reach Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["symbol", "market"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol() -> Column:
    return F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string"))


def _market() -> Column:
    return F.when(F.col("event_id") % 2 == 0, "futures").otherwise("spot")


def _units() -> Column:
    return F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)) + 1


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_id, symbol, market, ts, price, qty, side); side +1 buys."""
    side = F.when(F.col("event_type").isin("purchase", "signup", "click"), 1).otherwise(-1)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("trade_id"), _symbol().alias("symbol"), _market().alias("market"), "ts", F.col("value").alias("price"), _units().alias("qty"), side.alias("side"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bid and offer updates: (update_id, symbol, market, ts, bid, bid_qty, ask, ask_qty)."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    units = _units()
    return e.select(F.col("event_id").alias("update_id"), _symbol().alias("symbol"), _market().alias("market"), "ts", F.col("value").alias("bid"), units.alias("bid_qty"), F.round(F.col("value") + F.lit(0.01) * (1 + F.col("event_id") % 7), 2).alias("ask"), (1 + F.col("user_id") % 50).cast("double").alias("ask_qty"))


def force_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidations: a forced buy closes a short."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    liq = F.when(F.col("user_id") % 2 == 0, "short_liq").otherwise("long_liq")
    return e.select(F.col("event_id").alias("order_id"), _symbol().alias("symbol"), _market().alias("market"), "ts", F.col("value").alias("price"), _units().alias("qty"), liq.alias("liq_side"), (F.col("value") * _units()).alias("notional"))


def funding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0))
    rate = F.round((F.col("value") - 250) / 100000, 3)
    return e.select(F.col("event_id").alias("point_id"), _symbol().alias("symbol"), "ts", rate.alias("funding_rate"), F.col("value").alias("mark_price"))


# -- wire envelope ---------------------------------------------------------

# fixed field lists of the eight message types; numbers travel as strings
DATA_FIELDS = {
    "md.trade": {"ts_recv": "string", "agg_trade_id": "bigint", "exchange_trade_id": "bigint", "first_trade_id": "bigint", "last_trade_id": "bigint", "price": "string", "qty_raw": "string", "qty_base": "string", "qty_eth": "string", "notional_usdt": "string", "is_buyer_maker": "boolean", "aggressor_side": "int"},
    "md.depth": {"first_update_id": "bigint", "final_update_id": "bigint", "prev_final_update_id": "bigint", "bids_delta": "array<array<string>>", "asks_delta": "array<array<string>>", "event_count": "bigint"},
    "md.bbo": {"update_id": "bigint", "bid_price": "string", "bid_qty": "string", "ask_price": "string", "ask_qty": "string"},
    "md.kline": {"interval_code": "string", "open_time": "string", "close_time": "string", "open_price": "string", "high_price": "string", "low_price": "string", "close_price": "string", "volume_base": "string", "quote_volume": "string", "trade_count": "bigint", "is_closed": "boolean"},
    "md.mark_price": {"mark_price": "string", "index_price": "string", "estimated_settle_price": "string", "funding_rate": "string", "next_funding_time": "string"},
    "md.funding_rate": {"funding_time": "string", "funding_rate": "string", "mark_price": "string", "next_funding_time": "string"},
    "md.force_order": {"order_side": "string", "original_qty": "string", "price": "string", "average_price": "string", "filled_qty": "string", "trade_time": "string", "notional_usdt": "string", "liq_side": "string"},
    "md.orderbook_snapshot_l2": {"ts_snapshot": "string", "depth_levels": "bigint", "last_update_id": "bigint", "bids": "array<array<string>>", "asks": "array<array<string>>", "checksum": "string"},
}
ENVELOPE = "schema_version bigint, msg_type string, message_id string, routing_key string, market string, symbol string, source_kind string, backfill_in_progress boolean, event_ts string, data string"


def decode(lines: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns and `fault`: null, or why the message goes to the
    quarantine (unreadable, schema_version, msg_type, market, event_ts)."""
    e = F.from_json(F.col(value), ENVELOPE, {"mode": "PERMISSIVE"})
    read = lines.withColumn("e", e).select(value, "e.*").withColumn("event_time", F.try_to_timestamp("event_ts"))
    fault = (
        F.when(F.col("msg_type").isNull(), "unreadable")
        .when(~F.col("schema_version").eqNullSafe(1), "schema_version")
        .when(~F.col("msg_type").isin(*DATA_FIELDS), "msg_type")
        .when(~F.coalesce(F.col("market").isin("spot", "futures"), F.lit(False)), "market")
        .when(F.col("event_time").isNull(), "event_ts")
    )
    return read.withColumn("fault", fault)


def typed(decoded: DataFrame, msg_type: str) -> DataFrame:
    """The sound messages of one type, with its own columns."""
    schema = ", ".join(f"{k} {v}" for k, v in DATA_FIELDS[msg_type].items())
    own = decoded.where(F.col("fault").isNull() & (F.col("msg_type") == msg_type))
    return own.withColumn("d", F.from_json("data", schema)).select("market", "symbol", "event_time", "backfill_in_progress", "d.*")


def wire_trades(decoded: DataFrame) -> DataFrame:
    """Quantity under any of its names, notional derived if absent, side from
    the maker flag if absent, else +1."""
    t = typed(decoded, "md.trade")
    number = lambda c: F.col(c).try_cast("double")
    qty = F.coalesce(*[number(c) for c in ("qty_base", "qty_eth", "qty_raw")])
    side = F.coalesce(F.col("aggressor_side"), F.when(F.col("is_buyer_maker"), -1).when(~F.col("is_buyer_maker"), 1), F.lit(1))
    return t.select(F.col("agg_trade_id").alias("trade_id"), "symbol", "market", F.col("event_time").alias("ts"), number("price").alias("price"), qty.alias("qty"), F.coalesce(number("notional_usdt"), number("price") * qty).alias("notional"), side.alias("side"))


def wire_force_orders(decoded: DataFrame) -> DataFrame:
    """BUY closes shorts, SELL closes longs; average over limit price, filled
    over original quantity."""
    t = typed(decoded, "md.force_order")
    number = lambda c: F.col(c).try_cast("double")
    price, qty = F.coalesce(number("average_price"), number("price")), F.coalesce(number("filled_qty"), number("original_qty"))
    liq = F.coalesce(F.col("liq_side"), F.when(F.upper("order_side") == "BUY", "short_liq").when(F.upper("order_side") == "SELL", "long_liq"))
    return t.select("symbol", "market", F.col("event_time").alias("ts"), price.alias("price"), qty.alias("qty"), liq.alias("liq_side"), F.coalesce(number("notional_usdt"), price * qty).alias("notional"))
