"""Replay, repair, ranking and label queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import stats
from quayside.operators import depth
from quayside.operators import indicators as ind
from quayside.operators import joins
from quayside.operators import minute as mn
from quayside.operators import reduce as red
from quayside.plans.market import BASE, FUND, HISTORY, LIQ, MINUTES, ORACLES, QUERIES, QUOTES, R, T, bar_sql, history_of, minutes_of, query, told
from quayside.sources import events as src
from quayside.sources.events import KEY, table

REPLAY = f"""{BASE}, {QUOTES}, {LIQ}, {FUND}, replay AS (SELECT 'md.trade' AS msg_type, market, symbol, ts, trade_id AS row_id FROM trades UNION ALL SELECT 'md.bbo', market, symbol, ts, update_id FROM quotes UNION ALL SELECT 'md.force_order', market, symbol, ts, order_id FROM orders_ UNION ALL SELECT 'md.funding_rate', 'futures', symbol, ts, point_id FROM points)"""


def replay_rows(spark, sf_dir) -> DataFrame:
    """All message types in one stream; only keys are read, payloads are
    joined late."""
    parts = [
        src.trades(spark, sf_dir).select(F.lit("md.trade").alias("msg_type"), "market", "symbol", "ts", F.col("trade_id").alias("row_id")),
        src.quotes(spark, sf_dir).select(F.lit("md.bbo").alias("msg_type"), "market", "symbol", "ts", F.col("update_id").alias("row_id")),
        src.force_orders(spark, sf_dir).select(F.lit("md.force_order").alias("msg_type"), "market", "symbol", "ts", F.col("order_id").alias("row_id")),
        src.funding_points(spark, sf_dir).select(F.lit("md.funding_rate").alias("msg_type"), F.lit("futures").alias("market"), "symbol", "ts", F.col("point_id").alias("row_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {REPLAY} SELECT msg_type, market, symbol, {T.format('ts')} AS ts, row_id FROM replay")
def replay_union(spark, sf_dir):
    return told(replay_rows(spark, sf_dir))


@query(f"WITH {REPLAY} SELECT msg_type, market, symbol, {T.format('ts')} AS ts, row_id FROM replay WHERE (ts, msg_type, row_id) > (TIMESTAMP '2024-01-15 00:00:00', 'md.bbo', 0) ORDER BY replay.ts, msg_type, row_id LIMIT 500")
def replay_page(spark, sf_dir):
    """One page after a cursor: a top-k by key, not an offset."""
    after = F.struct(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit("md.bbo").alias("msg_type"), F.lit(0).cast("long").alias("row_id"))
    page = replay_rows(spark, sf_dir).where(F.struct("ts", "msg_type", "row_id") > after).orderBy("ts", "msg_type", "row_id").limit(500)
    return told(page)


@query(f"WITH {BASE} SELECT symbol, market, count(*) AS trades, {R('sum(price * qty)')} AS notional, {R('sum(side * qty)')} AS delta FROM trades GROUP BY ALL")
def wire_trades(spark, sf_dir):
    """Trades through the wire: written as envelopes, decoded, typed, summed."""
    t = src.trades(spark, sf_dir)
    data = F.to_json(F.struct(F.col("trade_id").alias("agg_trade_id"), F.col("price").cast("string").alias("price"), F.col("qty").cast("string").alias("qty_raw"), (F.col("side") < 0).alias("is_buyer_maker")))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    lines = t.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("md.trade").alias("msg_type"), "market", "symbol", stamp.alias("event_ts"), data.alias("data"))).alias("value"))
    w = src.wire_trades(src.decode(lines))
    return told(w.groupBy(*KEY).agg(F.count("*").alias("trades"), F.sum("notional").alias("notional"), F.sum(F.col("side") * F.col("qty")).alias("delta")))


@query(f"WITH {MINUTES}, r AS (SELECT symbol, market, minute, minute - row_number() OVER (PARTITION BY symbol, market ORDER BY minute) * INTERVAL 1 MINUTE AS run FROM minutes) SELECT symbol, market, {T.format('min(minute)')} AS first, {T.format('max(minute)')} AS last, count(*) AS rows FROM r GROUP BY symbol, market, run")
def minute_islands(spark, sf_dir):
    return told(red.islands(minutes_of(spark, sf_dir).select(*KEY, "minute"), KEY, "minute", 60).select(*KEY, "first", "last", "rows"))


@query("WITH e AS (SELECT event_type, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS after FROM (SELECT DISTINCT event_type, event_id FROM events)) SELECT event_type, after + 1 AS from_id, event_id - 1 AS to_id FROM e WHERE event_id > after + 1")
def id_gaps(spark, sf_dir):
    return red.id_gaps(table(spark, sf_dir, "events"), ["event_type"], "event_id")


@query("SELECT user_id, event_id, event_type, " + R("value") + " AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return told(joins.latest(rows, ["user_id"], ["ts", "event_id"]).drop("ts"))


@query(
    f"""WITH {HISTORY}, {bar_sql(240)}, s AS (SELECT symbol, market, bar + INTERVAL 240 MINUTE AS start, low AS support, high AS resistance FROM bars WHERE close IS NOT NULL), m AS (SELECT symbol, market, minute, coalesce(high, last_price) AS high, coalesce(low, last_price) AS low, last_price AS close FROM history),
    j AS (SELECT s.symbol, s.market, s.start, s.support, s.resistance, min(CASE WHEN m.high > s.resistance THEN m.minute END) AS up_at, min(CASE WHEN m.low < s.support THEN m.minute END) AS down_at, last(m.close ORDER BY m.minute) AS last_close, count(*) AS bars FROM s JOIN m ON s.symbol = m.symbol AND s.market = m.market AND m.minute >= s.start AND m.minute < s.start + INTERVAL 240 MINUTE GROUP BY ALL)
    SELECT symbol, market, {T.format('start')} AS start, {R('last_close')} AS last_close, bars, CASE WHEN bars < 240 THEN 'incomplete' WHEN up_at IS NULL AND down_at IS NULL THEN 'none' WHEN down_at IS NULL THEN 'up' WHEN up_at IS NULL THEN 'down' WHEN up_at < down_at THEN 'up_then_down' WHEN down_at < up_at THEN 'down_then_up' ELSE 'both' END AS label FROM j"""
)
def forward_labels(spark, sf_dir):
    """What the next four hours do to the range of the last four."""
    return told(_labels(spark, sf_dir).select(*KEY, "start", "last_close", "bars", "label"))


def _labels(spark, sf_dir) -> DataFrame:
    h = history_of(spark, sf_dir)
    starts = mn.bars(h, 240).where("close is not null").select(*KEY, (F.col("bar") + F.expr("interval 240 minutes")).alias("start"), F.col("low").alias("support"), F.col("high").alias("resistance"))
    bars = h.select(*KEY, "minute", F.coalesce("high", "last_price").alias("high"), F.coalesce("low", "last_price").alias("low"), F.col("last_price").alias("close"))
    return joins.forward_labels(starts, bars, KEY, "start", "minute", 240)


@query(f"WITH l AS ({ORACLES['forward_labels']}) SELECT symbol, label, count(*) AS slices, grouping(symbol)::BIGINT AS all_symbols FROM l GROUP BY GROUPING SETS ((symbol, label), (label))")
def label_summary(spark, sf_dir):
    """Labels by symbol and over all, as grouping sets."""
    _labels(spark, sf_dir).createOrReplaceTempView("quayside_labels")
    return spark.sql("SELECT symbol, label, count(*) AS slices, CAST(grouping(symbol) AS BIGINT) AS all_symbols FROM quayside_labels GROUP BY GROUPING SETS ((symbol, label), (label))")


@query(f"WITH {MINUTES}, {QUOTES}, {LIQ} SELECT symbol, {T.format('max(CASE WHEN k = 1 THEN m END)')} AS trade, {T.format('max(CASE WHEN k = 2 THEN m END)')} AS orderbook, {T.format('max(CASE WHEN k = 3 THEN m END)')} AS liq FROM (SELECT symbol, minute AS m, 1 AS k FROM minutes UNION ALL SELECT symbol, date_trunc('minute', ts), 2 FROM quotes UNION ALL SELECT symbol, date_trunc('minute', ts), 3 FROM orders_) GROUP BY symbol")
def frontier(spark, sf_dir):
    """The last minute of every source."""
    parts = {"trade": src.trades, "orderbook": src.quotes, "liq": src.force_orders}
    rows = None
    for k, f in parts.items():
        one = f(spark, sf_dir).select("symbol", F.lit(k).alias("source"), F.col("ts"))
        rows = one if rows is None else rows.unionByName(one)
    last = [F.max(F.when(F.col("source") == k, F.date_trunc("minute", "ts"))).alias(k) for k in parts]
    return told(rows.groupBy("symbol").agg(*last))


@query(
    f"""WITH {BASE}, s AS (SELECT symbol, market, date_trunc('second', ts) AS second, sum(qty) AS qty, sum(price * qty) AS notional, max(price) AS high, min(price) AS low FROM trades GROUP BY ALL)
    SELECT symbol, market, {T.format("date_trunc('minute', second)")} AS minute, count(*) AS chunks, {R('sum(qty)')} AS qty, {R('sum(notional)')} AS notional, {R('max(high)')} AS high, {R('min(low)')} AS low FROM s GROUP BY symbol, market, date_trunc('minute', second)"""
)
def compacted_minutes(spark, sf_dir):
    """One-second chunks merged into canonical minutes."""
    t = src.trades(spark, sf_dir)
    s = t.groupBy(*KEY, F.window("ts", "1 second")["start"].alias("second")).agg(F.sum("qty").alias("qty"), F.sum(F.col("price") * F.col("qty")).alias("notional"), F.max("price").alias("high"), F.min("price").alias("low"))
    return told(s.groupBy(*KEY, mn.minute_of(F.col("second")).alias("minute")).agg(F.count("*").alias("chunks"), F.sum("qty").alias("qty"), F.sum("notional").alias("notional"), F.max("high").alias("high"), F.min("low").alias("low")))


@query("SELECT '' AS symbol, '' AS market, '' AS minute, '' AS kind WHERE false")
def preagg_differences(spark, sf_dir):
    """Direct minutes against minutes by way of seconds: nothing differs."""
    direct = minutes_of(spark, sf_dir).select(*KEY, "minute", (F.col("buy_qty") + F.col("sell_qty")).alias("qty"), "high", "low")
    t = src.trades(spark, sf_dir)
    s = t.groupBy(*KEY, F.window("ts", "1 second")["start"].alias("second")).agg(F.sum("qty").alias("qty"), F.max("price").alias("high"), F.min("price").alias("low"))
    merged = s.groupBy(*KEY, mn.minute_of(F.col("second")).alias("minute")).agg(F.sum("qty").alias("qty"), F.max("high").alias("high"), F.min("low").alias("low"))
    return told(red.compare(direct, merged, [*KEY, "minute"], ["qty", "high", "low"]).select(*KEY, "minute", "kind"))


@query(
    f"""WITH {HISTORY}, {bar_sql(1440)}, even AS (SELECT * FROM bars WHERE day(bar) % 2 = 0), m AS (SELECT symbol, market, bar, close, 0 AS source FROM even UNION ALL SELECT symbol, market, bar, close + 1, 1 FROM bars)
    SELECT symbol, market, {T.format('bar')} AS bar, {R('close')} AS close FROM m QUALIFY row_number() OVER (PARTITION BY symbol, market, bar ORDER BY CASE WHEN close IS NULL THEN 1 ELSE 0 END, source) = 1"""
)
def bar_priority(spark, sf_dir):
    """Bars in memory over stored bars, unless they have no price."""
    b = mn.bars(history_of(spark, sf_dir), 1440).select(*KEY, "bar", "close")
    return told(joins.by_priority([b.where(F.dayofmonth("bar") % 2 == 0), b.withColumn("close", F.col("close") + 1)], [*KEY, "bar"], "close is not null"))


@query(
    f"""WITH {BASE}, l AS (SELECT symbol, market, floor(price) AS price, sum(qty) AS weight FROM trades GROUP BY ALL HAVING sum(qty) >= 60), o AS (SELECT *, CASE WHEN round(price - lag(price) OVER w, 9) <= 2 THEN 0 ELSE 1 END AS opens FROM l WINDOW w AS (PARTITION BY symbol, market ORDER BY price)), c AS (SELECT *, sum(opens) OVER (PARTITION BY symbol, market ORDER BY price ROWS UNBOUNDED PRECEDING) AS cluster FROM o)
    SELECT symbol, market, cluster::BIGINT AS cluster, {R('min(price)')} AS low, {R('max(price)')} AS high, {R('sum(price * greatest(weight, 1)) / sum(greatest(weight, 1))')} AS middle, {R('sum(weight)')} AS weight, count(*) AS levels FROM c GROUP BY symbol, market, cluster"""
)
def price_clusters(spark, sf_dir):
    levels = src.trades(spark, sf_dir).groupBy(*KEY, F.floor("price").cast("double").alias("price")).agg(F.sum("qty").alias("weight")).where("weight >= 60")
    return told(red.price_clusters(levels, KEY, "price", "weight", 2.0))


WALL = """book AS (SELECT symbol, market, bid AS price, bid_qty AS bid, 0.0::DOUBLE AS ask FROM quotes UNION ALL SELECT symbol, market, ask, 0.0::DOUBLE, ask_qty FROM quotes), mids AS (SELECT symbol, market, round(avg((bid + ask) / 2), 2) AS mid FROM quotes GROUP BY ALL)"""


@query(
    f"""WITH {QUOTES}, {WALL}, n AS (SELECT b.*, mid FROM book b JOIN mids m ON b.symbol = m.symbol AND b.market = m.market WHERE abs(price - mid) <= mid * 0.15), g AS (SELECT symbol, market, mid, floor(price / (mid * 0.005))::BIGINT AS bin, sum(bid) AS bid, sum(ask) AS ask, sum(price * (bid + ask)) / sum(bid + ask) AS price FROM n GROUP BY ALL),
    s AS (SELECT symbol, market, mid, bin, price, 'bid' AS side, bid AS size FROM g UNION ALL SELECT symbol, market, mid, bin, price, 'ask', ask FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, market, side ORDER BY size DESC, bin) AS rank FROM s WHERE size > 0 AND ((side = 'bid' AND price <= mid) OR (side = 'ask' AND price >= mid)))
    SELECT symbol, market, side, rank::INTEGER AS rank, bin, {R('price')} AS price, {R('size')} AS size FROM r WHERE rank <= 5"""
)
def liquidity_walls(spark, sf_dir):
    q = src.quotes(spark, sf_dir)
    book = q.select(*KEY, F.col("bid").alias("price"), F.col("bid_qty").alias("b"), F.lit(0.0).alias("a")).unionByName(q.select(*KEY, F.col("ask").alias("price"), F.lit(0.0).alias("b"), F.col("ask_qty").alias("a")))
    mids = q.groupBy(*KEY).agg(F.round(F.avg((F.col("bid") + F.col("ask")) / 2), 2).alias("mid"))
    w = red.walls(book.join(mids, KEY), KEY, "mid", "b", "a", "price")
    return told(w.select(*KEY, "side", "rank", "bin", "price", "size"))


@query(
    f"""WITH {MINUTES}, l AS (SELECT symbol, last(close ORDER BY minute, market) AS now FROM minutes GROUP BY symbol), d AS (SELECT m.symbol, m.market, m.minute, m.close, m.trade_count, abs(m.close - l.now) / l.now AS distance FROM minutes m JOIN l ON m.symbol = l.symbol), y AS (SELECT *, CASE WHEN distance <= 0.003 THEN 'near' WHEN distance <= 0.01 THEN 'mid' ELSE 'far' END AS layer FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, layer ORDER BY distance, minute, market) AS rank FROM y)
    SELECT symbol, market, {T.format('minute')} AS minute, layer, rank::INTEGER AS rank FROM r WHERE rank <= CASE layer WHEN 'near' THEN 36 WHEN 'mid' THEN 18 ELSE 12 END"""
)
def kept_layers(spark, sf_dir):
    """Levels near, fairly near and far from the last price, capped by layer."""
    m = minutes_of(spark, sf_dir)
    now = m.groupBy("symbol").agg(F.max_by("close", F.struct("minute", "market")).alias("now"))
    d = m.join(now, "symbol").withColumn("distance", F.abs(F.col("close") - F.col("now")) / F.col("now"))
    return told(red.keep_layers(d, ["symbol"], "distance", ["distance", "minute", "market"]).select(*KEY, "minute", "layer", "rank"))


@query(
    f"""WITH {MINUTES}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, market ORDER BY notional DESC, minute) AS a, row_number() OVER (PARTITION BY symbol, market ORDER BY trade_count DESC, minute) AS b FROM minutes) SELECT symbol, market, {T.format('minute')} AS minute, {R('notional')} AS notional, trade_count FROM r WHERE a <= 16 OR b <= 8"""
)
def top_of_any(spark, sf_dir):
    m = minutes_of(spark, sf_dir).withColumn("notional", F.col("buy_notional") + F.col("sell_notional"))
    m = m.withColumn("notional", F.round("notional", 6))
    return told(red.top_of_any(m, KEY, {"notional": 16, "trade_count": 8}, "minute").select(*KEY, "minute", "notional", "trade_count"))


@query(f"WITH {MINUTES} SELECT symbol, count(*) AS minutes, sum(2)::BIGINT AS indicators FROM (SELECT DISTINCT symbol, market, minute FROM minutes) GROUP BY symbol")
def minute_bundles(spark, sf_dir):
    """Per minute one document of indicator payloads; how many there are."""
    m = minutes_of(spark, sf_dir)
    parts = {"trade_flow": m.select(*KEY, "minute", "buy_qty", "sell_qty"), "bars": m.select(*KEY, "minute", "open", "high", "low", "close")}
    b = red.bundle(parts, [*KEY, "minute"])
    return b.groupBy("symbol").agg(F.count("*").alias("minutes"), F.sum(F.size("indicators")).alias("indicators"))


@query()
def merged_events(spark, sf_dir):
    """Pivot events merged greedily by time and price."""
    p = ind.pivots(mn.bars(history_of(spark, sf_dir), 60).where("close is not null")).where("pivot_high or pivot_low")
    e = p.select(*KEY, F.when(F.col("pivot_high"), 1).otherwise(-1).alias("direction"), F.col("bar").alias("ts"), F.col("close").alias("price"), F.col("qty").alias("score"))
    return told(red.merge_events(e, [*KEY, "direction"], minutes=720, share=0.2))


@query()
def merged_zones(spark, sf_dir):
    z = mn.bars(history_of(spark, sf_dir), 60).where("close is not null").select(*KEY, F.col("low"), F.col("high"))
    return told(red.merge_zones(z, KEY, 0.01))


@query(
    f"""WITH {HISTORY}, {bar_sql(1440)}, c AS (SELECT *, list(close) OVER (PARTITION BY symbol, market ORDER BY bar ROWS 9 PRECEDING) AS v FROM bars WHERE close IS NOT NULL), m AS (SELECT *, list_median(v) AS med FROM c), d AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - med))) AS mad FROM m)
    SELECT symbol, market, {T.format('bar')} AS bar, {R('CASE WHEN len(v) >= 5 THEN CASE WHEN mad <= 1e-9 * greatest(abs(med), 1) THEN 0 ELSE (close - med) / (1.4826 * mad) END END')} AS robust_z, {R("list_sort(v)[round((len(v) - 1) * 0.9)::INTEGER + 1]")} AS p90 FROM d"""
)
def robust_scores(spark, sf_dir):
    """Robust z of daily closes and their nearest-rank percentile."""
    b = mn.bars(history_of(spark, sf_dir), 1440).where("close is not null")
    v = b.withColumn("v", F.collect_list("close").over(Window.partitionBy(*KEY).orderBy("bar").rowsBetween(-9, 0)))
    return told(v.select(*KEY, "bar", stats.robust_z(F.col("close"), F.col("v"), 5).alias("robust_z"), stats.nearest_rank(F.col("v"), 0.9).alias("p90")))


@query(f"WITH {BASE}, p AS (SELECT DISTINCT symbol, price FROM trades), d AS (SELECT symbol, round(price - lag(price) OVER (PARTITION BY symbol ORDER BY price), 6) AS step FROM p) SELECT symbol, {R('min(step)')} AS tick FROM d WHERE step > 0 GROUP BY symbol")
def inferred_ticks(spark, sf_dir):
    """Least positive difference of a symbol's prices."""
    p = src.trades(spark, sf_dir).select("symbol", "price").distinct()
    step = F.round(F.col("price") - F.lag("price").over(Window.partitionBy("symbol").orderBy("price")), 6)
    return told(p.withColumn("step", step).where("step > 0").groupBy("symbol").agg(F.min("step").alias("tick")))


@query(
    f"""SELECT o_orderpriority AS series, {T.format("date_trunc('day', o_orderdate)")} AS day, count(*) AS orders, {R('first(o_totalprice ORDER BY o_orderkey)')} AS open, {R('max(o_totalprice)')} AS high, {R('min(o_totalprice)')} AS low, {R('last(o_totalprice ORDER BY o_orderkey)')} AS close, sum(CASE WHEN o_totalprice >= 300000 THEN 1 ELSE 0 END)::BIGINT AS large FROM orders GROUP BY ALL"""
)
def order_bars(spark, sf_dir):
    """Orders as prints: daily bars by priority and large orders."""
    o = table(spark, sf_dir, "orders")
    large = F.sum((F.col("o_totalprice") >= 300000).cast("long"))
    return told(o.groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("orders"), F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), large.alias("large")))


@query(
    f"""WITH p AS (SELECT l_returnflag AS series, floor(l_extendedprice / l_quantity / 10)::BIGINT AS tick, sum(l_quantity) AS qty, sum(l_extendedprice) AS notional FROM lineitem GROUP BY ALL) SELECT series, tick, {R('qty')} AS qty, round(notional + 1e-5, 2) AS notional, row_number() OVER (PARTITION BY series ORDER BY qty DESC, tick)::INTEGER AS rank FROM p"""
)
def item_profile(spark, sf_dir):
    """Quantity by unit price over line items, ranked."""
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 10)
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), unit.alias("tick")).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("notional"))
    return told(p.select("series", "tick", "qty", F.round(F.col("notional") + 1e-5, 2).alias("notional"), F.row_number().over(Window.partitionBy("series").orderBy(F.desc("qty"), "tick")).alias("rank")), 6)


@query(
    f"""WITH {QUOTES}, b AS (SELECT symbol, market, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, list_sort(list(struct_pack(price := bid, qty := bid_qty)), 'DESC')[1:5] AS bids, list_sort(list(struct_pack(price := ask, qty := ask_qty)))[1:5] AS asks FROM quotes GROUP BY ALL),
    s AS (SELECT *, list_sum(list_transform(bids, lambda x: x.qty)) AS b, list_sum(list_transform(asks, lambda x: x.qty)) AS a, list_sum(list_transform(bids, lambda x, i: x.qty * exp(-0.35 * (i - 1)))) AS wb, list_sum(list_transform(asks, lambda x, i: x.qty * exp(-0.35 * (i - 1)))) AS wa FROM b)
    SELECT symbol, market, {T.format('ts')} AS ts, {R('(bids[1].qty - asks[1].qty) / (bids[1].qty + asks[1].qty)')} AS obi_l1, {R('(b - a) / (b + a)')} AS obi_k, {R('(wb - wa) / (wb + wa)')} AS obi_k_dw, {R('(wb - wa) / (wb + wa) - lag((wb - wa) / (wb + wa)) OVER (PARTITION BY symbol, market ORDER BY ts)')} AS obi_k_dw_change FROM s"""
)
def book_depth(spark, sf_dir):
    """Hourly books of the best quotes and their depth features."""
    q = src.quotes(spark, sf_dir)
    bids = F.sort_array(F.collect_list(F.struct(F.col("bid").alias("price"), F.col("bid_qty").alias("qty"))), asc=False)
    asks = F.sort_array(F.collect_list(F.struct(F.col("ask").alias("price"), F.col("ask_qty").alias("qty"))))
    books = q.groupBy(*KEY, mn.floor_to(F.col("ts"), 60).alias("ts")).agg(bids.alias("bids"), asks.alias("asks"))
    return told(depth.depth_features(books).select(*KEY, "ts", "obi_l1", "obi_k", "obi_k_dw", "obi_k_dw_change"))


@query(
    f"""WITH {QUOTES}, {WALL}, n AS (SELECT b.*, mid FROM book b JOIN mids m ON b.symbol = m.symbol AND b.market = m.market)
    SELECT symbol, market, {R('sum(CASE WHEN abs(price - mid) <= mid * 0.01 THEN bid ELSE 0 END) / sum(CASE WHEN abs(price - mid) <= mid * 0.01 THEN bid + ask ELSE 0 END)')} AS imbalance_1pct, {R('sum(CASE WHEN abs(price - mid) <= mid * 0.03 THEN bid ELSE 0 END) / sum(CASE WHEN abs(price - mid) <= mid * 0.03 THEN bid + ask ELSE 0 END)')} AS imbalance_3pct FROM n GROUP BY symbol, market"""
)
def depth_imbalance(spark, sf_dir):
    q = src.quotes(spark, sf_dir)
    book = q.select(*KEY, F.col("bid").alias("price"), F.col("bid_qty").alias("b"), F.lit(0.0).alias("a")).unionByName(q.select(*KEY, F.col("ask").alias("price"), F.lit(0.0).alias("b"), F.col("ask_qty").alias("a")))
    mids = q.groupBy(*KEY).agg(F.round(F.avg((F.col("bid") + F.col("ask")) / 2), 2).alias("mid"))
    return told(depth.within(book.join(mids, KEY), "mid", "price", "b", "a", KEY))


@query()
def profile_prominences(spark, sf_dir):
    """Peaks of the volume profile by topographic prominence."""
    p = mn.profile(src.trades(spark, sf_dir).withColumn("price", F.floor("price") / 100))
    return depth.prominences(p.select(*KEY, "tick", (F.col("buy_qty") + F.col("sell_qty")).alias("volume")), KEY)


@query(
    f"""WITH {HISTORY}, {bar_sql(1440)}, r AS (SELECT symbol, market, bar, close, delta, row_number() OVER (PARTITION BY symbol, market ORDER BY bar) AS i FROM bars WHERE close IS NOT NULL), f AS (SELECT *, regr_slope(delta, i) OVER w AS slope, regr_slope(close, i) OVER w AS price_slope, regr_intercept(close, i) OVER w AS base, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY symbol, market ORDER BY bar ROWS 9 PRECEDING))
    SELECT symbol, market, {T.format('bar')} AS bar, {R('CASE WHEN n >= 3 THEN slope END')} AS slope, {R('CASE WHEN n >= 3 THEN close - (base + price_slope * i) END')} AS residual FROM f"""
)
def trend_residuals(spark, sf_dir):
    """Rolling least squares of daily bars: slope of delta, last price residual."""
    w = Window.partitionBy(*KEY).orderBy("bar")
    b = mn.bars(history_of(spark, sf_dir), 1440).where("close is not null").withColumn("i", F.row_number().over(w))
    frame = w.rowsBetween(-9, 0)
    n = F.count("*").over(frame)
    residual = F.col("close") - (F.regr_intercept("close", "i").over(frame) + F.regr_slope("close", "i").over(frame) * F.col("i"))
    return told(b.select(*KEY, "bar", stats.slope(F.col("delta"), F.col("i"), frame).alias("slope"), F.when(n >= 3, residual).alias("residual")))


__all__ = ["ORACLES", "QUERIES"]
