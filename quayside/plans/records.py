"""Selection, gating, identity and state queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayside.operators import indicators as ind
from quayside.operators import joins
from quayside.operators import minute as mn
from quayside.operators import records as rec
from quayside.plans.market import BASE, FUND, HISTORY, KEY, LIQ, MINUTES, QUOTES, R, T, bar_sql, history_of, hour_bars, minutes_of, query, told
from quayside.sources import events as src
from quayside.sources.events import table

HOURS = f"{HISTORY}, {bar_sql(60)}"
FOUR = f"{HISTORY}, {bar_sql(240)}"
OWN = "PARTITION BY symbol, market ORDER BY bar"
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query(f"WITH {HOURS} SELECT symbol, market, {T.format('bar')} AS bar, {R('close')} AS close FROM bars WHERE bar < TIMESTAMP '2024-01-20' AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, market ORDER BY bar DESC) <= 120")
def older_bars(spark, sf_dir):
    """The last 120 closed bars before a time."""
    b = hour_bars(spark, sf_dir).where(F.col("bar") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return told(rec.tail(b, KEY, "bar", 120).select(*KEY, "bar", "close"))


@query(f"WITH {HISTORY}, {bar_sql(15)} SELECT symbol, market, {T.format('bar')} AS bar, {R('open')} AS open, {R('close')} AS close, {R('qty')} AS qty FROM bars WHERE bar >= TIMESTAMP '2024-01-05' AND bar < TIMESTAMP '2024-01-08'")
def bar_range(spark, sf_dir):
    b = rec.time_range(mn.bars(history_of(spark, sf_dir), 15), "bar", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-08").cast("timestamp_ntz"))
    return told(b.select(*KEY, "bar", "open", "close", "qty"))


@query(f"WITH {HOURS}, p AS (SELECT *, min(low) OVER w AS lo, max(high) OVER w AS hi FROM bars WINDOW w AS ({OWN} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) SELECT symbol, market, {T.format('bar')} AS bar, CASE WHEN close IS NULL OR lo IS NULL OR hi IS NULL THEN 'unknown' WHEN close > hi THEN 'above' WHEN close < lo THEN 'below' ELSE 'inside' END AS position FROM p")
def price_position(spark, sf_dir):
    """The close against the range of the 24 hours before."""
    w = Window.partitionBy(*KEY).orderBy("bar").rowsBetween(-24, -1)
    b = mn.bars(history_of(spark, sf_dir), 60).withColumns({"lo": F.min("low").over(w), "hi": F.max("high").over(w)})
    return told(b.select(*KEY, "bar", rec.position(F.col("close"), F.col("lo"), F.col("hi")).alias("position")))


@query(f"WITH {BASE} SELECT trade_id, symbol, market FROM trades WHERE epoch_us((SELECT max(ts) FROM trades)) - epoch_us(ts) <= 86400000000")
def fresh_trades(spark, sf_dir):
    """Trades of the last day by the table's own clock."""
    t = src.trades(spark, sf_dir)
    now = t.agg(F.max("ts")).first()[0]
    return rec.fresh(t, "ts", F.lit(now), 86400).select("trade_id", *KEY)


@query(f"WITH {MINUTES} SELECT symbol, market, {T.format('minute')} AS minute, trade_count FROM minutes WHERE symbol IN ('S0', 'S2') AND minute(minute) IN (0, 15, 30, 45)")
def gated_minutes(spark, sf_dir):
    return told(rec.gate(minutes_of(spark, sf_dir), "minute", ["S0", "S2"], [0, 15, 30, 45]).select(*KEY, "minute", "trade_count"))


@query(f"""WITH {FOUR}, s AS (SELECT symbol, market, bar + INTERVAL 240 MINUTE AS known, CASE WHEN close > open THEN 'bull' WHEN close < open THEN 'bear' ELSE 'neutral' END AS regime FROM bars WHERE close IS NOT NULL),
    h AS (SELECT symbol, market, time_bucket(INTERVAL 60 MINUTE, minute, TIMESTAMP '1970-01-01') AS bar FROM history GROUP BY ALL) SELECT h.symbol, h.market, {T.format('h.bar')} AS bar, s.regime FROM h ASOF LEFT JOIN s ON h.symbol = s.symbol AND h.market = s.market AND h.bar >= s.known""")
def regime_asof(spark, sf_dir):
    """The regime of the last closed 4-hour bar at every hour."""
    h = history_of(spark, sf_dir)
    c, o = F.col("close"), F.col("open")
    s = mn.bars(h, 240).where("close is not null").select(*KEY, (F.col("bar") + F.expr("interval 240 minutes")).alias("known"), F.when(c > o, "bull").when(c < o, "bear").otherwise("neutral").alias("regime"))
    return told(joins.asof(mn.bars(h, 60).select(*KEY, "bar"), s, KEY, "bar", "known", ["regime"]))


@query(f"WITH {HOURS}, k AS (SELECT symbol, market, bar, CASE WHEN hour(bar) = 0 THEN low END AS lo, CASE WHEN hour(bar) = 0 THEN high END AS hi FROM bars) SELECT symbol, market, {T.format('bar')} AS bar, {R('last_value(lo IGNORE NULLS) OVER w')} AS lo, {R('last_value(hi IGNORE NULLS) OVER w')} AS hi FROM k WINDOW w AS ({OWN} ROWS UNBOUNDED PRECEDING)")
def carried_levels(spark, sf_dir):
    """Levels set at midnight, carried on by the hour."""
    b = mn.bars(history_of(spark, sf_dir), 60)
    levels = b.where(F.hour("bar") == 0).select(*KEY, "bar", F.col("low").alias("lo"), F.col("high").alias("hi"))
    return told(rec.carry_levels(b.select(*KEY, "bar"), levels, KEY, "bar", ["lo", "hi"]))


@query(f"WITH {HISTORY}, {bar_sql(1440)}, d AS (SELECT symbol, market, bar AS day, low, high FROM bars WHERE close IS NOT NULL), m AS (SELECT symbol, market, minute, close FROM minutes) SELECT m.symbol, m.market, {T.format('m.minute')} AS minute, {T.format('d.day')} AS day FROM m JOIN d ON m.symbol = d.symbol AND m.market = d.market AND date_trunc('day', m.minute) = d.day + INTERVAL 1 DAY AND m.close BETWEEN d.low + (d.high - d.low) * 0.25 AND d.high - (d.high - d.low) * 0.25")
def zone_hits(spark, sf_dir):
    """Minutes inside the middle half of the previous day's range."""
    d = mn.bars(history_of(spark, sf_dir), 1440).where("close is not null").select(*KEY, F.col("bar").alias("day"), "low", "high")
    span = F.col("high") - F.col("low")
    z = d.select(*KEY, "day", (F.col("low") + span * 0.25).alias("lo"), (F.col("high") - span * 0.25).alias("hi"), (F.col("day") + F.expr("interval 1 day")).alias("_d"))
    m = minutes_of(spark, sf_dir).select(*KEY, "minute", "close", F.window("minute", "1 day")["start"].alias("_d"))
    return told(m.join(z, [*KEY, "_d"]).where(F.col("close").between(F.col("lo"), F.col("hi"))).select(*KEY, "minute", "day"))


@query("SELECT event_type, CASE WHEN event_type IN ('purchase', 'click') THEN 'flow' WHEN event_type = 'error' THEN 'risk' ELSE 'other' END AS category, count(*) AS events FROM events GROUP BY ALL")
def catalog_counts(spark, sf_dir):
    """Events by their catalog's category; the catalog is a handful of rows."""
    catalog = spark.sql("SELECT * FROM VALUES ('purchase', 'flow'), ('click', 'flow'), ('error', 'risk') AS t(event_type, category)")
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"))
    return e.join(F.broadcast(catalog), "event_type", "left").select("event_type", F.coalesce("category", F.lit("other")).alias("category"), "events")


@query(f"WITH p AS (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 200) SELECT e.event_id, e.event_type, e.props, {R('e.value')} AS value FROM p JOIN events e ON e.event_id = p.event_id")
def late_columns(spark, sf_dir):
    """The greatest events by a narrow scan, their wide columns joined late."""
    e = table(spark, sf_dir, "events")
    picked = e.select("value", "event_id").orderBy(F.desc("value"), "event_id").limit(200).select("event_id")
    return told(e.join(F.broadcast(picked), "event_id").select("event_id", "event_type", "props", "value"))


@query(f"WITH {BASE}, {QUOTES}, {LIQ}, {FUND}, d AS (SELECT DISTINCT symbol, date_trunc('day', ts) AS day FROM trades) SELECT symbol, {T.format('day')} AS day, EXISTS (SELECT 1 FROM quotes q WHERE q.symbol = d.symbol AND date_trunc('day', q.ts) = d.day) AS has_quotes, EXISTS (SELECT 1 FROM orders_ o WHERE o.symbol = d.symbol AND date_trunc('day', o.ts) = d.day) AS has_liq, EXISTS (SELECT 1 FROM points p WHERE p.symbol = d.symbol AND date_trunc('day', p.ts) = d.day) AS has_funding FROM d")
def presence(spark, sf_dir):
    """Which sources a symbol has on a day: one aggregate of flags."""
    parts = {"trades": src.trades, "has_quotes": src.quotes, "has_liq": src.force_orders, "has_funding": src.funding_points}
    rows = None
    for k, f in parts.items():
        one = f(spark, sf_dir).select("symbol", F.window("ts", "1 day")["start"].alias("day"), F.lit(k).alias("k"))
        rows = one if rows is None else rows.unionByName(one)
    g = rows.groupBy("symbol", "day").agg(*[F.max(F.col("k") == k).alias(k) for k in parts])
    return told(g.where("trades").drop("trades"))


@query(f"""WITH {MINUTES}, k AS (SELECT symbol, market, minute, open + 1 AS open, high + 2 AS high, low - 1 AS low, close + 1 AS close FROM minutes WHERE minute(minute) % 2 = 0) SELECT m.symbol, m.market, {T.format('m.minute')} AS minute, {R('coalesce(k.open, m.open)')} AS open, {R('coalesce(k.high, m.high)')} AS high, {R('coalesce(k.low, m.low)')} AS low, {R('coalesce(k.close, m.close)')} AS close, {R('m.buy_qty')} AS buy_qty FROM minutes m LEFT JOIN k USING (symbol, market, minute)""")
def folded_klines(spark, sf_dir):
    """A minute's prices are its kline's where there is one; flows stay."""
    m = minutes_of(spark, sf_dir)
    k = m.where(F.minute("minute") % 2 == 0).select(*KEY, "minute", *[(F.col(c) + d).alias(c) for c, d in (("open", 1), ("high", 2), ("low", -1), ("close", 1))])
    prices = ("open", "high", "low", "close")
    met = m.select(*KEY, "minute", "buy_qty", *prices).join(k.withColumnsRenamed({c: f"k_{c}" for c in prices}), [*KEY, "minute"], "left")
    return told(met.select(*KEY, "minute", *[F.coalesce(f"k_{c}", c).alias(c) for c in prices], "buy_qty"))


def _conflated(name: str, micros: int, width: str) -> None:
    def run(spark, sf_dir):
        c = rec.conflate(src.quotes(spark, sf_dir), KEY, "ts", width, ["ts", "update_id"])
        return told(c.select(*KEY, F.unix_micros(F.col("bucket").cast("timestamp")).alias("bucket"), "events", "update_id", "bid", "ask"))

    run.__name__ = name
    query(f"WITH {QUOTES} SELECT symbol, market, (epoch_us(ts) // {micros}) * {micros} AS bucket, count(*) AS events, last(update_id ORDER BY ts, update_id) AS update_id, {R('last(bid ORDER BY ts, update_id)')} AS bid, {R('last(ask ORDER BY ts, update_id)')} AS ask FROM quotes GROUP BY ALL")(run)


_conflated("conflated_100ms", 100_000, "100 milliseconds")
_conflated("depth_batches", 3_600_000_000, "1 hour")


@query(f"WITH {FUND} SELECT symbol, {T.format(chr(100) + 'ate_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS hour, count(*) AS points, string_agg(point_id::VARCHAR || ':' || round(mark, 2)::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY ts, point_id) AS marks FROM points GROUP BY symbol, date_trunc('hour', ts)")
def mark_points(spark, sf_dir):
    """Funding and mark points of an interval, in order."""
    p = src.funding_points(spark, sf_dir)
    one = F.struct("ts", "point_id", "mark_price")
    g = p.groupBy("symbol", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("points"), F.array_sort(F.collect_list(one)).alias("s"))
    text = F.transform("s", lambda x: F.concat(x["point_id"].cast("string"), F.lit(":"), F.round(x["mark_price"], 2).cast("decimal(18,2)").cast("string")))
    return told(g.select("symbol", "hour", "points", F.array_join(text, ",").alias("marks")))


@query(f"""WITH {QUOTES}, c AS (SELECT symbol, market, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS hour, floor(bid)::BIGINT AS price, bid_qty AS qty, row_number() OVER (PARTITION BY symbol, market, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') ORDER BY ts, update_id) AS sample FROM quotes),
    w AS (SELECT *, coalesce(lead(sample) OVER (PARTITION BY symbol, market, hour, price ORDER BY sample), max(sample) OVER (PARTITION BY symbol, market, hour) + 1) - sample AS stays FROM c) SELECT symbol, market, {T.format('hour')} AS hour, price, {R('sum(qty * stays)')} AS weighted, sum(stays)::BIGINT AS samples FROM w GROUP BY symbol, market, hour, price""")
def time_in_book(spark, sf_dir):
    """Book levels weighted by the samples they stay."""
    q = src.quotes(spark, sf_dir).withColumn("hour", F.window("ts", "1 hour")["start"])
    sample = F.row_number().over(Window.partitionBy(*KEY, "hour").orderBy("ts", "update_id"))
    c = q.select(*KEY, "hour", F.floor("bid").alias("price"), F.col("bid_qty").alias("qty"), sample.cast("long").alias("sample"))
    return told(rec.time_in_book(c, [*KEY, "hour"], "sample", "price", "qty"))


@query(f"WITH {BASE}, t AS (SELECT trade_id, CASE WHEN trade_id % 3 = 0 THEN 'md.agg.trade' ELSE 'md.trade' END AS kind, trade_id % 5 = 0 AS backfill FROM trades) SELECT trade_id, unnest(CASE WHEN NOT backfill THEN ['live'] WHEN kind = 'md.agg.trade' THEN ['replay', 'live'] ELSE ['replay'] END) AS exchange FROM t")
def publish_routes(spark, sf_dir):
    t = src.trades(spark, sf_dir).select("trade_id", F.when(F.col("trade_id") % 3 == 0, "md.agg.trade").otherwise("md.trade").alias("kind"), (F.col("trade_id") % 5 == 0).alias("backfill"))
    return rec.published(t, "kind", "backfill").select("trade_id", "exchange")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')")
def generic_events(spark, sf_dir):
    """Only some codes go to the generic event table."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error")).select("event_id", "event_type")


@query("SELECT event_id, user_id % 4 AS shard, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id)::INTEGER AS claim, least(3 * (user_id % 30 + 1), 60) AS retry_seconds FROM events WHERE event_type = 'error'")
def outbox_plan(spark, sf_dir):
    """Order of claims and seconds to the next attempt of failed messages."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    o = e.select(F.col("event_id").alias("id"), F.col("ts").alias("created"), (F.col("user_id") % 4).alias("shard"), (F.col("user_id") % 30).alias("attempts"))
    return rec.retry_plan(o).select(F.col("id").alias("event_id"), "shard", "claim", "retry_seconds")


@query(f"WITH {MINUTES}, l AS (SELECT symbol, market, minute, CASE WHEN epoch(minute) - epoch(lag(minute) OVER w) > 3600 THEN 1 ELSE 0 END AS opens FROM minutes WINDOW w AS (PARTITION BY symbol, market ORDER BY minute)) SELECT symbol, market, {T.format('minute')} AS minute, sum(opens) OVER (PARTITION BY symbol, market ORDER BY minute ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM l")
def continuity_segments(spark, sf_dir):
    """State starts anew after an hour without a trade."""
    return told(rec.segments(minutes_of(spark, sf_dir).select(*KEY, "minute"), KEY, "minute", 3600))


@query(f"""WITH {HOURS}, q AS (SELECT DISTINCT symbol, market, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS bar FROM ({'WITH ' + QUOTES + ' SELECT * FROM quotes'})), t AS (SELECT symbol, market, bar FROM bars WHERE close IS NOT NULL),
    m AS (SELECT b.symbol, b.market, b.bar, t.bar IS NULL AS no_trade, q.bar IS NULL AS no_book FROM bars b LEFT JOIN t USING (symbol, market, bar) LEFT JOIN q USING (symbol, market, bar))
    SELECT symbol, market, {T.format('bar')} AS bar, concat_ws(',', CASE WHEN no_trade THEN 'trade' END, CASE WHEN no_book THEN 'book' END) AS missing FROM m WHERE no_trade OR no_book QUALIFY row_number() OVER ({OWN}) = 1""")
def completeness_gate(spark, sf_dir):
    """The first hour that may not be emitted, and what it lacks."""
    b = mn.bars(history_of(spark, sf_dir), 60)
    book = src.quotes(spark, sf_dir).select(*KEY, mn.floor_to(F.col("ts"), 60).alias("bar"))
    g = rec.first_incomplete(b.select(*KEY, "bar"), {"trade": b.where("close is not null"), "book": book}, KEY, "bar")
    return told(g.withColumn("missing", F.array_join("missing", ",")))


@query(f"WITH {MINUTES}, c AS (SELECT * FROM minutes WHERE minute(minute) % 3 = 0) SELECT symbol, market, {T.format('minute')} AS minute, {R('close')} AS close, 'canonical' AS origin FROM c UNION ALL SELECT symbol, market, {T.format('minute')}, {R('close + 5')}, 'live' FROM minutes WHERE minute(minute) % 3 <> 0")
def canonical_override(spark, sf_dir):
    m = minutes_of(spark, sf_dir).select(*KEY, "minute", "close")
    return told(rec.override(m.where(F.minute("minute") % 3 == 0), m.withColumn("close", F.col("close") + 5), [*KEY, "minute"]))


@query(f"WITH {HOURS} SELECT symbol, market, {T.format('bar')} AS bar FROM bars WHERE close IS NULL")
def supplement_plan(spark, sf_dir):
    """Hours that a supplement must fetch: wanted less present."""
    b = mn.bars(history_of(spark, sf_dir), 60)
    return told(rec.needed(b.select(*KEY, "bar"), b.where("close is not null"), [*KEY, "bar"]))


@query(f"WITH {MINUTES}, {LIQ}, a AS (SELECT symbol, market, minute FROM minutes), b AS (SELECT DISTINCT symbol, market, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS minute FROM orders_) SELECT symbol, market, {T.format('minute')} AS minute, 'left' AS only FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT symbol, market, {T.format('minute')}, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def rebuild_differences(spark, sf_dir):
    """Keys that one of two builds has and the other lacks."""
    a = minutes_of(spark, sf_dir).select(*KEY, "minute")
    b = src.force_orders(spark, sf_dir).select(*KEY, (mn.minute_of(F.col("ts")) + F.expr("interval 1 minute")).alias("minute")).distinct()
    return told(rec.key_differences(a, b, [*KEY, "minute"]))


@query(f"WITH {FOUR}, d AS (SELECT *, CASE WHEN close >= open THEN 'LONG' ELSE 'SHORT' END AS side FROM bars WHERE close IS NOT NULL) SELECT symbol, market, {T.format('bar')} AS bar, side, {R('CASE WHEN (side = $$LONG$$ AND low < close AND close < high) OR (side = $$SHORT$$ AND low < close AND close < high) THEN CASE WHEN side = $$LONG$$ THEN (high - close) / (close - low) ELSE (close - low) / (high - close) END END')} AS rr FROM d")
def reward_risk(spark, sf_dir):
    """Entry at the close, stop and target at the bar's ends."""
    b = mn.bars(history_of(spark, sf_dir), 240).where("close is not null").withColumn("side", F.when(F.col("close") >= F.col("open"), "LONG").otherwise("SHORT"))
    long_ = F.col("side") == "LONG"
    rr = rec.reward_risk(F.col("side"), F.col("close"), F.when(long_, F.col("low")).otherwise(F.col("high")), F.when(long_, F.col("high")).otherwise(F.col("low")))
    return told(b.select(*KEY, "bar", "side", rr.alias("rr")))


@query("SELECT event_id, event_type AS kind, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'none' ELSE json_extract_string(props, '$.k') END AS k FROM events")
def merged_payloads(spark, sf_dir):
    """A base payload over another one; the base's keys win."""
    e = table(spark, sf_dir, "events")
    props = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    base = F.create_map(F.lit("kind"), F.col("event_type"))
    base = rec.merge_payload(base, F.map_filter(props, lambda _, v: v.isNotNull()))
    m = rec.merge_payload(base, F.create_map(F.lit("kind"), F.lit("other"), F.lit("k"), F.lit("none")))
    return e.select("event_id", m["kind"].alias("kind"), m["k"].alias("k"))


@query(f"WITH d AS (SELECT event_id, sha1(from_hex('{NAMESPACE.replace('-', '')}') || ('ind|' || event_type || '|' || event_id)::BLOB) AS d FROM events) SELECT event_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(d, 17, 1))::INTEGER, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS message_id FROM d")
def message_ids(spark, sf_dir):
    """Stable ids: version-5 UUIDs of scope and identity."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", rec.name_uuid(F.concat_ws("|", F.lit("ind"), "event_type", F.col("event_id").cast("string")), NAMESPACE).alias("message_id"))


def _directed(name: str, source, sql_name: str, sign: int) -> None:
    from quayside.plans.market import ORACLES

    def run(spark, sf_dir):
        return source(spark, sf_dir).where(F.col("direction") == sign)

    run.__name__ = name
    query(f"SELECT * FROM ({ORACLES[sql_name]}) WHERE direction = {sign}")(run)


def _register_directed() -> None:
    from quayside.plans import market

    for kind in ("absorption", "initiation"):
        for word, sign in (("bullish", 1), ("bearish", -1)):
            _directed(f"{word}_{kind}", getattr(market, kind), kind, sign)


_register_directed()


@query(f"WITH {HOURS}, t AS (SELECT symbol, market, bar, greatest(high - low, abs(high - coalesce(lag(close) OVER o, close)), abs(low - coalesce(lag(close) OVER o, close))) AS tr FROM bars WHERE close IS NOT NULL WINDOW o AS ({OWN})) SELECT symbol, market, {T.format('bar')} AS bar, {R('CASE WHEN count(*) OVER f >= 14 THEN avg(tr) OVER f END')} AS atr FROM t WINDOW f AS ({OWN} ROWS 13 PRECEDING)")
def average_true_range(spark, sf_dir):
    """ATR 14; the first range has its own close as the one before."""
    return told(ind.atr(hour_bars(spark, sf_dir), 14).select(*KEY, "bar", "atr"))


@query(f"WITH {FOUR}, r AS (SELECT symbol, market, high - low AS r FROM bars WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, market ORDER BY bar DESC) <= 5) SELECT symbol, market, {R('CASE WHEN count(*) >= 3 THEN list_sort(list(r))[count(*) // 2 + 1] END')} AS v FROM r GROUP BY symbol, market")
def range_median(spark, sf_dir):
    """Upper median of the last five ranges, of three at least."""
    b = rec.tail(mn.bars(history_of(spark, sf_dir), 240).where("close is not null"), KEY, "bar", 5)
    g = b.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.col("high") - F.col("low"))).alias("r"))
    return told(g.select(*KEY, F.when(F.size("r") >= 3, F.element_at("r", F.floor(F.size("r") / 2).cast("int") + 1)).alias("v")))


@query(f"WITH {HOURS}, s AS (SELECT symbol, market, bar, CASE WHEN close >= open THEN 1 ELSE -1 END AS d FROM bars WHERE close IS NOT NULL), l AS (SELECT *, last(d ORDER BY bar) OVER (PARTITION BY symbol, market) AS now, row_number() OVER (PARTITION BY symbol, market ORDER BY bar DESC) AS back FROM s) SELECT symbol, market, now::INTEGER AS direction, coalesce(min(back) FILTER (d <> now) - 1, max(back))::BIGINT AS hours FROM l GROUP BY symbol, market, now")
def tail_runs(spark, sf_dir):
    """How many last hours went the same way."""
    d = F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)
    b = hour_bars(spark, sf_dir).select(*KEY, "bar", d.alias("d"))
    now = b.groupBy(*KEY).agg(F.max_by("d", "bar").alias("direction"))
    turned = b.join(now, KEY).groupBy(*KEY, "direction").agg(F.max(F.when(F.col("d") != F.col("direction"), F.col("bar"))).alias("turn"))
    run = b.join(turned, KEY).where(F.col("turn").isNull() | (F.col("bar") > F.col("turn")))
    return run.groupBy(*KEY, "direction").agg(F.count("*").alias("hours"))


__all__ = []
