"""Reduction queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayside.operators import minute as mn
from quayside.operators import reductions as red
from quayside.plans.market import BASE, HISTORY, KEY, LIQ, PROFILE, QUOTES, R, T, bar_sql, history_of, hour_bars, query, told, unit_profile
from quayside.plans.records import HOURS, OWN
from quayside.sources import events as src

LIVE = f"{HOURS}, b AS (SELECT * FROM bars WHERE close IS NOT NULL)"
ATR = f"{LIVE}, t AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER o, close)), abs(low - coalesce(lag(close) OVER o, close))) AS tr FROM b WINDOW o AS ({OWN})), a AS (SELECT *, CASE WHEN count(*) OVER f >= 14 THEN avg(tr) OVER f END AS atr FROM t WINDOW f AS ({OWN} ROWS 13 PRECEDING))"
VOLUME = f"{PROFILE}, v AS (SELECT symbol, market, tick, buy_qty + sell_qty AS volume FROM profile)"
DAY = f"WINDOW w AS ({OWN} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
NOW = "now AS (SELECT symbol, market, last(close ORDER BY bar) AS price FROM b GROUP BY symbol, market)"


def volumes(spark, sf_dir):
    return unit_profile(spark, sf_dir).select(*KEY, "tick", (F.col("buy_qty") + F.col("sell_qty")).alias("volume"))


def ranged(spark, sf_dir):
    w = Window.partitionBy(*KEY).orderBy("bar").rowsBetween(-24, -1)
    return hour_bars(spark, sf_dir).withColumns({"lo": F.min("low").over(w), "hi": F.max("high").over(w)})


def priced(spark, sf_dir):
    b = hour_bars(spark, sf_dir)
    return b.join(b.groupBy(*KEY).agg(F.max_by("close", "bar").alias("price")), KEY)


@query(f"WITH {LIVE}, r AS (SELECT *, min(low) OVER w AS lo, max(high) OVER w AS hi, notional / nullif(qty, 0) AS vw FROM b {DAY}), u AS (SELECT symbol, market, bar, close, 'day_low' AS ref, lo AS level FROM r UNION ALL SELECT symbol, market, bar, close, 'day_high', hi FROM r UNION ALL SELECT symbol, market, bar, close, 'vwap', vw FROM r) SELECT symbol, market, {T.format('bar')} AS bar, ref, {R('close - level')} AS diff, {R('100 * (close - level) / level')} AS pct FROM u")
def price_anchors(spark, sf_dir):
    b = ranged(spark, sf_dir)
    return told(red.anchors(b, {"day_low": F.col("lo"), "day_high": F.col("hi"), "vwap": F.col("notional") / F.nullif(F.col("qty"), F.lit(0.0))}, F.col("close")))


@query(f"WITH {LIVE}, r AS (SELECT *, min(low) OVER w AS lo, max(high) OVER w AS hi FROM b {DAY}), p AS (SELECT symbol, market, bar, CASE WHEN close > lo + (hi - lo) * 0.75 THEN 1 WHEN close < lo + (hi - lo) * 0.25 THEN -1 ELSE 0 END AS place FROM r), s AS (SELECT *, min(place) OVER f = max(place) OVER f AS same, lag(place) OVER o AS before, count(*) OVER f AS seen FROM p WINDOW o AS ({OWN}), f AS ({OWN} ROWS 2 PRECEDING)) SELECT symbol, market, {T.format('bar')} AS bar, place, CASE WHEN place <> 0 AND same AND seen = 3 THEN 'accepted' WHEN place <> 0 THEN 'rejected' WHEN before <> 0 THEN 'reentered' ELSE 'inside' END AS state FROM s")
def value_states(spark, sf_dir):
    """Acceptance of prices outside the middle half of the last day's range."""
    span = F.col("hi") - F.col("lo")
    return told(red.acceptance(ranged(spark, sf_dir), F.col("lo") + span * 0.25, F.col("lo") + span * 0.75))


CANDIDATES = "SELECT symbol, market, CASE WHEN close >= open THEN 'support' ELSE 'resistance' END AS kind, floor(low / 10) * 10 AS low, floor(low / 10) * 10 + 10 AS high, 'h' || hour(bar) AS scope, qty AS score FROM b"


@query(f"WITH {LIVE}, {NOW}, c AS ({CANDIDATES}), g AS (SELECT c.symbol, c.market, price, kind, low, high, list_sort(list(DISTINCT scope)) AS scopes, max(score) AS score FROM c JOIN now USING (symbol, market) GROUP BY ALL), d AS (SELECT *, CASE WHEN price < low THEN low - price WHEN price > high THEN price - high ELSE 0 END AS distance FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, market, kind ORDER BY round(distance, 6), low, high) AS rank FROM d) SELECT symbol, market, kind, {R('low')} AS low, {R('high')} AS high, array_to_string(scopes, ',') AS scopes, {R('score')} AS score, {R('distance')} AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 8")
def bracket_board(spark, sf_dir):
    """The nearest supports and resistances, each with all hours it held."""
    low = F.floor(F.col("low") / 10) * 10.0
    c = priced(spark, sf_dir).select(*KEY, "price", F.when(F.col("close") >= F.col("open"), "support").otherwise("resistance").alias("kind"), low.alias("low"), (low + 10).alias("high"), F.concat(F.lit("h"), F.hour("bar").cast("string")).alias("scope"), F.col("qty").alias("score"))
    return told(red.brackets(c, KEY, "price").select(*KEY, "kind", "low", "high", F.array_join("scopes", ",").alias("scopes"), "score", "distance", "rank"))


@query(f"WITH {LIVE}, {NOW}, z AS (SELECT DISTINCT b.symbol, b.market, price, floor(low / 5) * 5 AS low, floor(low / 5) * 5 + 5 AS high FROM b JOIN now USING (symbol, market)), d AS (SELECT *, CASE WHEN price > high THEN 'above' WHEN price < low THEN 'below' END AS side, CASE WHEN price > high THEN price - high ELSE low - price END AS distance FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, market, side ORDER BY round(distance, 6), low, high) AS rank FROM d WHERE side IS NOT NULL) SELECT symbol, market, side, {R('low')} AS low, {R('high')} AS high, {R('distance')} AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def structure_nodes(spark, sf_dir):
    low = F.floor(F.col("low") / 5) * 5.0
    z = priced(spark, sf_dir).select(*KEY, "price", low.alias("low"), (low + 5).alias("high")).distinct()
    return told(red.nodes_near(z, KEY, "price").select(*KEY, "side", "low", "high", "distance", "rank"))


@query(f"WITH {ATR} SELECT symbol, market, {T.format('bar')} AS bar, {R('close / lag(close, 3) OVER o - 1')} AS return_3, {R('(high - low) / atr')} AS range_atr, {R('(close - low) / CASE WHEN high - low > 1e-12 THEN high - low END')} AS close_location, {R('sum(delta) OVER f')} AS delta_3 FROM a WINDOW o AS ({OWN}), f AS ({OWN} ROWS 2 PRECEDING)")
def momentum(spark, sf_dir):
    return told(red.momentum(hour_bars(spark, sf_dir)))


def _path(bars: int) -> None:
    def run(spark, sf_dir):
        return told(red.path_block(hour_bars(spark, sf_dir), bars))

    run.__name__ = f"path_{bars}"
    query(f"WITH {ATR}, l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol, market ORDER BY bar DESC) <= {bars}), g AS (SELECT symbol, market, count(*) AS bars, max(high) AS high, min(low) AS low, last(close ORDER BY bar) - first(open ORDER BY bar) AS net, last(atr ORDER BY bar) AS atr, avg(high - greatest(open, close)) AS uw, avg(least(open, close) - low) AS lw, sum(CASE WHEN close >= open THEN 1 ELSE 0 END)::BIGINT AS up_bars FROM l GROUP BY symbol, market) SELECT symbol, market, bars, {R('high')} AS high, {R('low')} AS low, {R('net')} AS net, {R('net / atr')} AS net_atr, {R('uw')} AS upper_wick, {R('lw')} AS lower_wick, up_bars FROM g")(run)


for _n in (12, 10, 8):
    _path(_n)


@query(f"WITH {ATR} SELECT symbol, market, {T.format('bar')} AS bar, {R('atr')} AS atr, {', '.join(f'{R(f'max(high) OVER ({OWN} ROWS {n - 1} PRECEDING)')} AS swing_high_{n}, {R(f'min(low) OVER ({OWN} ROWS {n - 1} PRECEDING)')} AS swing_low_{n}' for n in (10, 5, 3))} FROM a")
def swing_levels(spark, sf_dir):
    return told(red.swings(hour_bars(spark, sf_dir)))


@query(f"WITH {LIQ}, d AS (SELECT symbol, market, date_trunc('day', ts) AS day, sum(CASE WHEN liq_side = 'long_liq' THEN notional ELSE 0 END) AS l, sum(CASE WHEN liq_side = 'short_liq' THEN notional ELSE 0 END) AS s FROM orders_ GROUP BY ALL), z AS (SELECT *, l + s AS total, sum(l + s) OVER w AS t7, count(*) OVER w AS n, stddev_pop(l + s) OVER w AS sd, avg(l + s) OVER w AS mean FROM d WINDOW w AS (PARTITION BY symbol, market ORDER BY day ROWS 6 PRECEDING)) SELECT symbol, market, {T.format('day')} AS day, {R('l')} AS long_liq, {R('s')} AS short_liq, {R('total')} AS total, {R('l / total')} AS long_share, {R('t7')} AS total_7d, {R('CASE WHEN n >= 5 THEN CASE WHEN sd <= 1e-12 THEN 0 ELSE (total - mean) / sd END END')} AS z FROM z")
def liquidation_summary(spark, sf_dir):
    return told(red.liquidation_summary(src.force_orders(spark, sf_dir)))


@query(f"WITH {VOLUME}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol, market ORDER BY volume, tick) AS rank, count(*) OVER (PARTITION BY symbol, market) AS n, max(volume) OVER (PARTITION BY symbol, market ORDER BY tick RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM v), t AS (SELECT symbol, market, volume AS threshold FROM p WHERE rank = floor((n - 1) * 0.9::DOUBLE + 0.5) + 1) SELECT p.symbol, p.market, tick, {R('volume')} AS volume FROM p JOIN t USING (symbol, market) WHERE volume >= threshold AND volume >= top")
def peak_clusters(spark, sf_dir):
    return told(red.peak_clusters(volumes(spark, sf_dir), KEY))


LAYERS = [("near", "true", "distance, tick", 6), ("strong", "true", "volume DESC, tick", 4), ("mid", "distance BETWEEN 0.01 AND 0.03", "volume DESC, tick", 4), ("deep", "distance > 0.03", "volume DESC, tick", 4)]


def _layers_sql() -> str:
    parts, left = [], "d0"
    for i, (name, fits, order, k) in enumerate(LAYERS):
        parts.append(f"r{i} AS (SELECT *, {fits} AS fits, row_number() OVER (PARTITION BY symbol, market, {fits} ORDER BY {order}) AS rank FROM {left})")
        parts.append(f"d{i + 1} AS (SELECT symbol, market, tick, volume, distance FROM r{i} WHERE NOT (fits AND rank <= {k}))")
        left = f"d{i + 1}"
    return ", ".join(parts)


@query(f"WITH {VOLUME}, d0 AS (SELECT *, abs(tick - 250) / 250.0::DOUBLE AS distance FROM v), {_layers_sql()} " + " UNION ALL ".join(f"SELECT symbol, market, tick, {R('volume')} AS volume, '{n}' AS layer FROM r{i} WHERE fits AND rank <= {k}" for i, (n, _, _, k) in enumerate(LAYERS)))
def layered_levels(spark, sf_dir):
    """Levels around a price of 250 in layers, each of what is left."""
    v = volumes(spark, sf_dir).withColumn("distance", F.abs(F.col("tick") - 250) / F.lit(250.0))
    return told(red.layered(v, KEY, "distance", "volume", "tick").select(*KEY, "tick", "volume", "layer"))


@query(f"WITH {QUOTES}, m AS (SELECT symbol, market, round(avg((bid + ask) / 2), 2) AS mid FROM quotes GROUP BY ALL) SELECT q.symbol, q.market, round(bid / (mid * 0.005))::BIGINT AS step, {R('sum(bid_qty)')} AS weight, count(*) AS levels FROM quotes q JOIN m ON q.symbol = m.symbol AND q.market = m.market GROUP BY ALL")
def imbalance_steps(spark, sf_dir):
    q = src.quotes(spark, sf_dir)
    mids = q.groupBy(*KEY).agg(F.round(F.avg((F.col("bid") + F.col("ask")) / 2), 2).alias("mid"))
    return told(red.step_clusters(q.join(mids, KEY), KEY, "mid", "bid", "bid_qty"))


@query(f"WITH {VOLUME}, p AS (SELECT *, min(tick) OVER e AS lo, greatest(ceil((max(tick) OVER e - min(tick) OVER e + 1) / 24.0), 1)::BIGINT AS width FROM v WINDOW e AS (PARTITION BY symbol, market)), b AS (SELECT symbol, market, lo, width, (tick - lo) // width AS bin, sum(volume) AS volume FROM p GROUP BY ALL), s AS (SELECT *, (CASE WHEN lag(bin) OVER w = bin - 1 THEN lag(volume) OVER w ELSE 0 END + 2 * volume + CASE WHEN lead(bin) OVER w = bin + 1 THEN lead(volume) OVER w ELSE 0 END) / 4 AS smooth FROM b WINDOW w AS (PARTITION BY symbol, market ORDER BY bin)) SELECT symbol, market, bin, lo + bin * width AS low_tick, width, {R('volume')} AS volume, {R('smooth')} AS smooth, row_number() OVER (PARTITION BY symbol, market ORDER BY round(smooth, 9) DESC, bin DESC) = 1 AS is_poc FROM s")
def binned_profile(spark, sf_dir):
    return told(red.binned_profile(volumes(spark, sf_dir), KEY))


@query(f"WITH {VOLUME}, n AS (SELECT *, round(volume, 9) AS r, CASE WHEN lag(tick) OVER w = tick - 1 THEN round(lag(volume) OVER w, 9) END AS below, CASE WHEN lead(tick) OVER w = tick + 1 THEN round(lead(volume) OVER w, 9) END AS above, row_number() OVER (PARTITION BY symbol, market ORDER BY round(volume, 9) DESC, tick) AS rank FROM v WINDOW w AS (PARTITION BY symbol, market ORDER BY tick)), f AS (SELECT *, coalesce(r > below AND r > above, false) AS peak, coalesce(r < below AND r < above, false) AS trough FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, market, peak ORDER BY r DESC, tick) AS pr, row_number() OVER (PARTITION BY symbol, market, trough ORDER BY r, tick) AS tr FROM f) SELECT symbol, market, tick, {R('volume')} AS volume, rank::INTEGER AS rank, peak, trough FROM k WHERE rank <= 96 OR (peak AND pr <= 24) OR (trough AND tr <= 24)")
def profile_audit(spark, sf_dir):
    return told(red.profile_audit(volumes(spark, sf_dir), KEY))


@query(f"WITH {ATR} SELECT symbol, market, {T.format('bar')} AS bar, {R('(close - first_value(open) OVER o) / atr')} AS distance_atr, first_value(open) OVER o BETWEEN low + (high - low) * 0.25 AND high - (high - low) * 0.25 AS in_value, (row_number() OVER o - 1)::INTEGER AS bars_elapsed FROM a WINDOW o AS ({OWN})")
def position_evidence(spark, sf_dir):
    """A position entered at a series' first open."""
    b = hour_bars(spark, sf_dir)
    b = b.join(b.groupBy(*KEY).agg(F.min_by("open", "bar").alias("entry")), KEY)
    return told(red.evidence(b, F.col("entry")))


@query(f"WITH {HISTORY}, {bar_sql(1440)} SELECT symbol, market, array_to_string(list_transform(list_reverse(list(close ORDER BY bar) FILTER (close IS NOT NULL)), lambda x: printf('%.2f', round(x, 2))), ',') AS closes FROM bars GROUP BY symbol, market")
def newest_closes(spark, sf_dir):
    """Daily closes, newest first, two places."""
    b = mn.bars(history_of(spark, sf_dir), 1440).where("close is not null")
    g = b.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("bar", "close"))), lambda x: x["close"]).alias("s"))
    return g.select(*KEY, F.array_join(F.transform(red.newest_first(F.col("s"), 2), lambda x: F.format_string("%.2f", x)), ",").alias("closes"))


@query(f"WITH {BASE} SELECT trade_id, '{{\"symbol\":\"' || symbol || '\"' || CASE WHEN side > 0 THEN ',\"buy\":true' ELSE '' END || '}}' AS document FROM trades")
def pruned_documents(spark, sf_dir):
    """Trades as documents: fields chosen, renamed, nulls left out."""
    t = src.trades(spark, sf_dir)
    return t.select("trade_id", red.pruned(F.struct("symbol", F.when(F.col("side") > 0, F.lit(True)).alias("buy"))).alias("document"))
